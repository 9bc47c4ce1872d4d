"""Log files as DataFrames: text scans, compressed files, multi-line events, formats, several files.

A line's order is (file, byte order): ordinals come from the position inside each file, which Spark's
text scan keeps within a split, so no global sort is needed to number lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.kernels import SPACES
from ..functions.tables import written
from . import parsers

#: Encodings that are taken, the length from which a line is skipped, codecs by extension.
ENCODINGS = ("utf-8", "ascii")
MAX_LINE = 1024 * 1024
#: The format of lines whose templates are mined.
MINED = "drain"
CODECS = {"gz": "gzip", "gzip": "gzip", "bz2": "bzip2", "z": "zlib"}


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def is_compressed(path: str) -> bool:
    return extension(path) in CODECS


def _unpacked(data: bytes, bits: int) -> Iterator[bytes]:
    """The content of one or more packed members in pieces of a megabyte at most."""
    while data:
        one = zlib.decompressobj(bits)
        piece = one.decompress(data, 1 << 20)
        while piece or one.unconsumed_tail:
            yield piece
            piece = one.decompress(one.unconsumed_tail, 1 << 20)
        if not one.eof:
            raise ValueError("a packed file ends early")
        data = one.unused_data


def _inflate(it):
    """Lines of packed files, some thousands at a time."""
    import pandas as pd

    for pdf in it:
        for path, data in zip(pdf["path"], pdf["content"]):
            at, rest = 0, b""
            for piece in _unpacked(bytes(data), 31 if extension(path) == "gzip" else 15):
                *lines, rest = (rest + piece).split(b"\n")
                if lines:
                    yield pd.DataFrame({"value": [x.decode("utf-8", "replace") for x in lines], "file": path, "pos": range(at, at + len(lines))})
                    at += len(lines)
            if rest:
                yield pd.DataFrame({"value": [rest.decode("utf-8", "replace")], "file": path, "pos": [at]})


class LogReader:
    """Options of a read, then load(path).  spark.read does the scanning."""

    def __init__(self, spark: SparkSession, **options):
        self.spark = spark
        self.options: dict = {"format": "json", "encoding": "utf-8", "has_header": False, "logical_lines": False, "multi_line": False, "enclosing": 0, "preprocess": False, "max_line_length": MAX_LINE}
        for k, v in options.items():
            self.option(k, v)

    def option(self, key: str, value) -> "LogReader":
        if key == "encoding" and str(value).lower() not in ENCODINGS:
            raise ValueError(f"encoding {value!r} is not supported; known: {', '.join(ENCODINGS)}")
        if key == "format" and value != MINED:
            parsers.parser(value)
        self.options[key] = value
        return self

    def lines(self, path: str | list[str]) -> DataFrame:
        """(value, file, pos): non-empty lines under the length limit, in file order by (file, pos).

        With multi_line, value is a record of quoted CSV or of XML, whose quotes or elements may hold line ends;
        enclosing is how many XML elements lie around all records.
        """
        paths = [path] if isinstance(path, str) else list(path)
        odd = [p for p in paths if extension(p) in ("gzip", "z")]
        plain = [p for p in paths if p not in odd]
        frames = []
        if plain:
            # pos: split offset first, then the row within the task's split
            text = self.spark.read.option("lineSep", "\n").text(plain)
            frames.append(text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).select("value", "file", F.struct("block", "row").alias("pos")))
        if odd:
            got = self.spark.read.format("binaryFile").load(odd).select("path", "content").mapInPandas(_inflate, "value string, file string, pos bigint")
            frames.append(got.select("value", "file", F.struct(F.lit(0).cast("bigint").alias("block"), F.col("pos").alias("row")).alias("pos")))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        multi = self.options["multi_line"]
        out = out.where((F.lit(multi) | (F.col("value") != "")) & (F.octet_length("value") < self.options["max_line_length"]))
        if self.options["has_header"]:
            # a row a file; a folder is one path, so files are counted
            first = written(out.groupBy("file").agg(F.min("pos").alias("head")), "heads")
            few = first.count() <= 100_000
            out = out.join(F.broadcast(first) if few else first, "file").where("pos > head").drop("head")
            if multi and not few:  # a join by broadcast keeps the order of lines
                out = out.repartition("file").sortWithinPartitions("file", "pos")
        if multi:
            out = balanced_lines(out, *self._balance()).where(F.btrim("value", F.lit(SPACES)) != "")
        return logical_lines(out) if self.options["logical_lines"] else out

    def _balance(self) -> tuple[Column, Callable]:
        """What a line adds to the balance of what is open, and whether a balance (or an array of them) lets a record begin."""
        value, kind, enclosing = F.col("value"), self.options["format"].lower(), self.options["enclosing"]
        if kind in ("csv", "tsv"):
            return F.regexp_count(value, F.lit('"')), lambda open: open % 2 == 0
        if kind == "xml":
            return F.regexp_count(value, F.lit("<[A-Za-z_]")) - F.regexp_count(value, F.lit("</|/>")), lambda open: open <= enclosing
        raise ValueError(f"records of format {kind!r} are single lines")

    def _values(self, path: str | list[str]) -> DataFrame:
        """(file, pos, line, value): value is what the parser is given."""
        return self._prepared(self.lines(path))

    def _prepared(self, lines: DataFrame) -> DataFrame:
        value = F.btrim(F.col("value"), F.lit(SPACES)) if self.options.get("trim", False) else F.col("value")
        if self.options["preprocess"]:
            value = clean.clean_line(value)[0]
        return lines.select("file", "pos", F.col("value").alias("line"), value.alias("value"))

    def _own(self) -> dict:
        return {k: v for k, v in self.options.items() if k not in ("format", "encoding", "has_header", "logical_lines", "multi_line", "enclosing", "preprocess", "max_line_length", "trim")}

    def parsed(self, path: str | list[str]) -> DataFrame:
        """(file, pos, line, r): r is the record, null where the line does not fit."""
        record = parsers.parser(self.options["format"])(F.col("value"), **self._own())
        return self._values(path).select("file", "pos", "line", record.alias("r"))

    def load(self, path: str | list[str], format: str | None = None) -> DataFrame:
        """id, file and the record's columns; lines that do not fit are dropped.

        id is the dense 0-based ordinal of parsed lines in (file, line) order.
        """
        if format is not None:
            self.option("format", format)
        values = self._values(path)
        if self.options["format"] == MINED:
            return self._mined(values)
        rows = parsers.parse_rows(values, "value", self.options["format"], "file", "pos", **self._own())
        if self.options["multi_line"]:  # else they are parsed for the ranges' sample, too
            rows = written(rows, "records")
        return with_ordinal(rows, ["file", "pos"]).drop("pos")

    def _mined(self, values: DataFrame) -> DataFrame:
        """Records of template mining over all lines in (file, line) order, empty ones included."""
        from ..operators import templates

        lines = with_ordinal(values.select("file", "pos", "value"), ["file", "pos"])
        found = templates.mined_records(lines.select("id", "value"), "value", **self._own())
        empty = {"severity": "string", "timestamp": "timestamp_ntz"}
        out = found.join(lines.select("id", "file"), "id").withColumns({k: F.lit(None).cast(t) for k, t in empty.items()})
        return out.select("id", "file", "body", "template", "fields", "severity", "timestamp", F.lit("").alias("level"), F.lit("").alias("message"))

    def counted(self, path: str | list[str]) -> tuple[DataFrame, Observation]:
        """(file, pos, line and the record's columns of the lines that fit; an observation of processed and failed lines).

        The counts come with the first action on the records, without a scan of their own.
        """
        seen = Observation("lines")
        rows = self.parsed(path).observe(seen, F.count("r").alias("processed"), F.count_if(F.col("r").isNull()).alias("failed"))
        return rows.where("r is not null").select("file", "pos", "line", "r.*"), seen

    def counts(self, path: str | list[str]) -> DataFrame:
        """processed and failed lines."""
        return self.parsed(path).agg(F.count("r").alias("processed"), F.count_if(F.col("r").isNull()).alias("failed"))


def with_ordinal(df: DataFrame, order: list[str]) -> DataFrame:
    """df with id: its dense 0-based place in the order, by one range shuffle and per-part counts."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = written(ranged, "ranged")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    # a row a part
    base = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(base.select("__part", "__base")), "__part").select((F.col("__base") + F.col("__row")).alias("id"), *df.columns)


#: Rows of a segment, as a power of two: what logical_lines orders at once.
SEGMENT_BITS = 17


def logical_lines(lines: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """Joins continuation lines of (value, file, pos): a line that starts with white space joins the one
    before with a space, a line after a trailing backslash joins directly.

    A file is cut into segments: the rows of one split, at most so many.  Segments are ordered alone.  A row a segment
    tells whether its last line is open and how many events start in it; over these rows, and not over the
    file's lines, each segment learns whether its first line is joined, and to which segment's last event
    the lines before its first start belong.  An event may reach over any number of segments; it must fit into a row.
    """
    value = F.col("value")
    key = ["file", "__block", "__part"]
    rows = lines.select("value", "file", "pos", F.col("pos.block").alias("__block"), F.shiftright("pos.row", bits).alias("__part"))
    rows = rows.withColumns({"__open": value.endswith("\\"), "__indented": value.rlike(r"^[ \t]")})
    w = Window.partitionBy(*key).orderBy("pos")
    rows = rows.withColumn("__lag", F.lag("__open").over(w))  # null in a segment's first row alone
    inner = F.col("__lag").isNotNull() & ~(F.col("__indented") | F.col("__lag"))
    parts = rows.groupBy(*key).agg(F.max_by("__open", "pos").alias("open"), F.min_by("__indented", "pos").alias("indented"), F.count_if(inner).alias("starts"))
    of_file = Window.partitionBy("file").orderBy("__block", "__part")
    parts = parts.withColumn("__before", F.lag("open").over(of_file))
    parts = parts.withColumn("__first", F.col("__before").isNull() | ~(F.col("indented") | F.col("__before")))
    owner = _last_event(F.col("starts") + F.col("__first").cast("int"))
    facts = parts.select(*[F.col(k).alias(f"{k}_") for k in key], "__before", "__first", owner.alias("__owner"))
    same = (F.col("file") == F.col("file_")) & (F.col("__block") == F.col("__block_")) & (F.col("__part") == F.col("__part_"))
    marked = rows.join(facts, same)
    joined = F.coalesce("__lag", "__before", F.lit(False))
    marked = marked.withColumn("__start", F.when(F.col("__lag").isNull(), F.col("__first")).otherwise(inner)).withColumn("__joined", joined)
    marked = marked.withColumn("__k", F.sum(F.col("__start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.struct("__block", "__part", F.col("__k").alias("n"))
    body = F.when(F.col("__open"), F.rtrim(F.substr(value, F.lit(1), F.length(value) - 1))).otherwise(value)
    glue = F.when(F.col("__start") | F.col("__joined"), F.lit("")).otherwise(F.lit(" "))
    piece = F.concat(glue, F.when(F.col("__start"), body).otherwise(F.regexp_replace(body, r"^[ \t]+", "")))
    events = marked.select("file", F.when(F.col("__k") > 0, own).otherwise(F.col("__owner")).alias("event"), "pos", piece.alias("p"))
    events = events.groupBy("file", "event").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("parts"))
    return events.select(F.array_join(F.transform("parts", lambda x: x["p"]), "").alias("value"), "file", F.col("parts")[0]["pos"].alias("pos"))


def _last_event(starts: Column) -> Column:
    """Over the segments of a file: the last event that starts in one before this; starts: how many start in each."""
    last = F.struct("__block", "__part", starts.alias("n"))
    before = Window.partitionBy("file").orderBy("__block", "__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(last["n"] > 0, last), ignorenulls=True).over(before)


_RUN = "file string, block bigint, part bigint, pos struct<block:bigint,row:bigint>, value string, starts boolean, edge boolean"


def _runs(closed: Callable):
    """Lines of a task, in order, with their weights and the sums before their segments, as pieces of records.

    A piece is a segment's lines from one start of a record to the next; those before its first start and after its last
    are edges, which other segments may go on.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["file", "block", "part", "pos", "value", "starts", "edge"]

    def run(batches):
        import numpy as np

        now, held, sum_ = None, None, 0  # held: (key, pos, texts, starts, edge) of the piece that is not closed yet

        def row(piece) -> pa.RecordBatch:
            key, (block, place), texts, starts, edge = piece
            pos = pa.array([{"block": block, "row": place}], pa.struct([("block", pa.int64()), ("row", pa.int64())]))
            cells = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), pos, pa.array(["\n".join(texts)]), pa.array([starts]), pa.array([edge])]
            return pa.RecordBatch.from_arrays(cells, names)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            file, block, part, place, value, weight, before = (batch.column(i) for i in range(7))
            blocks, parts, places = (c.to_numpy(zero_copy_only=False) for c in (block, part, place))
            weights, befores = (c.to_numpy(zero_copy_only=False) for c in (weight, before))
            codes = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1]) | (parts[1:] != parts[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                key = (file[lo].as_py(), int(blocks[lo]), int(parts[lo]))
                if key != now:
                    if held is not None:
                        yield row((*held[:4], True))  # a segment's last piece
                    now, held, sum_ = key, None, int(befores[lo])
                sums = sum_ + np.cumsum(weights[lo:hi]) - weights[lo:hi]
                sum_ = int(sums[-1] + weights[hi - 1])
                cuts = (np.flatnonzero(closed(sums)) + lo).tolist()
                first = cuts[0] if cuts else hi
                if first > lo:  # lines of a piece that began before
                    texts = value.slice(lo, first - lo).to_pylist()
                    if held is None:
                        held = (key, (key[1], int(places[lo])), texts, False, True)
                    else:
                        held[2].extend(texts)
                if not cuts:
                    continue
                if held is not None:
                    yield row(held)
                last = cuts[-1]
                held = (key, (key[1], int(places[last])), value.slice(last, hi - last).to_pylist(), True, False)
                if len(cuts) > 1:
                    texts = value.slice(first, last - first)
                    offsets = pa.array(np.array(cuts) - first, pa.int32())
                    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, texts), "\n")
                    n, at = len(cuts) - 1, np.array(cuts[:-1])
                    pos = pa.StructArray.from_arrays([pa.array(blocks[at]), pa.array(places[at])], ["block", "row"])
                    same = [pa.array([k], t).take(pa.array(np.zeros(n, np.int64))) for k, t in zip(key, (pa.string(), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*same, pos, joined, pa.array(np.ones(n, bool)), pa.array(np.zeros(n, bool))], names)
        if held is not None:
            yield row((*held[:4], True))

    return run


def balanced_lines(lines: DataFrame, weight: Column, closed: Callable, bits: int = SEGMENT_BITS) -> DataFrame:
    """Joins lines of (value, file, pos) into records, by line ends: a line begins a record where the weights
    of all lines before it in its file have a sum that is closed (a function of arrays of sums).

    lines come from a scan, so a task has the lines of a split in order, and none of them is shuffled.  Segments, as in
    logical_lines: the sum before each comes from a row a segment.  Each is joined into records by itself; its lines before its first
    start, and its last record, are put together with those of other segments.  A file's first line begins a record.
    A record must fit into a row.
    """
    key = ["file", "__block", "__part"]
    rows = lines.select("value", "file", "pos", F.col("pos.block").alias("__block"), F.shiftright("pos.row", bits).alias("__part"), weight.cast("bigint").alias("__weight"))
    sums = rows.groupBy(*key).agg(F.sum("__weight").alias("all"))
    sums = sums.withColumn("__sum", F.sum("all").over(Window.partitionBy("file").orderBy("__block", "__part")) - F.col("all")).drop("all")
    # a row a segment; a join by broadcast keeps the order of lines
    marked = rows.join(F.broadcast(written(sums, "balances")), key)
    pieces = marked.select(*key, F.col("pos.row").alias("__row"), "value", "__weight", "__sum").mapInArrow(_runs(closed), _RUN)
    pieces = written(pieces, "pieces")
    own = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("file").orderBy("block", "part", "pos"))
    edges = pieces.where("edge").withColumn("event", own).groupBy("file", "event").agg(F.array_sort(F.collect_list(F.struct("block", "part", "pos", "value"))).alias("parts"))
    joined = edges.select(F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value"), "file", F.col("parts")[0]["pos"].alias("pos"))
    return pieces.where("not edge").select("value", "file", "pos").unionByName(joined)


class MultiFileReader:
    """Several files as one stream of records in time order, or step by step while they grow."""

    def __init__(self, spark: SparkSession):
        self.spark, self.files, self.followers = spark, {}, {}

    def add_file(self, path: str, format: str = "json", **options) -> None:
        if path in self.files:
            raise ValueError(f"{path} was added before")
        self.files[path] = (format, options)

    def remove_file(self, path: str) -> None:
        if path not in self.files:
            raise KeyError(path)
        del self.files[path]
        self.followers.pop(path, None)

    def get_files(self) -> list[str]:
        return list(self.files)

    def entries(self) -> DataFrame:
        """All records of all files, by time, then file, then line."""
        frames = []
        for path, (f, o) in self.files.items():
            reader = LogReader(self.spark, format=f, **o)
            frames.append(parsers.parse_rows(reader._values(path).withColumn("bytes", F.octet_length("line")), "value", f, "file", "pos", "bytes", **reader._own()))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.orderBy("timestamp", "file", "pos")

    def _follower(self, path: str):
        from .follow import Follower

        return self.followers.setdefault(path, Follower(self.spark, path))

    def has_more(self) -> bool:
        """Whether a file has lines that next_entries has not given."""
        return any(self._follower(path).has_more() for path in self.files)

    def next_entries(self, finished: bool = False) -> DataFrame | None:
        """Records of the lines that files got since the step before, by time, then file, then line; None without files.
        finished: the last lines need no line end."""
        out = None
        for path, (f, o) in self.files.items():
            reader = LogReader(self.spark, format=f, **o)
            lines = self._follower(path).next(finished).where(F.octet_length("value") < reader.options["max_line_length"])
            rows = parsers.parse_rows(reader._prepared(lines.withColumnRenamed("line", "pos")), "value", f, "file", "pos", **reader._own())
            out = rows if out is None else out.unionByName(rows)
        return None if out is None else out.orderBy("timestamp", "file", "pos")

    def progress(self) -> DataFrame:
        """Entries and bytes read by file."""
        return self.entries().groupBy("file").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))


def parse_log_file(spark: SparkSession, path: str, format: str = "json", **options) -> DataFrame:
    return LogReader(spark, format=format, **options).load(path)


def stream_rows(df: DataFrame, callback: Callable[[object], bool]) -> int:
    """Rows in order to callback, one partition in memory at a time, until it returns False; how many."""
    n = 0
    for row in df.toLocalIterator():
        n += 1
        if callback(row) is False:
            break
    return n


def chunks(df: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of size, the last one shorter."""
    held: list = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def body_column(df: DataFrame) -> Column:
    """The text that template mining works on: body, else message."""
    return F.coalesce("body", F.nullif("message", F.lit("")), F.lit(""))
