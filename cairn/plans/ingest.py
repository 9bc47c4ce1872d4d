"""Queries that read files: events written as lines in every format, read back by LogReader and its options.

Every query writes all events; lines keep the order of event_id, so the reader's dense ids can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.tables import new_path
from ..functions.times import format_time
from ..operators import templates
from ..sources import reader
from ..sources.events import SQL as LOGS
from ..sources.events import log_entries
from ..sources.reader import LogReader, MultiFileReader
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_AT = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
#: Compressions that Spark writes: their codec, extension, and the extension that the files get.
_PACKED = {"gz": ("gzip", ".gz", None), "bz2": ("bzip2", ".bz2", None), "gzip": ("gzip", ".gz", ".gzip"), "z": ("deflate", ".deflate", ".z")}


def _iso() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")


def json_line() -> Column:
    return F.to_json(F.struct(_iso().alias("time"), F.col("level"), F.col("message").alias("msg")))


def write_lines(logs: DataFrame, line: Column, label: str, header: str | None = None, packed: str | None = None) -> str:
    """A folder of text files with a line (or more) for each row in the order of id; a header line in each file."""
    s = logs.sparkSession
    path = new_path(s, label)
    rows = logs.select("id", line.alias("value")).repartitionByRange("id").sortWithinPartitions("id").select("value")
    if header is not None:
        part = F.spark_partition_id()
        rows = rows.select(F.explode(F.when(F.monotonically_increasing_id() == part.cast("bigint") * (1 << 33), F.array(F.lit(header), F.col("value"))).otherwise(F.array("value"))).alias("value"))
    codec, made, wanted = _PACKED.get(packed, (None, None, None))
    rows.write.text(path, compression=codec)
    if wanted:
        folder = s._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(s._jsc.hadoopConfiguration())
        for f in fs.listStatus(folder):
            name = f.getPath().getName()
            if name.endswith(made):
                fs.rename(f.getPath(), s._jvm.org.apache.hadoop.fs.Path(folder, name[: -len(made)] + wanted))
    return path


def files_of(s: SparkSession, path: str) -> list[str]:
    folder = s._jvm.org.apache.hadoop.fs.Path(path)
    status = folder.getFileSystem(s._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(f.getPath().toString() for f in status if f.getPath().getName().startswith("part-"))


def _shown(records: DataFrame) -> DataFrame:
    return records.select("id", format_time(F.col("timestamp")).alias("at"), "level", "message")


def _source(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[f"source_{name}"] = lambda s, d: run(log_entries(s, d))
    SQL[f"source_{name}"] = f"{LOGS} {sql}"


_ALL = f"SELECT id, {_AT} AS at, level, message FROM log_entries"
_PLAIN = lambda **o: lambda x: _shown(LogReader(x.sparkSession, **o).load(write_lines(x, json_line(), "lines")))


def _packed(kind: str) -> Callable[[DataFrame], DataFrame]:
    return lambda x: _shown(LogReader(x.sparkSession).load(files_of(x.sparkSession, write_lines(x, json_line(), kind, packed=kind))))


_source("text", _PLAIN(), _ALL)
for _kind in _PACKED:
    _source(_kind, _packed(_kind), _ALL)
_source("parse_log_file", lambda x: _shown(reader.parse_log_file(x.sparkSession, write_lines(x, F.concat(F.lit("time="), _iso(), F.lit(" level="), "level", F.lit(' msg="'), "service", F.lit('"')), "lf"), "logfmt")), f"SELECT id, {_AT} AS at, level, service AS message FROM log_entries")


def _encodings(x: DataFrame) -> DataFrame:
    def taken(name: str) -> bool:
        try:
            LogReader(x.sparkSession, encoding=name)
        except ValueError:
            return False
        return True

    return x.sparkSession.createDataFrame([(n, taken(n)) for n in ("utf-8", "ascii", "latin-1")], "encoding string, taken boolean")


_source("encoding", _encodings, "SELECT * FROM (VALUES ('utf-8', true), ('ascii', true), ('latin-1', false)) v(encoding, taken)")


def _with_header(x: DataFrame) -> DataFrame:
    path = write_lines(x, F.concat_ws(",", F.col("id").cast("string"), "level", "service"), "csv", header="id,level,service")
    out = LogReader(x.sparkSession, format="csv", has_header=True, dimensions=("event", "severity", "body")).load(path)
    return out.select("id", F.col("fields")["event"].cast("bigint").alias("event"), "severity", "body")


_source("header", _with_header, "SELECT id, id AS event, level AS severity, service AS body FROM log_entries")
_source("tsv", lambda x: LogReader(x.sparkSession, format="tsv").load(write_lines(x, F.concat_ws("\t", "level", "service"), "tsv")).select("id", F.col("fields")["0"].alias("a"), F.col("fields")["1"].alias("b")), "SELECT id, level AS a, service AS b FROM log_entries")
_source("quoted_csv", lambda x: LogReader(x.sparkSession, format="csv", quoted=True).load(write_lines(x, F.concat(F.lit('"'), F.replace("message", F.lit('"'), F.lit('""')), F.lit(', said",'), "level"), "quoted")).select("id", F.col("fields")["0"].alias("a"), F.col("fields")["1"].alias("b")), "SELECT id, message || ', said' AS a, level AS b FROM log_entries")
_source("jsonl", _PLAIN(format="jsonl"), _ALL)
_source("line", lambda x: LogReader(x.sparkSession, format="line", now=datetime(2024, 1, 1)).load(write_lines(x, F.col("message"), "line")).select("id", "level", "message", format_time(F.col("timestamp")).alias("at")), "SELECT id, 'INFO' AS level, message, '2024-01-01 00:00:00' AS at FROM log_entries")
_source("xml", lambda x: _shown(LogReader(x.sparkSession, format="xml").load(write_lines(x, F.concat(F.lit('<event level="'), "level", F.lit('"><time>'), _iso(), F.lit("</time><message>"), F.replace("message", F.lit('"'), F.lit("&quot;")), F.lit("</message></event>")), "xml"))), _ALL)


def _multi_line_csv(x: DataFrame) -> DataFrame:
    """Quoted values with line ends, an empty line and doubled quotes in them."""
    line = F.concat(F.lit('"'), "service", F.lit('\n\n""said"", '), "level", F.lit('\n."'), F.lit(","), "id")
    out = LogReader(x.sparkSession, format="csv", quoted=True, multi_line=True).load(write_lines(x, line, "multi-csv"))
    return out.select("id", F.col("fields")["0"].alias("a"), F.col("fields")["1"].alias("b"))


def _nested_xml(x: DataFrame) -> DataFrame:
    """Events over several lines, with elements inside elements."""
    parts = [F.lit('<event source="s"\n level="'), "level", F.lit('">\n <head><time zone="UTC">'), _iso(), F.lit("</time>\n </head>\n\n <body>\n  <empty/><message>"), F.replace("message", F.lit('"'), F.lit("&quot;")), F.lit("</message>\n </body>\n</event>")]
    return _shown(LogReader(x.sparkSession, format="xml", multi_line=True).load(write_lines(x, F.concat(*parts), "multi-xml")))


_source("multi_line_csv", _multi_line_csv, "SELECT id, service || chr(10) || chr(10) || '\"said\", ' || level || chr(10) || '.' AS a, id::VARCHAR AS b FROM log_entries")
_source("nested_xml", _nested_xml, _ALL)
# a line in ten is no JSON, and every line is followed by an empty one
_BROKEN = lambda: F.concat(F.when(F.col("id") % 10 == 3, F.lit("{broken ")).otherwise(F.lit("")), json_line(), F.lit("\n"))
_source("malformed", lambda x: LogReader(x.sparkSession).load(write_lines(x, _BROKEN(), "broken")).select("id", "message"), "SELECT row_number() OVER (ORDER BY id) - 1 AS id, message FROM log_entries WHERE id % 10 <> 3")
_source("counts", lambda x: LogReader(x.sparkSession).counts(write_lines(x, _BROKEN(), "broken")), "SELECT count(*) FILTER (id % 10 <> 3) AS processed, count(*) FILTER (id % 10 = 3) AS failed FROM log_entries")
_source("max_line_length", lambda x: LogReader(x.sparkSession, format="line", max_line_length=24).load(write_lines(x, F.col("message"), "long")).select("id", "message"), "SELECT row_number() OVER (ORDER BY id) - 1 AS id, message FROM log_entries WHERE strlen(message) < 24")
_source("preprocess", lambda x: LogReader(x.sparkSession, format="line", preprocess=True).load(write_lines(x, F.col("message"), "pre")).select("id", "message"), "SELECT id, trim(regexp_replace(translate(message, ',;:|' || chr(9) || '[]{}()<>', '             '), ' +', ' ', 'g'), ' ') AS message FROM log_entries")
_source("trim", lambda x: LogReader(x.sparkSession, format="line", trim=True).load(write_lines(x, F.concat(F.lit("\t "), "message", F.lit(" \r")), "trim")).select("id", "message"), "SELECT id, message FROM log_entries")
_source("logical_lines", lambda x: LogReader(x.sparkSession, format="line", logical_lines=True).load(write_lines(x, F.concat("service", F.lit("\n  at "), "level", F.lit(" \\\nmore")), "multi")).select("id", "message"), "SELECT id, service || ' at ' || level || 'more' AS message FROM log_entries")


def _followed(x: DataFrame) -> DataFrame:
    """A folder that gets two thirds of the events first and the others later, read in two steps."""
    path, steps = new_path(x.sparkSession, "growing"), MultiFileReader(x.sparkSession)
    out = None
    for number, part in enumerate(("id % 3 <> 1", "id % 3 = 1")):
        x.where(part).select(json_line().alias("value")).write.mode("append").text(path)
        if number == 0:
            steps.add_file(path, "json")
        rows = steps.next_entries().select(F.lit(number).alias("step"), "level", "message")
        out = rows if out is None else out.unionByName(rows)
    return out


_source("follow", _followed, "SELECT (id % 3 = 1)::INT AS step, level, message FROM log_entries")


def _chunked(x: DataFrame) -> DataFrame:
    """Rows in chunks of 1000: each chunk's number, rows and first id."""
    records = LogReader(x.sparkSession).load(write_lines(x, json_line(), "lines")).select("id").orderBy("id")
    found = [(i, len(c), c[0]["id"]) for i, c in enumerate(reader.chunks(records, 1000))]
    return x.sparkSession.createDataFrame(found, "chunk bigint, n bigint, first bigint")


def _streamed(x: DataFrame) -> DataFrame:
    """Rows one by one until the callback has had 1500 of them."""
    seen: list[int] = []
    records = LogReader(x.sparkSession).load(write_lines(x, json_line(), "lines")).select("id").orderBy("id")
    n = reader.stream_rows(records, lambda r: seen.append(r["id"]) or len(seen) < 1500)
    return x.sparkSession.createDataFrame([(n, max(seen))], "n bigint, last bigint")


_source("chunks", _chunked, "SELECT id // 1000 AS chunk, count(*) AS n, min(id) AS first FROM log_entries GROUP BY 1")
_source("stream_rows", _streamed, "SELECT count(*) AS n, max(id) AS last FROM (SELECT id FROM log_entries ORDER BY id LIMIT 1500)")


def _ordered_batches(x: DataFrame) -> DataFrame:
    """A folder of files as micro-batches of one file, in order: rows and numbers of the batches that came."""
    s, seen = x.sparkSession, []
    path = write_lines(x, json_line(), "lines")
    records = streams.read_records(s, path, "json", files_per_trigger=1)
    streams.for_each_batch(records, lambda df, i: seen.append((i, df.count())), new_path(s, "checkpoint")).awaitTermination()
    return s.createDataFrame([(sum(n for _, n in seen), [i for i, _ in seen] == list(range(len(seen))))], "n bigint, in_order boolean")


_source("ordered_batches", _ordered_batches, "SELECT count(*) AS n, true AS in_order FROM log_entries")


def _merged(x: DataFrame) -> DataFrame:
    """Two files, one of errors and one of all else, as one sequence by time."""
    m = MultiFileReader(x.sparkSession)
    for part, cond in (("errors", F.col("level") == "ERROR"), ("others", F.col("level") != "ERROR")):
        m.add_file(write_lines(x.where(cond), F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.col("level"), F.col("id").cast("string").alias("msg"))), part))
    return m.entries().groupBy("level").agg(F.count("*").alias("n"), F.min("timestamp").cast("string").alias("first"), F.sum("bytes").alias("bytes"))


_source("multi_file", _merged, "SELECT level, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, sum(strlen('{\"time\":\"2024-01-01T00:00:00\",\"level\":\"\",\"msg\":\"\"}') + strlen(level) + strlen(id::VARCHAR))::BIGINT AS bytes FROM log_entries GROUP BY 1")

# --- template mining as a format, empty lines, parameters and lookups ---------------------------------
_MASK = "regexp_replace(regexp_replace(message, 'user [0-9]+', 'user <*>'), '[0-9]+}$', '<*>')"
_source("drain", lambda x: LogReader(x.sparkSession, format="drain").load(write_lines(x, F.col("message"), "drain")).select("id", "body", F.col("fields")["source"].alias("source"), F.col("fields")["detected_timestamp"].alias("stamp")), "SELECT id, message AS body, 'log' AS source, NULL::VARCHAR AS stamp FROM log_entries")


def _on_logs(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda s, d: run(log_entries(s, d))
    SQL[name] = f"{LOGS} {sql}"


def _with_empty(x: DataFrame) -> DataFrame:
    """Every tenth message empty: each is a cluster of its own."""
    _, clusters = templates.mine(x.select("id", F.when(F.col("id") % 10 == 0, F.lit("")).otherwise(F.col("message")).alias("message")), headers=())
    return clusters.groupBy("template").agg(F.count("*").alias("clusters"), F.sum("count").alias("lines"), F.min("first_id").alias("first"))


_on_logs("drain_empty_lines", _with_empty, f"SELECT template, CASE WHEN template = '<EMPTY>' THEN count(*) ELSE 1 END AS clusters, count(*) AS lines, min(id) AS first FROM (SELECT id, CASE WHEN id % 10 = 0 THEN '<EMPTY>' ELSE {_MASK} END AS template FROM log_entries) GROUP BY 1")


def _records(x: DataFrame) -> DataFrame:
    out = templates.mined_records(x.select("id", F.concat(F.lit("12:00 "), "message").alias("line")), "line", headers=())
    return out.select("id", "body", F.col("fields")["cluster_id"].cast("bigint").alias("cluster_id"), F.col("fields")["source"].alias("source"), F.col("fields")["detected_timestamp"].alias("stamp"))


_on_logs("drain_records", _records, f", m AS (SELECT id, message, {_MASK} AS t FROM log_entries), f AS (SELECT t, row_number() OVER (ORDER BY min(id)) - 1 AS cluster_id FROM m GROUP BY 1) SELECT id, '12:00 ' || message AS body, cluster_id, 'log' AS source, '12:00' AS stamp FROM m JOIN f USING (t)")


def _row_params(x: DataFrame) -> DataFrame:
    """Each line's own parameters at its cluster's places; the user id is one from the first line on."""
    rows, _ = templates.mine(x, headers=())
    return rows.select("id", F.try_element_at("params", F.lit("param_2")).alias("user"))


_on_logs("drain_params", _row_params, "SELECT id, string_split(message, ' ')[3] AS user FROM log_entries")


def _lookups(x: DataFrame) -> DataFrame:
    """Templates from the even lines; odd lines, and one nobody has seen, find their cluster's template."""
    _, clusters = templates.mine(x.where("id % 2 = 0"), headers=())
    asked = x.where("id % 2 = 1").select("id", "message").unionByName(x.sparkSession.createDataFrame([(-1, "no such line here")], "id bigint, message string"))
    found = templates.find_cluster(asked, clusters, headers=())
    return found.join(clusters.select("cluster_id", "template"), "cluster_id", "left").select("id", "template")


_on_logs("drain_lookup", _lookups, f"SELECT id, {_MASK} AS template FROM log_entries WHERE id % 2 = 1 UNION ALL SELECT -1, NULL")
_on_logs("template_by_id", lambda x: templates.template_of(templates.mine(x, headers=())[1], 0), f"SELECT {_MASK} AS template FROM log_entries ORDER BY id LIMIT 1")


def _pattern_checks(x: DataFrame) -> DataFrame:
    def fails(pattern: str) -> bool:
        try:
            clean.extract_attributes(x, {"a": pattern}, "message")
        except ValueError:
            return True
        return False

    return x.sparkSession.createDataFrame([(p, fails(p)) for p in ("[0-9]+", "(", "a{2")], "pattern string, fails boolean")


_on_logs("pattern_check", _pattern_checks, "SELECT * FROM (VALUES ('[0-9]+', false), ('(', true), ('a{2', false)) v(pattern, fails)")
