"""Clusters of one leaf of the template tree, folded from its lines in many tasks.

A line whose best similarity is 1.0 changes no cluster, so a leaf's state depends on its few changing lines
alone: the log.  A leaf's lines are cut into chunks, contiguous in id.  Every chunk starts from the state that
the log's lines before it give, as far as the log is known, and reports its own changing lines.  Those of all
chunks, folded again in order, are the next log; chunks before whose first line the log changed run again,
until it stays as it is.  Then each chunk has started where the one before it ended: the result is that of one
task that takes line after line.  A round settles at least the first chunk that was wrong, and commonly all.

Chunks are rows of one table, so a leaf of any number of lines is many tasks; the log goes with them, and has
as many lines as the leaf's templates changed.  A log must fit into a row (2 GB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written

WILD = "<*>"
#: Lines and characters of a chunk at most; a longer line is a chunk of its own.
CHUNK, CHUNK_CHARS = 4096, 4_000_000
#: Bytes of lines of a log that is broadcast at most.
SMALL = 32_000_000


def number_like(token: str) -> bool:
    """The rule of functions.kernels.is_number in plain Python."""
    if len(token) <= 1:
        return token.isascii() and token.isdigit()
    head, rest = token[0], token[1:]
    dots = token.count(".")
    return (head in "+-." or (head.isascii() and head.isdigit())) and dots <= 1 and all(c == "." or (c.isascii() and c.isdigit()) for c in rest)


class Cluster:
    __slots__ = ("number", "tokens", "params", "count", "first", "text", "places")

    def __init__(self, number: int, tokens: list[str], first: int):
        self.number, self.tokens, self.first, self.count = number, list(tokens), first, 0
        self.params = {i for i, t in enumerate(tokens) if number_like(t)}
        self.note()

    def note(self) -> None:
        """Keeps the template's text and the parameters' places as a list in text."""
        self.text, self.places = " ".join(self.tokens), ",".join(map(str, sorted(self.params)))

    def widen(self, tokens: list[str]) -> None:
        """Takes a line in: tokens that differ become wildcards."""
        new = [i for i, (a, b) in enumerate(zip(self.tokens, tokens)) if a != b and a != WILD]
        for i in new:
            self.tokens[i] = WILD
        self.params.update(new)
        if new:
            self.note()

    def copy(self) -> "Cluster":
        other = object.__new__(Cluster)
        other.number, other.tokens, other.params, other.count = self.number, list(self.tokens), set(self.params), self.count
        other.first, other.text, other.places = self.first, self.text, self.places
        return other


class Leaf:
    """Clusters of one leaf, in order of their creation.  All its lines have the same number of tokens."""

    def __init__(self, threshold: float):
        self.threshold, self.clusters = threshold, []

    def copy(self) -> "Leaf":
        other = Leaf(self.threshold)
        other.clusters = [c.copy() for c in self.clusters]
        return other

    def match(self, tokens: list[str]) -> Cluster | None:
        best, most = None, -1.0
        for c in self.clusters:
            same = sum(a == b or a == WILD for a, b in zip(c.tokens, tokens)) / max(len(c.tokens), len(tokens), 1)
            if same > most:
                best, most = c, same
        return best if best is not None and most >= self.threshold else None

    def add(self, tokens: list[str], line: int) -> Cluster:
        """The cluster of one line, which it may change."""
        c = self.match(tokens)
        if c is None:
            c = Cluster(len(self.clusters), tokens, line)
            self.clusters.append(c)
        else:
            c.widen(tokens)
        c.count += 1
        return c

    def fold(self, lines: list[str], ids: list[int]) -> tuple[list[int], list[str], list[str], list[int]]:
        """add() for many lines: (cluster, template, places of parameters at the time; places of changing lines).

        Lines meet clusters as columns of token numbers.  Only a changing line makes a cluster's column be
        computed again, for the lines after it.
        """
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        number = {w: i for i, w in enumerate(words)}
        codes = coded.indices.to_numpy(zero_copy_only=False).reshape(len(lines), -1)
        n = codes.shape[1]
        best, most = np.full(len(lines), -1), np.full(len(lines), -1)

        def meet(c: Cluster, start: int) -> None:
            own = np.array([number.get(t, -1) for t in c.tokens])
            fixed = [i for i, t in enumerate(c.tokens) if t != WILD]
            same = n - len(fixed) + (codes[start:, fixed] == own[fixed]).sum(1)
            b, m = best[start:], most[start:]
            better = (same > m) | ((same == m) & (c.number < b))
            b[better], m[better] = c.number, same[better]

        for c in self.clusters:
            meet(c, 0)
        texts, places, changing, at = [], [], [], 0
        while at < len(lines):
            new = most[at:] < n
            stop = at + int(new.argmax()) if new.any() else len(lines)
            settled = best[at:stop].tolist()
            texts += [self.clusters[k].text for k in settled]
            places += [self.clusters[k].places for k in settled]
            if stop < len(lines):
                tokens = [words[k] for k in codes[stop].tolist()]
                if best[stop] >= 0 and most[stop] / n >= self.threshold:
                    c = self.clusters[best[stop]]
                    c.widen(tokens)
                else:
                    c = Cluster(len(self.clusters), tokens, ids[stop])
                    self.clusters.append(c)
                    best[stop] = c.number
                texts.append(c.text)
                places.append(c.places)
                changing.append(stop)
                meet(c, stop + 1)
            at = stop + 1
        return best.tolist(), texts, places, changing


_EVENTS = pa.list_(pa.struct([("id", pa.int64()), ("line", pa.string())]))
_CHUNKS = pa.schema([("leaf", pa.string()), ("lo", pa.int64()), ("ids", pa.list_(pa.int64())), ("lines", pa.list_(pa.string())), ("head", _EVENTS)])
_CHUNKS_SQL = "leaf string, lo bigint, ids array<bigint>, lines array<string>, head array<struct<id:bigint,line:string>>"
_ROWS = pa.schema([("leaf", pa.string()), ("lo", pa.int64()), ("id", pa.int64()), ("number", pa.int32()), ("template", pa.string()), ("line", pa.string()), ("places", pa.string()), ("changing", pa.bool_())])
_ROWS_SQL = "leaf string, lo bigint, id bigint, number int, template string, line string, places string, changing boolean"


def _events(ids: list[int], lines: list[str], at: list[int]) -> list[dict]:
    return [{"id": ids[i], "line": lines[i]} for i in at]


def chunked(lines: DataFrame, threshold: float, size: int = CHUNK) -> DataFrame:
    """Lines (leaf, id, line) as chunks: leaf, lo (the first id), ids, lines, head.

    A range of (leaf, id) is a task, so a leaf is as many tasks as it has ranges.  head has the changing lines of
    a task's first chunk of a leaf, folded from nothing: the first guess at the log.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, ids, held, chars, heads = None, [], [], 0, True

        def chunk() -> pa.RecordBatch:
            head = _events(ids, held, Leaf(threshold).fold(held, ids)[3]) if heads else None
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((leaf, ids[0], ids, held, head), _CHUNKS)], schema=_CHUNKS)

        for batch in batches:
            for name, i, line in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if held and (name != leaf or len(held) >= size or chars + len(line) > CHUNK_CHARS):
                    yield chunk()
                    heads = name != leaf
                    ids, held, chars = [], [], 0
                leaf = name
                ids.append(i)
                held.append(line)
                chars += len(line)
        if held:
            yield chunk()

    ranged = lines.select("leaf", "id", "line").repartitionByRange("leaf", "id").sortWithinPartitions("leaf", "id")
    return ranged.mapInArrow(pack, _CHUNKS_SQL)


def refolded(candidates: DataFrame, threshold: float) -> DataFrame:
    """The lines (leaf, id, line) that change their leaf, folded in order: the log.  A leaf's candidates are a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return rows.iloc[Leaf(threshold).fold(rows["line"].tolist(), rows["id"].tolist())[3]]

    return candidates.groupBy("leaf").applyInPandas(run, "leaf string, id bigint, line string")


def folded(chunks: DataFrame, log: DataFrame, threshold: float) -> DataFrame:
    """Every line of chunks with its cluster's number, template and places of parameters at the time."""
    logs = log.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("log"))
    size = log.agg(F.sum(F.octet_length("line") + 16)).first()[0] or 0
    logs = F.broadcast(logs) if size <= SMALL else logs
    before = F.filter("log", lambda e: e["id"] < F.col("lo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, base = None, 0, Leaf(threshold)
        for batch in batches:
            for row in range(batch.num_rows):
                leaf, lo = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                ids, lines = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                log = batch.column(4)[row].values
                n = 0 if log is None else len(log)
                if leaf != now or n < known:
                    now, known, base = leaf, 0, Leaf(threshold)
                if n > known:  # chunks of a leaf often follow each other
                    more = log[known:].to_pylist()
                    base.fold([e["line"] for e in more], [e["id"] for e in more])
                    known = n
                numbers, texts, places, changing = base.copy().fold(lines, ids)
                marks = np.zeros(len(ids), bool)
                marks[changing] = True
                columns = [[leaf] * len(ids), [lo] * len(ids), ids, numbers, texts, lines, places, marks]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)

    return chunks.join(logs, "leaf", "left").select("leaf", "lo", "ids", "lines", before.alias("log")).mapInArrow(run, _ROWS_SQL)


def fold_leaves(lines: DataFrame, threshold: float, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(every line with its cluster at the time; leaf, number, template, first_id of the clusters at the end)."""
    chunks = written(chunked(lines, threshold, size), "chunks")
    guess = chunks.where("head is not null").select("leaf", F.inline("head"))
    log = written(refolded(guess, threshold), "log")
    todo, tables, edges = chunks, [], []

    def standing() -> DataFrame:
        """Lines of all rounds but those of chunks that later rounds ran again."""
        parts = []
        for i, table in enumerate(tables):
            if later := edges[i:]:
                limit = later[0]
                for e in later[1:]:
                    limit = limit.unionByName(e)
                limit = limit.groupBy("leaf").agg(F.min("edge").alias("edge"))
                table = table.join(limit, "leaf", "left").where("edge is null or lo <= edge").drop("edge")
            parts.append(table)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    while True:
        tables.append(written(folded(todo, log, threshold), "folded"))
        found = written(refolded(standing().where("changing").select("leaf", "id", "line"), threshold), "log")
        # a leaf's first line on which the logs differ: chunks that begin after it started from another state
        both = log.select("leaf", "id", F.lit(1).alias("n")).unionByName(found.select("leaf", "id", F.lit(-1).alias("n")))
        odd = both.groupBy("leaf", "id").agg(F.sum("n").alias("n")).where("n <> 0")
        edge = written(odd.groupBy("leaf").agg(F.min("id").alias("edge")), "edges")
        if edge.isEmpty():
            break
        log = found
        edges.append(edge)
        todo = chunks.join(edge, "leaf").where("lo > edge").drop("edge")
    return standing().drop("lo", "changing"), final_clusters(log, threshold)


def final_clusters(log: DataFrame, threshold: float) -> DataFrame:
    """leaf, number, template, first_id: the clusters that a log leaves."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        leaf = Leaf(threshold)
        leaf.fold(rows["line"].tolist(), rows["id"].tolist())
        return pd.DataFrame([(rows["leaf"].iloc[0], c.number, c.text, c.first) for c in leaf.clusters], columns=["leaf", "number", "template", "first_id"])

    return log.groupBy("leaf").applyInPandas(run, "leaf string, number int, template string, first_id bigint")
