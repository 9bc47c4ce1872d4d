"""An approximate index for cosine search: inverted lists with product-quantised residuals.

Vectors are set to length one.  A bounded sample fits the lists' centroids and the codebooks; every vector is then
put into the list of its nearest centroid and keeps, besides its id, one byte for each part of what the centroid
leaves.  A query probes the lists whose centroids are nearest; a list's codes give distances by table look-ups; the
best candidates of all its lists are ranked again by their exact cosines, which a join by id with the store brings.

Lists are dealt out in blocks of bounded rows, so a list of very many vectors is many tasks; a query goes to each
block of the lists it probes and brings back a bounded number of candidates from each.  The centroids and
codebooks, whose size does not depend on the rows, are all that goes to every task.

The sample is taken by a hash of the id, so that an index can be built again; SAMPLE bounds it, and all rows
are indexed whatever it holds.  Recall against the exact scan is measured in the tests.  How many lists must be
probed depends on how much the vectors cluster; the defaults suit vectors that hardly do, where a query meets two thirds
of the rows, 16 bytes each instead of 64 floats.

Cases: null, empty and zero vectors, and those of another length than the sample's, are not indexed and, as
queries, find nothing; null ids are left out; repeated ids count each in the lists and once in a result; ties of
scores go to the smaller id; an empty store gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from .vectors import cosine

#: Vectors that centroids and codebooks are fitted on, at most; rows of a block of a list.
SAMPLE, BLOCK = 20_000, 100_000
_ROUNDS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def fitted(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids of x by Lloyd's rounds; an empty one moves to a vector that is far from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(_ROUNDS):
        d = _squared(x, c)
        own, far = d.argmin(1), np.argsort(-d.min(1), kind="stable")
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for place, empty in zip(far, np.flatnonzero(n == 0)):
            c[empty] = x[place]
    return c


@dataclass
class Quantiser:
    """Centroids of lists, and codebooks for the parts of residuals."""

    lists: np.ndarray
    books: np.ndarray  # parts x codes x length

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int, codes: int = 256, seed: int = 1) -> "Quantiser":
        x = _unit(x)
        c = fitted(x, lists, seed)
        rest = x - c[_squared(x, c).argmin(1)]
        return cls(c, np.stack([cls._book(p, codes, seed) for p in np.split(rest, parts, axis=1)]))

    @staticmethod
    def _book(part: np.ndarray, codes: int, seed: int) -> np.ndarray:
        book = fitted(part, codes, seed)
        return np.concatenate([book, np.repeat(book[:1], codes - len(book), 0)])  # a small sample has fewer

    @property
    def length(self) -> int:
        return self.lists.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, a byte a part) of each vector."""
        x = _unit(x)
        own = _squared(x, self.lists).argmin(1)
        rest = np.split(x - self.lists[own], len(self.books), axis=1)
        return own, np.stack([_squared(r, b).argmin(1) for r, b in zip(rest, self.books)], 1).astype(np.uint8)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each query."""
        return np.argsort(_squared(_unit(x), self.lists), axis=1, kind="stable")[:, :n]

    def distances(self, query: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query to the vectors of a list, from their codes."""
        rest = (_unit(query[None, :])[0] - self.lists[number]).reshape(len(self.books), 1, -1)
        tables = ((self.books - rest) ** 2).sum(2).astype(np.float32)
        return sum(t[codes[:, i]] for i, t in enumerate(tables))


def _matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the right length that are not zero, their rows) of a column of float lists."""
    rows, found = [], []
    for i, v in enumerate(column):
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else np.zeros(0)
        if len(x) == length and np.isfinite(x).all() and x.any():
            rows.append(i)
            found.append(x)
    return (np.stack(found) if found else np.zeros((0, length))), np.array(rows, np.int64)


@dataclass
class AnnIndex:
    quantiser: Quantiser | None
    rows: DataFrame  # id, list, block, codes

    @classmethod
    def build(cls, store: DataFrame, lists: int = 32, parts: int = 16, sample: int = SAMPLE, block: int = BLOCK, seed: int = 1) -> "AnnIndex":
        """An index of store (id, embedding); codes are written to the shared folder."""
        sound = store.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where("id is not null and size(embedding) > 0")
        # the rows of least hash: a bounded sample that does not depend on partitions
        seen = sound.select("embedding", F.xxhash64(F.lit(seed), "id").alias("h"), "id").orderBy("h", "id").limit(sample).select("embedding").collect()
        vectors = [np.array(r["embedding"], np.float64) for r in seen if None not in r["embedding"]]
        length = len(vectors[0]) if vectors else 0
        vectors = [v for v in vectors if len(v) == length and np.isfinite(v).all() and v.any()]
        if not vectors:
            return cls(None, sound.select("id", F.lit(0).alias("list"), F.lit(0).alias("block"), F.lit(b"").alias("codes")).where("false"))
        if length % parts:
            raise ValueError(f"{length} components cannot be cut into {parts} parts")
        quantiser = Quantiser.fit(np.stack(vectors), lists, parts, seed=seed)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, at = _matrix(b.column(1), length)
                own, codes = quantiser.encode(x)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "list", "codes"])

        coded = written(sound.mapInArrow(encode, "id bigint, list int, codes binary"), "codes")
        sizes = coded.groupBy("list").agg(F.count("*").alias("n"))
        # a row a list
        coded = coded.join(F.broadcast(sizes), "list")
        dealt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)).cast("int")
        return cls(quantiser, coded.select("id", "list", dealt.alias("block"), "codes"))

    def search(self, queries: DataFrame, store: DataFrame, limit: int = 10, probes: int = 22, keep: int = 100) -> DataFrame:
        """(query_id, id, score, rank): for each of queries (id, embedding) the best of the candidates in its lists.

        keep: candidates a query has in a block, and over all its lists, before their exact cosines are taken.
        """
        quantiser = self.quantiser
        asked = queries.select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).where("query_id is not null")
        if quantiser is None:
            return asked.where("false").select("query_id", F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, at = _matrix(b.column(1), quantiser.length)
                lists = quantiser.probes(x, probes)
                every = np.repeat(at, lists.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(every)), b.column(1).take(pa.array(every)), pa.array(lists.ravel(), pa.int32())], ["query_id", "vector", "list"])

        routed = asked.mapInArrow(route, "query_id bigint, vector array<double>, list int")
        blocks = self.rows.groupBy("list", "block").agg(F.count("*").alias("n")).select(F.col("list").alias("of"), F.col("block").alias("part"))
        # a row a block: one in BLOCK of the index's rows
        routed = routed.join(blocks, F.col("list") == F.col("of")).select("query_id", "vector", "of", "part")

        def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if len(left) and len(right):
                codes = np.frombuffer(b"".join(right["codes"]), np.uint8).reshape(len(right), -1)
                ids, number = right["id"].to_numpy(), int(right["list"].iloc[0])
                for query, vector in zip(left["query_id"], left["vector"]):
                    d = quantiser.distances(np.asarray(vector), number, codes)
                    best = np.argpartition(d, keep)[:keep] if len(d) > keep else np.arange(len(d))
                    found.append((np.full(len(best), query), ids[best], d[best]))
            q, i, d = (np.concatenate(c) for c in zip(*found))
            return pd.DataFrame({"query_id": q, "id": i, "distance": d.astype(np.float64)})

        near = routed.groupBy("of", "part").cogroup(self.rows.groupBy("list", "block")).applyInPandas(scan, "query_id bigint, id bigint, distance double")
        first = Window.partitionBy("query_id").orderBy("distance", "id")
        near = near.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
        near = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep).select("query_id", "id")
        # few candidates are brought to the store's vectors, which then stay where they are
        near = written(near, "near")
        near = F.broadcast(near) if near.count() <= 1_000_000 else near
        exact = store.select("id", "embedding").join(near, "id").join(asked, "query_id")
        scored = exact.select("query_id", "id", cosine(F.col("embedding"), F.col("vector")).alias("score")).where("score is not null")
        scored = scored.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)

    def scanned(self, queries: DataFrame, probes: int = 22) -> float:
        """The share of the index's rows that queries meet, on average."""
        if self.quantiser is None:
            return 0.0
        sizes = {r["list"]: r["count"] for r in self.rows.groupBy("list").count().collect()}
        quantiser, total = self.quantiser, sum(sizes.values())

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, _ = _matrix(b.column(0), quantiser.length)
                n = [sum(sizes.get(c, 0) for c in row) for row in quantiser.probes(x, probes).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

        mean = queries.select(F.col("embedding").cast("array<double>")).mapInArrow(count, "n bigint").agg(F.avg("n")).first()[0]
        return (mean or 0.0) / max(total, 1)
