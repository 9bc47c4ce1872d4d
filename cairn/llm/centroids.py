"""k-means over integer vectors with Hamerly's bounds, exact in every round.

A state table has a row a vector: its integers, its centroid, an upper bound of the distance to that centroid
and a lower bound of the distance to any other.  A round reads the state, loosens the bounds by how far the
centroids moved, and leaves a vector where it is while the upper bound stays below the lower one, or below
half the way to the next centroid.  Else its own distance is computed, and if that does not settle it, all
distances in exact integers.  The new state goes to the shared folder, and the round before it is removed; with
it go, a row a task and centroid, the sums and counts of the vectors that changed, from which the driver has
the new centroids.  Bounds are floats and only ever decide that nothing changes, with a margin far above their
rounding; assignments, sums and centroids are integers, so the result is that of a full scan.

A cluster may hold any share of the vectors: they are never gathered, only summed inside tasks.

Cases: vectors of another length, with a null or non-finite component, or null, are left out, and so are those
with a component of 2^17 or more in size, whose squared distances would not fit a long; repeated ids and
vectors each count; a null vec_id has the text of "null" in its hash; ties of hashes are broken by the
vector's integers; with fewer vectors than centroids each vector starts one; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import new_path
from .common import bound_batches, tidy, written

LENGTH, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components are below this in size before scaling, so that 64 squared differences fit into a long.
_LARGEST = float(1 << 17)
#: Below this size of integers, products and sums of floats are exact.
_FLOATS = 1 << 20
#: What bounds must differ by, relative to their size; rounding is some 1e-15 a round.
_MARGIN = 1e-9
_STATE_SQL = "vec_id bigint, v array<int>, cluster int, upper double, lower double, scanned int, total array<bigint>, n bigint"
_STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("scanned", pa.int32()), ("total", pa.list_(pa.int64())), ("n", pa.int64())])


def integers(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * component) as int, of the vectors that are kept."""
    x = F.col(column).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LARGEST))
    kept = vectors.where((F.size(column) == length) & sound)
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the k smallest sha256 of seed:vec_id, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x by rows of c) of integer vectors."""
    if len(x) and max(np.abs(x).max(), np.abs(c).max()) < _FLOATS:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(x) else np.zeros((0, len(c)), np.int64)


def to_own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to its row of c."""
    return ((x - c) ** 2).sum(1)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, upper, lower) by all distances; ties go to the smaller number."""
    d = squared(x, c)
    best = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(x)), best].astype(np.float64))
    if len(c) == 1:
        return best, upper, np.full(len(x), np.inf)
    others = d.copy()
    others[np.arange(len(x)), best] = np.iinfo(np.int64).max
    return best, upper, np.sqrt(others.min(1).astype(np.float64))


class Move:
    """How centroids moved, and what that does to bounds."""

    def __init__(self, before: np.ndarray, now: np.ndarray):
        self.now, k = now, len(now)
        self.drift = np.sqrt(to_own(now, before).astype(np.float64))
        order = np.argsort(self.drift)
        # of the others' moves the largest counts
        self.others = np.full(k, self.drift[order[-1]])
        if k > 1:
            self.others[order[-1]] = self.drift[order[-2]]
        gaps = np.sqrt(squared(now, now).astype(np.float64))
        np.fill_diagonal(gaps, np.inf)
        self.half = gaps.min(1) / 2

    def apply(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(centroid, upper, lower) after the move, and how many vectors got a full scan."""
        own, upper, lower = own.copy(), upper + self.drift[own], np.maximum(lower - self.others[own], 0.0)
        safe = np.maximum(lower, self.half[own]) * (1 - _MARGIN)
        open_ = np.flatnonzero(upper * (1 + _MARGIN) >= safe)
        if len(open_):
            upper[open_] = np.sqrt(to_own(x[open_], self.now[own[open_]]).astype(np.float64))
            open_ = open_[upper[open_] * (1 + _MARGIN) >= safe[open_]]
        if len(open_):
            own[open_], upper[open_], lower[open_] = scan(x[open_], self.now)
        return own, upper, lower, len(open_)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    """A batch's vectors as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, length = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * length), pa.array(x.ravel(), kind))


def _stepped(change: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """State rows with change applied to (vectors, centroid, upper, lower), then the task's sums of changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), len(batch.column(1)[0]))
            was, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            own, upper, lower, scanned = change(x, was.astype(np.int64), upper, lower)
            moved = np.flatnonzero(own != was)
            for sign, side in ((1, own), (-1, was)):
                for c in np.unique(side[moved]):
                    if c >= 0:
                        at = moved[side[moved] == c]
                        s = sums.setdefault(int(c), [np.zeros(x.shape[1], np.int64), 0])
                        s[0] += sign * x[at].sum(0)
                        s[1] += sign * len(at)
            n = len(x)
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.int32())), pa.array(own, pa.int32()), pa.array(upper), pa.array(lower), pa.array(np.full(n, scanned), pa.int32()), none, pa.nulls(n, pa.int64())], schema=_STATE)
        if sums:
            k = sorted(sums)
            total = _lists(np.stack([sums[c][0] for c in k]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.list_(pa.int32())), pa.array(k, pa.int32()), *[pa.nulls(len(k), pa.float64())] * 2, pa.nulls(len(k), pa.int32()), total, pa.array([sums[c][1] for c in k], pa.int64())], schema=_STATE)

    return tidy(run)


class _State:
    """The state table of the last round; the one before it is removed when the next is whole."""

    def __init__(self, vectors: DataFrame, k: int):
        self.spark, self.path = vectors.sparkSession, None
        none = [F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")]
        self.rows = vectors.select("vec_id", "v", *none)
        self.total, self.n = None, [0] * k

    def step(self, change: Callable, number: int) -> None:
        path = new_path(self.spark, f"bounds-{number}")
        self.rows.mapInArrow(_stepped(change), _STATE_SQL).write.parquet(path)
        table = self.spark.read.schema(_STATE_SQL).parquet(path)
        self.rows = table.where("n is null").select("vec_id", "v", "cluster", "upper", "lower")
        # a row a task and centroid, summed by Spark to one a centroid
        sums = table.where("n is not null").select("cluster", F.posexplode("total").alias("i", "x"), "n")
        got = sums.groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        for r in got:
            self.total[r["cluster"]][r["i"]] += r["x"]
            if r["i"] == 0:
                self.n[r["cluster"]] += r["n"]
        if self.path is not None:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.path = path


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_column: str = "vec_id", column: str = "embedding", length: int = LENGTH, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance of every kept vector; the centroids that they were assigned to at last)."""
    bound_batches(vectors.sparkSession)
    kept = written(integers(vectors, id_column, column, length, scale), "vectors")
    now = first_centroids(kept, k, seed)
    if not len(now):
        return kept.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    state = _State(kept, len(now))
    state.total = [[0] * length for _ in now]

    def begin(x, own, upper, lower, c=now):
        return *scan(x, c), len(x)

    state.step(begin, 0)
    for number in range(1, rounds + 1):
        before = now
        now = np.array([[t // n for t in total] if n else row.tolist() for total, n, row in zip(state.total, state.n, before)], np.int64)
        state.step(Move(before, now).apply, number)

    def distances(batches: Iterator[pa.RecordBatch], c=now) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(to_own(_matrix(b.column(1), length), c[own]), pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return state.rows.select("vec_id", "v", "cluster").mapInArrow(tidy(distances), "vec_id bigint, v array<int>, cluster int, distance bigint"), now


def hashed(centroid: list[int]) -> str:
    """Lowercase hex sha256 of the components joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = cluster(vectors)
    found = written(found.select("vec_id", "cluster", "distance"), "assigned")
    # a row a centroid
    sums = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    facts = [(i, int(sums.get(i, 0)), int(sum(sums.values())), hashed(c.tolist())) for i, c in enumerate(centroids)]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
