"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring.  A document hashes to a place on the ring and belongs to the
next point clockwise; a shard takes at most (1 + slack) times the mean bytes, and documents past that
continue clockwise to the next shard with room.  The ring has 65536 segments, which are placed whole where
some shard has room for all of one, the heaviest first, so its plan is made from 65536 sums whatever the
number of documents; a segment of many documents that outweighs a 64th of a shard (one doc_id repeated), or
that fits nowhere, is cut at documents.  So a shard holds at most (1 + slack) times the mean, and a document.

Cases: a null text has size 1; null doc_ids share one place on the ring; repeated rows are placed as
often as they occur, equal rows next to each other; a document larger than a shard's share still goes
to one shard; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_of, tidy, written

SEGMENTS = 1 << 16


def ring_points(shards: int, points: int) -> list[tuple[int, int]]:
    """(segment, shard) of all virtual nodes, clockwise."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % SEGMENTS
    return sorted((place(s, v), s) for s in range(shards) for v in range(points))


def ring_plan(loads: dict[int, tuple[int, int]], shards: int, points: int, slack: float) -> list[tuple[int, int, int, int]]:
    """(segment, shard, from byte, to byte) from each segment's (bytes, documents).

    A segment goes to its own point's shard, or clockwise to the first shard that it fits into; heavy ones, and
    those that fit nowhere, fill up shards clockwise.  A single document is not cut: where it fits nowhere, it
    goes to the shard with most room.
    """
    ring = ring_points(shards, points)
    places = [p for p, _ in ring]
    limit = math.ceil((1 + slack) * sum(n for n, _ in loads.values()) / shards)
    room, plan = [limit] * shards, []

    @functools.cache
    def clockwise_from(at: int) -> tuple[int, ...]:
        return tuple(dict.fromkeys(ring[(at + v) % len(ring)][1] for v in range(len(ring))))

    for segment, (load, rows) in sorted(loads.items(), key=lambda x: (-x[1][0], x[0])):
        clockwise = clockwise_from(bisect.bisect_left(places, segment))
        fits = next((s for s in clockwise if room[s] >= load), None)
        if rows > 1 and (load * 64 > limit or fits is None):
            lo = 0
            for shard in clockwise:
                take = min(load - lo, max(0, room[shard]))
                if take:
                    plan.append((segment, shard, lo, lo + take))
                    room[shard] -= take
                    lo += take
            if lo < load:  # single documents have taken more than their shards had
                plan.append((segment, max(range(shards), key=room.__getitem__), lo, load))
            continue
        shard = max(range(shards), key=room.__getitem__) if fits is None else fits
        plan.append((segment, shard, 0, load))
        room[shard] -= load
    return plan


def shard_documents(docs: DataFrame, shards: int = 16, points: int = 128, slack: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for all documents; slots count from 0 within a shard.

    Shuffled are narrow rows only, by ranges of their places on the ring, so one place of many rows is dealt
    out like others; what is broadcast has a row per ring segment (and one more for each cut), or a row a
    task, whatever the input.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64("doc_id").alias("place"))
    rows = rows.withColumn("segment", F.shiftrightunsigned("place", 48).cast("int"))
    # rows in the order of their places, with the rows and bytes before each in its task, then in all
    order = ["segment", "place", "doc_id", "text_crc32", "size"]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parts_of(docs), *order, "tie").sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    names = ["doc_id", "size", "text_crc32", "segment", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bytes_ = 0, 0
        for b in batches:
            upto = bytes_ + np.cumsum(b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n + np.arange(b.num_rows)), pa.array(upto - b.column(1).to_numpy())], names=[*names, "row", "before"])
            n, bytes_ = n + b.num_rows, int(upto[-1]) if b.num_rows else bytes_

    ranked = written(dealt.select(names).mapInArrow(tidy(run), "doc_id bigint, size bigint, text_crc32 bigint, segment int, part int, row bigint, before bigint"), "ring")
    loads = ranked.groupBy("segment").agg(F.sum("size").alias("n"), F.count("*").alias("k")).orderBy("segment").collect()
    starts, at = {}, 0
    for r in loads:
        starts[r["segment"]] = at
        at += r["n"]
    plan = ring_plan({r["segment"]: (r["n"], r["k"]) for r in loads}, shards, points, slack)
    pieces = [(i, seg, shard, starts[seg] + lo, starts[seg] + hi) for i, (seg, shard, lo, hi) in enumerate(plan)]
    pieces = spark.createDataFrame(pieces or [(0, -1, 0, 0, 0)], "piece int, segment int, shard int, lo bigint, hi bigint")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    parts = ranked.groupBy("part").agg(F.count("*").alias("k"), F.sum("size").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("rows_base"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = ranked.join(F.broadcast(parts), "part").withColumn("row", F.col("rows_base") + F.col("row"))
    # a document belongs to the piece that its middle lies in
    placed = placed.withColumn("middle", F.expr("base + before + size div 2")).join(F.broadcast(pieces), "segment").where("middle >= lo and middle < hi")
    placed = written(placed.select("doc_id", "size", "text_crc32", "piece", "shard", "row"), "placed")
    # a piece's rows follow each other: slots are rows of the shard's earlier pieces, then places in the piece
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    so_far = Window.partitionBy("shard").orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = counts.select("shard", "piece", (F.sum("n").over(so_far) - F.col("n") - F.col("first")).alias("base"))
    out = placed.join(F.broadcast(base), ["shard", "piece"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("row")).alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    out = shard_documents(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes whole documents to path, a folder shard=N each, ordered by slot within files.

    Rows of one doc_id and text are numbered on both sides, so each gets a slot of its own.
    """
    key = F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    turn = lambda columns: F.row_number().over(Window.partitionBy(*columns).orderBy(columns[0]))
    where = shard_documents(docs, **options).select(F.col("doc_id").alias("__ws_id"), F.col("text_crc32").alias("__ws_crc"), F.col("size").alias("__ws_size"), "shard", "slot")
    where = where.withColumn("__turn", turn(["__ws_id", "__ws_crc", "__ws_size"]))
    own = docs.drop("shard", "slot").withColumn("__crc32", key).withColumn("__octets", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long"))
    own = own.withColumn("__nth", turn(["doc_id", "__crc32", "__octets"]))
    on = own["doc_id"].eqNullSafe(where["__ws_id"]) & (own["__crc32"] == where["__ws_crc"]) & (own["__octets"] == where["__ws_size"]) & (own["__nth"] == where["__turn"])
    out = own.join(where, on).drop("__ws_id", "__ws_crc", "__ws_size", "__turn", "__crc32", "__octets", "__nth")
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
