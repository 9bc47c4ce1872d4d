"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, phrases into longer ones, and so on.  A level first names runs of one
symbol, then labels each symbol by deterministic coin tossing against its left neighbour (twice the
lowest differing bit, plus that bit), twice over, so labels are few and neighbours differ; a phrase
starts at each local maximum of the labels.  Whether it does depends on a few symbols around it only,
so equal substrings are parsed alike, but for their ends, wherever they stand.  A phrase's name is a
hash of its symbols.

The fingerprint is two minima sketches of a text's names, repeats numbered: 64 bins of those of the levels from
two up, and 16 bins of level one for texts too short to have many others; a bin holds 16 bits of the name
with the least 48-bit hash, in hex, 'zzzz' for an empty bin, so unrelated texts hardly ever agree in one,
however long they are.  The likeness of two fingerprints is the part of the bins filled in either that agree.

Cases: a null text is empty, and its fingerprint is all empty bins; two such are alike (1.0); repeated
rows follow each other, equal doc_ids ordered by their texts' xxhash64, null doc_ids first; a single row is its own next
document; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bound_batches, parts_of, tidy

BINS, SHORT_BINS, LEVELS = 64, 16, 12
#: With fewer filled bins than this, level one's bins count too.
FEW = 12
EMPTY = "zzzz"
_STEP = 400_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.array([16] + [(i & -i).bit_length() - 1 for i in range(1, 1 << 16)], np.uint8)
#: Odd multipliers for a phrase's places; longer phrases use them again.
_PLACE = np.array([int.from_bytes(hashlib.blake2b(f"place {i}".encode(), digest_size=8).digest(), "big") | 1 for i in range(64)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _toss(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: labels under twice the bits of a; a text's first symbol is labelled by its low bit."""
    low = np.empty(len(a), np.uint8)
    low[0] = 0
    low[1:] = _LOW[a[1:] ^ a[:-1]]
    low[first] = 0
    return (low << 1) | ((a >> np.minimum(low, 15)) & 1).astype(np.uint8)


def parse(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: (phrase names, their texts) of names in order, texts one after another."""
    n = len(names)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(doc[1:], doc[:-1], out=new[1:])
    # runs
    head = new.copy()
    head[1:] |= names[1:] != names[:-1]
    if not head.all():
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, n)).astype(np.uint64)
        names = np.where(length > 1, _mix(names[at] + length * _M2), names[at])
        doc, new, n = doc[at], new[at], len(at)
    first = np.flatnonzero(new)
    one = _toss((names & np.uint64(0xFFFF)).astype(np.uint16), first)
    two = _toss(one.astype(np.uint16), first)
    # local maxima: greater than the left label, not less than the right one, ties to the left
    start = new.copy()
    if n > 2:
        start[1:-1] |= (two[1:-1] > two[:-2]) & (two[1:-1] >= two[2:])
    # a text's first and last phrases have two symbols at least, so no neighbour text is looked at
    start[first[first + 1 < n] + 1] = False
    start[np.append(first[1:], n) - 1] = False
    start[first] = True
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, size)
    out = np.add.reduceat(_mix(names) * _PLACE[place & 63], at)
    return _mix(out + size.astype(np.uint64)), doc[at]


def _numbered(names: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Names made distinct within a text: an occurrence after the first is named by its number too."""
    key = names ^ _mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    head = np.append(True, key[order][1:] != key[order][:-1])
    begin = np.flatnonzero(head)
    number = np.empty(len(names), np.uint64)
    number[order] = np.arange(len(names)) - np.repeat(begin, np.diff(np.append(begin, len(names))))
    return np.where(number > 0, _mix(names + number * _M2), names)


def _minima(keys: np.ndarray, doc: np.ndarray, texts: int, bins: int) -> np.ndarray:
    """(texts, bins) uint64: least 48-bit hash of the names in each bin; 1 << 48 where there is none."""
    out = np.full(texts * bins, 1 << 48, np.uint64)
    if len(keys):
        h = _mix(keys ^ _M1)
        np.minimum.at(out, doc * bins + (h >> np.uint64(48)).astype(np.int64) % bins, h & np.uint64((1 << 48) - 1))
    return out.reshape(texts, bins)


def sketches(texts: list[str]) -> np.ndarray:
    """(texts, BINS + SHORT_BINS) uint32 sketches of each text: 16 bits, or 1 << 16 for an empty bin."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > _STEP or i == len(texts) - 1:
            out.append(_sketches(texts[lo : i + 1]))
            lo, size = i + 1, 0
    return np.concatenate(out) if out else np.zeros((0, BINS + SHORT_BINS), np.uint32)


def _sketches(texts: list[str]) -> np.ndarray:
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    short = _minima(np.zeros(0, np.uint64), doc[:0], len(texts), SHORT_BINS)
    main = _minima(np.zeros(0, np.uint64), doc[:0], len(texts), BINS)
    for level in range(1, LEVELS + 1):
        if not len(names):
            break
        names, doc = parse(names, doc)
        if level == 1:
            short = _minima(names, doc, len(texts), SHORT_BINS)
        else:
            np.minimum(main, _minima(_numbered(names, doc) + np.uint64(level), doc, len(texts), BINS), out=main)
    least = np.concatenate([main, short], axis=1)
    return np.where(least == 1 << 48, 1 << 16, least & np.uint64(0xFFFF)).astype(np.uint32)


def to_text(sketch: np.ndarray) -> list[str]:
    """Fingerprint strings of sketches."""
    return ["".join(EMPTY if v > 0xFFFF else f"{v:04x}" for v in row) for row in sketch.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the likeness of two arrays of sketches."""
    filled = (a <= 0xFFFF) | (b <= 0xFFFF)
    same = (a == b) & filled
    main, agree = filled[:, :BINS].sum(1), same[:, :BINS].sum(1)
    few = main < FEW
    n = main + np.where(few, filled[:, BINS:].sum(1), 0)
    k = agree + np.where(few, same[:, BINS:].sum(1), 0)
    return np.where((a == b).all(1), 1.0, k / np.maximum(n, 1))


def from_text(fingerprint: str) -> np.ndarray:
    return np.array([1 << 16 if fingerprint[i : i + 4] == EMPTY else int(fingerprint[i : i + 4], 16) for i in range(0, len(fingerprint), 4)], np.uint32)


def edited(text: str, other: str) -> str:
    """text with its last third (rounded down) replaced by as much of other's beginning."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text, in the scan's own tasks."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = to_text(sketches([t or "" for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, fingerprint string")


DIGEST = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _place(doc_id, key: int) -> tuple:
    return doc_id is not None, doc_id or 0, key


class Ranges:
    """Where each range of (doc_id, key) begins and ends; ranges may begin and end inside equal places."""

    def __init__(self, ends: list[tuple[tuple, tuple]]):
        """ends: (first place, last place) of each range, in order; none of the ranges is empty."""
        self.first, self.last = [a for a, _ in ends], [b for _, b in ends]

    def of(self, place: tuple, turn: int) -> int:
        """The range of a place; rows of one place that several ranges share are dealt out to them by turns."""
        lo, hi = bisect.bisect_left(self.first, place), bisect.bisect_right(self.first, place)
        lo -= lo > 0 and self.last[lo - 1] >= place
        return lo + turn % max(1, hi - lo)

    def guests(self) -> list[tuple]:
        """(doc_id, key, range) of the row before each range, where it differs from the range's first."""
        before = [(self.last[i - 1], i) for i in range(len(self.first))]
        return [(p[1] if p[0] else None, p[2], i) for p, i in before if p != self.first[i]]


def ranges_of(rows: DataFrame) -> Ranges:
    """About equal ranges of rows (doc_id, key), as many as the scan has tasks; a line of each reaches the driver."""
    tied = rows.select("doc_id", "key", F.monotonically_increasing_id().alias("tie"))
    ranged = tied.repartitionByRange(parts_of(rows), F.asc_nulls_first("doc_id"), "key", "tie").withColumn("part", F.spark_partition_id())
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "key")
    ends = ranged.groupBy("part").agg(F.min(place).alias("a"), F.max(place).alias("b")).orderBy("part").collect()
    return Ranges([(tuple(r["a"]), tuple(r["b"])) for r in ends])


def digest(docs: DataFrame) -> DataFrame:
    """Every text, and the text edited with the next document (descending doc_id, then the first).

    Texts are dealt out by ranges of doc_id in one shuffle, a range a task; each range also gets the row
    before it as a guest, so a row's next document is the row before it in its own task.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    ranges = ranges_of(docs.select("doc_id", "key"))
    if not ranges.first:
        return spark.createDataFrame([], DIGEST)
    shared = spark.sparkContext.broadcast(ranges)  # a line for each task

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            places = map(_place, b.column(0).to_pylist(), b.column(2).to_pylist())
            parts = pa.array([shared.value.of(p, turn + i) for i, p in enumerate(places)], pa.int32())
            turn += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, parts, pa.array([True] * b.num_rows)], names=["doc_id", "text", "key", "part", "own"])

    own = docs.mapInArrow(tidy(deal), "doc_id bigint, text string, key bigint, part int, own boolean")
    asked = spark.createDataFrame(ranges.guests(), "id bigint, hash bigint, part int")
    guests = docs.join(F.broadcast(asked), docs["doc_id"].eqNullSafe(asked["id"]) & (docs["key"] == asked["hash"])).dropDuplicates(["part"])
    rows = own.unionByName(guests.select("doc_id", "text", "key", "part", F.lit(False).alias("own")))
    dealt = rows.repartitionById(len(ranges.first), F.col("part")).sortWithinPartitions("part", "own", F.asc_nulls_first("doc_id"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, before_sketch = None, None  # without a guest the range's first row follows an equal one
        for b in batches:
            ids, texts, own = (b.column(i).to_pylist() for i in range(3))
            if not ids:
                continue
            sk = sketches(texts)
            prev_t = [texts[0] if before is None else before, *texts[:-1]]
            prev_s = np.concatenate([sk[:1] if before is None else before_sketch[None], sk[:-1]])
            mine = np.flatnonzero(np.array(own, bool))
            if len(mine):
                new = [edited(texts[i], prev_t[i]) for i in mine.tolist()]
                es = sketches(new)
                prints, eprints = to_text(sk[mine]), to_text(es)
                near, nxt = likeness(sk[mine], es), likeness(sk[mine], prev_s[mine])
                out = [(ids[i], len(texts[i]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), p, q, float(x), float(y)) for i, e, p, q, x, y in zip(mine.tolist(), new, prints, eprints, near, nxt)]
                yield from batches_of(out, _DIGEST)
            before, before_sketch = texts[-1], sk[-1]

    return dealt.select("doc_id", "text", "own").mapInArrow(tidy(run), DIGEST)
