"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has bit b set if over half of its word shingles' XXH64 hashes have it.  Equal
fingerprints form one class, so copies cost one row.  Classes that share a key (two of five blocks of
the 64 bits; at most three differing bits leave two blocks equal) meet in one bucket.  There the
Hamming distances of every fingerprint to many reference fingerprints (pivots) are tabled; by the
triangle inequality a pair differs by at least its greatest coordinate difference, so rows are sorted by
the first coordinate, pairs with a coordinate difference over the radius are discarded, and survivors
are verified on the fingerprints.  The keys only deal classes out to tasks: with distances alone, 64-bit
fingerprints of unrelated texts lie too close to each pivot to be dealt out by them.

A bucket with more classes than a task should hold is dealt out as pairs of slices, so every pair of it
still meets once.  Buckets give spanning edges, not pairs; components come from star contraction.

similar_documents is the wider form: it links texts where the Jaccard likeness of their five-word shingles
is 0.8 or more.  Texts with equal sets of shingles form one class; its fingerprint is 128 bits of the set.
At the distances that such a likeness stands for no few blocks stay equal, so the keys that deal classes
out are bands of least hash values: three values of the set under different hash functions make a key, and
of sixteen keys a pair of likeness 0.8 shares one with a probability of 0.99999, whatever the number of
classes.  In a bucket the pivot table discards and fingerprints decide who is near, up to four standard
deviations over the distance that 0.8 stands for.  A bucket gives the edges of a least spanning forest of
the near pairs; these only gather families.  In a family all pairs are compared by their whole shingle
sets, and only pairs of likeness 0.8 or more become links.

Cases: a null text has no words and, like any text without words, fingerprint zero; fewer words than a
shingle make one shingle; null doc_ids come after all others in a group; repeated rows are members like
others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, parts_of, small, tidy, written
from .components import components

WIDTH, RADIUS, SEED = 3, 3, 42
#: Pivots of a distance table, and classes of a bucket that one task compares.
PIVOTS, SLICE = 48, 4096
#: (first bit, bits) of the five blocks; a key is the bits of two of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def pivots(n: int = PIVOTS, words: int = 1) -> np.ndarray:
    """The (n, words) reference fingerprints: hashes of their ordinals."""
    return np.array([[xxhash.xxh64_intdigest(f"pivot {i}/{w}", seed=SEED) for w in range(words)] for i in range(n)], np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def shingle_hashes(text: str | None, width: int = WIDTH) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    return [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]


def _spread(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words) hashes from one: itself, then its mixtures with fixed numbers."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for w in range(1, words):
        x = (h ^ np.uint64(w)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        out[:, w] = x ^ (x >> np.uint64(32))
    return out


def majorities(hashes: np.ndarray, counts: list[int], words: int = 1) -> np.ndarray:
    """(texts, words) uint64: bit b is 1 if set in over half of a text's hashes; zero without any."""
    out = np.zeros((len(counts), words), np.uint64)
    wide = _spread(hashes, words)
    bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(wide), -1), axis=1)
    at = 0
    for k, n in enumerate(counts):
        if n:
            ones = np.add.reduce(bits[at : at + n], axis=0, dtype=np.int32)
            out[k] = np.packbits(2 * ones > n).view(">u8")
            at += n
    return out


def _some_at_a_time(texts: list, hashes_of, most: int) -> Iterator[tuple[np.ndarray, list[int]]]:
    """(hashes of some texts in a row, how many of each); about most hashes, or one text's."""
    held: list[np.ndarray] = []
    total = 0
    for i, t in enumerate(texts):
        held.append(np.asarray(hashes_of(t), np.uint64))
        total += len(held[-1])
        if total > most or i == len(texts) - 1:
            yield np.concatenate(held), [len(h) for h in held]
            held, total = [], 0


def fingerprints_of(texts: list, width: int = WIDTH) -> np.ndarray:
    """(texts, 1) uint64 fingerprints; bit b counts from the least significant."""
    parts = [majorities(h, n) for h, n in _some_at_a_time(texts, lambda t: shingle_hashes(t, width), 200_000)]
    return np.concatenate(parts) if parts else np.zeros((0, 1), np.uint64)


def fingerprint_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, a hash of each whole text, and its fingerprint (signed)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = fingerprints_of(b.column(1).to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(fps[:, 0])], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(tidy(run), "doc_id bigint, text_hash bigint, fp bigint")


def _columns(words: int) -> list[str]:
    return ["fp", *(f"fp{w}" for w in range(1, words))]


class Forest:
    """Union-find over positions; keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        # pairs whose ends are already in one tree go quickly
        for _ in range(64):
            roots = self.up[self.up]
            if np.array_equal(roots, self.up):
                break
            self.up = roots
        apart = self.up[a] != self.up[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            rx, ry = self.find(x), self.find(y)
            if rx != ry:
                self.up[max(rx, ry)] = min(rx, ry)
                self.edges.append((x, y))


def linked(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS, refs: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges (positions) of the pairs of (n, words) fingerprints within radius that share a bucket number."""
    refs = pivots(words=fps.shape[1]) if refs is None else refs
    first = distance(fps, refs[0])
    _, dense = np.unique(bucket, return_inverse=True)
    # one sorted key: a window of rows of the same bucket with a near enough first coordinate
    key = dense.astype(np.int64) * 4096 + first
    order = np.argsort(key, kind="stable")
    key, fps = key[order], fps[order]
    span = np.searchsorted(key, key + radius, "right") - np.arange(len(fps)) - 1
    forest, n, at, step = Forest(len(fps)), len(fps), 0, 1 << 19
    done = np.concatenate([[0], np.cumsum(span)])
    while at < n:
        upto = max(at + 1, int(np.searchsorted(done, done[at] + step, "right")) - 1)
        width = span[at:upto]
        a = np.repeat(np.arange(at, upto), width)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)
        for p in refs[1:]:  # the table's other coordinates, while they still discard many pairs
            if len(a) < 64:
                break
            top = int(b.max()) + 1
            d = distance(fps[at:top], p)
            keep = np.abs(d[a - at] - d[b - at]) <= radius
            before = len(a)
            a, b = a[keep], b[keep]
            if len(a) > 0.7 * before:
                break
        apart = distance(fps[a], fps[b])
        keep = np.flatnonzero(apart <= radius)
        keep = keep[np.argsort(apart[keep], kind="stable")]  # nearest first
        forest.join(a[keep], b[keep])
        at = upto
    return [(int(order[x]), int(order[y])) for x, y in forest.edges]


def _keys() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(BLOCKS)) for j in range(i)]


def link_classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fp: each two within radius are connected by them."""

    def block(i: int):
        first, bits = BLOCKS[i]
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))

    pairs = [F.shiftleft(F.shiftleft(block(i), 13).bitwiseOR(block(j)), 4).bitwiseOR(F.lit(k)) for k, (i, j) in enumerate(_keys())]
    return _link_buckets(fps.select(F.explode(F.array(*pairs)).alias("bucket"), F.col("fp").alias("node"), "fp"), 1, radius, parts_of(fps))


def _link_buckets(keyed: DataFrame, words: int, radius: int, n_parts: int) -> DataFrame:
    """Edges between nodes of (bucket, node, fp…) that share a bucket and lie within radius."""
    names = _columns(words)
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    big = written(sizes.where(f"n > {SLICE}").select("bucket", F.expr(f"cast((n + {SLICE} - 1) div {SLICE} as int)").alias("slices")), "big")
    rows = keyed.select(F.col("bucket").alias("grp"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node", *names)
    n_big = big.count()
    if n_big:
        # a row of a large bucket goes to every pair of slices that has its own, so all its pairs meet
        few = F.broadcast(big) if n_big <= 100_000 else big
        own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int")
        other = keyed.join(few, "bucket").withColumns({"own": own}).withColumn("other", F.explode(F.expr("sequence(0, slices - 1)")))
        dealt = other.select(F.col("bucket").alias("grp"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", *names)
        rows = rows.join(few, rows["grp"] == big["bucket"], "left_anti").unionByName(dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, held = pivots(words=words), None

        def out(grp, lo, hi, node, *fp) -> pa.RecordBatch:
            new = np.append(True, (grp[1:] != grp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            edges = linked(np.cumsum(new), np.stack(fp, axis=1).view(np.uint64), radius, refs)
            u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], names=["u", "v"])

        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(4 + words)]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            if not len(cols[0]):
                continue
            # the last bucket may go on in the next batch
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            if (~same).any():
                yield out(*[c[~same] for c in cols])
            held = [c[same] for c in cols]
        if held is not None and len(held[0]):
            yield out(*held)

    dealt = rows.repartition(n_parts, "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
    return dealt.mapInArrow(tidy(run), "u bigint, v bigint")


def _first_row():
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))


def _classes(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints: node and fp (equal), the first row of each, and its rows."""
    counted = prints.groupBy("fp").agg(_first_row().alias("first"), F.count("*").alias("rows"))
    return written(counted.select(F.col("fp").alias("node"), "fp", "first", "rows"), "classes")


def _groups(classes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node and component of all classes, component and first row of all groups)."""
    found = components(edges, "links")
    named = classes.select("node", "first").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first")
    return named.select("node", "component"), named.groupBy("component").agg(F.min("first").alias("first"))


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups) of links between fingerprints at RADIUS: every row's doc_id, fp and component_id,
    and each group's first row.

    component_id is the least doc_id that links reach; a group's first row has the least doc_id, then
    the least text_hash.
    """
    prints = written(fingerprint_documents(docs), "prints")
    classes = _classes(prints)
    named, groups = _groups(classes, link_classes(classes.select("fp")))
    by_class = named.join(groups, "component").select(F.col("node").alias("fp"), F.col("first.doc_id").alias("component_id"))
    return prints.join(by_class, "fp").select("doc_id", "fp", "component_id"), groups.select("first.doc_id", "first.text_hash")


def fingerprint_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As similar_documents, by links between fingerprints at RADIUS."""
    prints = written(fingerprint_documents(docs), "prints")
    classes = _classes(prints)
    rows = prints.select("doc_id", "text_hash", F.col("fp").alias("node"))
    return rows, _others(rows, classes, link_classes(classes.select("fp")))


#: The wider form: words of a fingerprint, shingle width, likeness; keys, and least values in each.
WIDE, WIDE_WIDTH, LIKENESS, BANDS, BAND = 2, 5, 0.8, 16, 3
#: Near are pairs up to so many standard deviations over the distance that LIKENESS stands for.
MARGIN = 4.0
#: Classes, and shingles, of a family's slice; shingles of more sets than RARE are counted by matrix products.
FAMILY, FAMILY_SHINGLES, RARE = 512, 500_000, 8
_FACTORS = np.array([xxhash.xxh64_intdigest(f"least {i}", seed=SEED) | 1 for i in range(BANDS * BAND)], np.uint64)


def differing(likeness: float) -> float:
    """The part of bits in which fingerprints of sets of a Jaccard likeness differ."""
    return math.acos(2 * likeness / (1 + likeness)) / math.pi


def wide_radius(likeness: float = LIKENESS, words: int = WIDE) -> int:
    p, n = differing(likeness), 64 * words
    return round(n * p + MARGIN * math.sqrt(n * p * (1 - p)))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, ascending."""
    return np.unique(np.array(shingle_hashes(text, WIDE_WIDTH), np.uint64))


def bands_of(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """(texts, BANDS) uint64 keys of sets that follow each other; texts without shingles have zeros."""
    size = np.array(counts)
    full = np.flatnonzero(size)
    starts = (np.cumsum(size) - size)[full]
    out = np.zeros((len(counts), BANDS), np.uint64)
    for j in range(BANDS if len(full) else 0):
        key = np.full(len(full), j, np.uint64)
        for factor in _FACTORS[j * BAND : (j + 1) * BAND]:
            key ^= np.minimum.reduceat(hashes * factor, starts)
            key *= np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[full, j] = key
    return out


_SKETCH = "doc_id bigint, text_hash bigint, node bigint, filled boolean, fp bigint, fp1 bigint, bands binary"


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, a hash of the set of shingles (node), its fingerprint and its bands."""
    bound_batches(docs.sparkSession)
    names = [x.split()[0] for x in _SKETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for hashes, counts in _some_at_a_time(b.column(1).to_pylist(), shingle_set, 100_000):
                fps, bands = majorities(hashes, counts, WIDE).view(np.int64), bands_of(hashes, counts).astype("<u8")
                cuts = np.cumsum(counts)
                nodes = np.array([xxhash.xxh3_64_intdigest(hashes[c - n : c].tobytes()) for c, n in zip(cuts.tolist(), counts)], np.uint64)
                part = b.slice(at, len(counts))
                at += len(counts)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), pa.array(nodes.view(np.int64)), pa.array(np.array(counts) > 0), *(pa.array(np.ascontiguousarray(fps[:, w])) for w in range(WIDE)), pa.array([x.tobytes() for x in bands], pa.binary())], names=names)

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(tidy(run), _SKETCH)


def similar_classes(sketches: DataFrame) -> DataFrame:
    """Distinct sets of shingles: node, fp, fp1, bands, filled, the first row of each, and its rows."""
    same = [F.first(c).alias(c) for c in ("filled", "fp", "fp1", "bands")]
    return written(sketches.groupBy("node").agg(*same, _first_row().alias("first"), F.count("*").alias("rows")), "classes")


def link_similar(classes: DataFrame) -> DataFrame:
    """Spanning edges of the classes that share a key and whose fingerprints are near."""
    keys = F.array(*[F.conv(F.hex(F.substring("bands", 8 * j + 1, 8)), 16, -10).cast("bigint") for j in range(BANDS)])
    keyed = classes.where("filled").select(F.explode(keys).alias("bucket"), "node", "fp", "fp1")
    return _link_buckets(keyed, WIDE, wide_radius(), 2 * parts_of(classes))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) numbers of common elements of sets without repeats; only above the diagonal."""
    n = len(sets)
    row, value = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    held = count[column]
    out = np.zeros((n, n), np.int64)
    # elements of few sets by their pairs, of many by products of 0-1 matrices
    rare = (held > 1) & (held <= RARE)
    r, v = row[rare], value[rare]
    for lag in range(1, RARE):
        same = np.flatnonzero(v[lag:] == v[:-lag])
        if not len(same):
            break
        out += np.bincount(r[same] * n + r[same + lag], minlength=n * n).reshape(n, n)
    often = held > RARE
    r, _c = row[often], column[often]
    c = np.unique(_c, return_inverse=True)[1]
    for lo in range(0, int(c.max()) + 1 if len(c) else 0, 1024):
        at = slice(*np.searchsorted(c, (lo, lo + 1024)))
        block = np.zeros((n, 1024), np.float32)
        block[r[at], c[at] - lo] = 1
        out += np.triu(block @ block.T, 1).astype(np.int64)
    return out


def alike(sets: list[np.ndarray], trees: np.ndarray, likeness: float = LIKENESS) -> list[tuple[int, int]]:
    """Spanning edges (positions) of the pairs of different trees whose Jaccard likeness is at least likeness."""
    size = np.array([len(s) for s in sets])
    common = overlaps(sets)
    a, b = np.nonzero(common)
    ratio = common[a, b] / (size[a] + size[b] - common[a, b])
    keep = np.flatnonzero((ratio >= likeness) & (trees[a] != trees[b]))
    keep = keep[np.argsort(-ratio[keep], kind="stable")]
    forest = Forest(len(sets))
    forest.join(a[keep], b[keep])
    return forest.edges


def shingle_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, component, size, hashes): the distinct shingle hashes of the texts of members' first rows.

    Repeated rows may give a node more than once, equal each time.
    """
    m = written(members.select("node", "component", F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash")), "members")
    m = small(m)
    texts = docs.join(m, docs["doc_id"].eqNullSafe(m["__id"]) & (F.xxhash64(docs["text"]) == m["__hash"])).select(m["node"], m["component"], docs["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            nodes = b.column(0).to_pylist()
            new = [i for i, x in enumerate(nodes) if x not in seen and not seen.add(x)]
            part = b.take(pa.array(new, pa.int64()))
            sets = [shingle_set(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], names=["node", "component", "size", "hashes"])

    return texts.mapInArrow(tidy(run), "node bigint, component bigint, size bigint, hashes binary")


def verified(edges: DataFrame, sets: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """The edges (u, v) whose ends' whole shingle sets are as alike as likeness; sets has each node once."""
    e = edges.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ok = [bool(alike([np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")], np.arange(2), likeness)) for a, b in pairs]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return e.select("u", "v", "a", "b").mapInArrow(tidy(run), "u bigint, v bigint")


def _slices_of(rows: str, shingles: str):
    return F.expr(f"cast(greatest(1, ceil(({rows}) / {FAMILY}), ceil(({shingles}) / {FAMILY_SHINGLES})) as int)")


def link_families(docs: DataFrame, classes: DataFrame, edges: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """Edges that connect each two classes of likeness or more in one component of the edges given.

    The edges given are spanning edges of loosely near pairs, so the two ends of every near pair are in one
    of their components (families); all pairs of a family are compared by their whole shingle sets.  In a
    large family the given edges are verified first; pairs inside the largest tree of those that stay need
    no comparison, and the others are dealt out as pairs of slices.
    """
    near = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near")
    members = components(near, "loose").join(classes.select("node", "first"), "node")
    sets = written(shingle_sets(docs, members), "sets")
    sizes = sets.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    large = written(sizes.where(f"n > {FAMILY} or total > {FAMILY_SHINGLES}"), "large")
    cells = sets.select(F.col("component").alias("grp"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node", F.col("node").alias("tree"), "hashes")
    firm, n_large = None, large.count()
    if n_large:
        few = F.broadcast(large) if n_large <= 100_000 else large
        inside = written(sets.join(few, "component").dropDuplicates(["node"]), "inside")
        firm = written(verified(near, inside, likeness), "firm")
        trees = components(firm, "trees").select("node", F.col("component").alias("tree"))
        inside = inside.join(trees, "node", "left").withColumn("tree", F.coalesce("tree", "node"))
        per = inside.groupBy("component", "tree").agg(F.count("*").alias("m"), F.sum("size").alias("mt"))
        main = per.groupBy("component").agg(F.max(F.struct("m", "mt", "tree")).alias("main"), F.sum("m").alias("k"), F.sum("mt").alias("kt")).where("k > main.m")
        plan = main.select("component", F.col("main.tree").alias("top"), _slices_of("k - main.m", "kt - main.mt").alias("rest"), _slices_of("main.m", "main.mt").alias("most"))
        dealt = inside.join(F.broadcast(plan) if n_large <= 100_000 else plan, "component")
        at = F.xxhash64("node", F.lit(1))
        dealt = dealt.withColumn("own", F.when(F.expr("tree = top"), F.col("rest") + F.pmod(at, F.col("most"))).otherwise(F.pmod(at, F.col("rest"))).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, if(tree = top, rest, rest + most) - 1)")))
        dealt = dealt.select(F.col("component").alias("grp"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "tree", "hashes")
        cells = cells.join(few, cells["grp"] == large["component"], "left_anti").unionByName(dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, trees, held = None, [], [], {}

        def out() -> pa.RecordBatch:
            ends = alike(list(held.values()), np.array(trees), likeness) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in ends], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            for grp, lo, hi, node, tree, hashes in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (grp, lo, hi) != cell:
                    if held:
                        yield out()
                    cell, nodes, trees, held = (grp, lo, hi), [], [], {}
                if node not in held:
                    nodes.append(node)
                    trees.append(tree)
                    held[node] = np.frombuffer(hashes, "<u8")
        if held:
            yield out()

    n_parts = max(parts_of(classes), parts_of(sets))
    found = cells.repartition(n_parts, "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi").mapInArrow(tidy(run), "u bigint, v bigint")
    return found if firm is None else found.unionByName(firm)


def _others(rows: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of all rows but each group's first.  rows: doc_id, text_hash, node.

    Only classes of several rows or with links are joined to their rows.
    """
    found = components(edges, "links")
    named = classes.select("node", "first", "rows").join(found, "node", "left").where("rows > 1 or component is not null")
    named = named.withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("first").alias("head"))
    heads = written(named.join(firsts, "component").select("node", F.col("head.doc_id").alias("head_id"), F.col("head.text_hash").alias("head_hash")), "heads")
    out = rows.join(small(heads), "node").where(~(F.col("doc_id").eqNullSafe(F.col("head_id")) & F.col("text_hash").eqNullSafe(F.col("head_hash"))))
    return out.select("doc_id", "text_hash")


def similar_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, others): doc_id and text_hash of all rows, and of those that are not the first of a group of similar ones."""
    sketches = written(sketch_documents(docs), "sketches")
    classes = similar_classes(sketches)
    rows = sketches.select("doc_id", "text_hash", "node")
    return rows, _others(rows, classes, link_families(docs, classes, link_similar(classes)))


def digest(docs: DataFrame) -> DataFrame:
    rows, _ = near_duplicates(docs)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, wide: bool = True) -> DataFrame:
    """docs without all but the first row of each group: of similar documents, or of links at RADIUS.

    Of repeated rows (equal doc_id and text) one stays.  Texts are shuffled only where the rows to leave out
    are too many to broadcast.
    """
    rows, others = similar_documents(docs) if wide else fingerprint_groups(docs)
    others = small(written(others.distinct(), "others").toDF("__id", "__hash"))
    repeats = small(written(rows.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "repeats").toDF("__id", "__hash"))
    same = lambda keys: docs["doc_id"].eqNullSafe(keys["__id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["__hash"])
    kept = docs.join(others, same(others), "left_anti")
    once = kept.join(repeats, same(repeats), "left_anti")
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    again = kept.join(repeats, same(repeats), "left_semi")
    again = again.select(F.struct(*[again[c] for c in docs.columns]).alias("row"), F.row_number().over(order).alias("n"))
    return once.unionByName(again.where("n = 1").select("row.*"))
