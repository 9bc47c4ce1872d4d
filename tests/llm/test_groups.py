"""op2, op5, op7, op8: fingerprints, mixing, near-duplicates, sharding."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import components, lcp, mixing, sharding, simhash


def test_fingerprints(docs, doc_rows):
    out = [r.asDict() for r in lcp.digest(docs).collect()]
    key = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    texts = sorted(((d is not None, d or 0, key(t), t or "", d) for d, t, *_ in doc_rows), reverse=True)
    want = Counter()
    for i, (_, _, _, t, d) in enumerate(texts):
        other = texts[(i + 1) % len(texts)][3]
        want[d, len(t), hashlib.sha256(lcp.edited(t, other).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == want
    prints = {r["doc_id"]: r["fingerprint"] for r in out if r["doc_id"] is not None}
    assert prints[3] == prints[110] and prints[100] == prints[101] and prints[3] != prints[4]
    long = [r for r in out if r["n_chars"] > 400 and r["doc_id"] not in (110, 111, 112)]
    assert all(0.25 < r["near_edited"] <= 1 for r in long if r["doc_id"] != 123)
    assert all(0 <= r["near_next"] <= 1 for r in out)
    assert {r["doc_id"]: r["fingerprint"] for r in lcp.fingerprint_documents(docs.where("doc_id is not null")).collect()} == prints


def fingerprint_by_plain_parsing(text):
    """One symbol at a time: runs, two rounds of coin tossing, local maxima; then the bins' least hashes."""
    m1, m2, full = int(lcp._M1), int(lcp._M2), (1 << 64) - 1

    def mix(x):
        x = x * m1 & full
        x ^= x >> 29
        x = x * m2 & full
        return x ^ x >> 32

    def toss(a):
        out = []
        for i, v in enumerate(a):
            low = 0 if i == 0 else ((v ^ a[i - 1]) & -(v ^ a[i - 1])).bit_length() - 1 if v != a[i - 1] else 16
            out.append(low << 1 | v >> min(low, 15) & 1)
        return out

    def phrases(names):
        runs = []
        for v in names:
            if runs and runs[-1][0] == v:
                runs[-1][1] += 1
            else:
                runs.append([v, 1])
        names = [mix(v + n * m2 & full) if n > 1 else v for v, n in runs]
        labels = toss(toss([v & 0xFFFF for v in names]))
        n = len(names)
        starts = [0] + [i for i in range(2, n - 1) if labels[i] > labels[i - 1] and labels[i] >= labels[i + 1]]
        parts = [names[a:b] for a, b in zip(starts, [*starts[1:], n])]
        return [mix(sum(mix(v) * int(lcp._PLACE[i & 63]) for i, v in enumerate(part)) + len(part) & full) for part in parts]

    main, short, names = [1 << 48] * lcp.BINS, [1 << 48] * lcp.SHORT_BINS, [ord(c) for c in text]
    for level in range(1, lcp.LEVELS + 1):
        if not names:
            break
        names, seen = phrases(names), Counter()
        for v in names:
            if level > 1:
                seen[v] += 1
                v = (mix(v + (seen[v] - 1) * m2 & full) if seen[v] > 1 else v) + level & full
            bins = short if level == 1 else main
            h = mix(v ^ m1)
            bins[(h >> 48) % len(bins)] = min(bins[(h >> 48) % len(bins)], h & (1 << 48) - 1)
    return "".join(lcp.EMPTY if v == 1 << 48 else f"{v & 0xFFFF:04x}" for v in main + short)


def test_fingerprints_match_plain_parsing(doc_rows):
    rng = random.Random(31)
    texts = [t or "" for _, t, *_ in doc_rows if len(t or "") < 3000]
    texts += ["".join(rng.choice("ab") * rng.choice([1, 1, 2, 5]) for _ in range(rng.randint(0, 80))) for _ in range(60)] + ["a", "ab", "aab", "aaaa", "日本日本"]
    assert lcp.to_text(lcp.sketches(texts)) == [fingerprint_by_plain_parsing(t) for t in texts]


def test_long_unrelated_texts_are_unlike():
    rng = np.random.default_rng(4)
    a, b = lcp.sketches(["".join(map(chr, rng.integers(97, 123, 1_500_000))) for _ in range(2)])
    assert lcp.likeness(a[None], b[None])[0] < 0.1


def test_ranges_split_equal_places():
    a, b, c = lcp._place(None, 5), lcp._place(1, 2), lcp._place(9, 0)
    r = lcp.Ranges([(a, a), (a, b), (b, b), (b, c)])
    assert {r.of(a, i) for i in range(4)} == {0, 1} and {r.of(b, i) for i in range(6)} == {1, 2, 3}
    assert r.of(c, 0) == r.of(lcp._place(3, 1), 7) == 3
    assert r.guests() == [(9, 0, 0)]


def test_fingerprints_of_one_hot_id(spark):
    """A third of all rows without an id and with one text, and one id with many texts."""
    rng = random.Random(3)
    rows = [(None, "the same text again")] * 50 + [(7, f"text {rng.random()}") for _ in range(50)] + [(i, f"other {i}") for i in range(100, 150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = Counter((r["doc_id"], r["edited_sha256"]) for r in lcp.digest(df).collect())
    key = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    order = sorted(((d is not None, d or 0, key(t), t, d) for d, t in rows), reverse=True)
    want = Counter((r[4], hashlib.sha256(lcp.edited(r[3], order[(i + 1) % len(order)][3]).encode()).hexdigest()) for i, r in enumerate(order))
    assert got == want


def test_fingerprints_small_tables(spark, no_docs):
    assert lcp.digest(no_docs).count() == 0
    one = spark.createDataFrame([(1, "only one text")], "doc_id bigint, text string")
    assert lcp.digest(one).first()["near_next"] == 1.0


def test_equal_texts_have_equal_fingerprints():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    alone = [lcp.to_text(lcp.sketches([t]))[0] for t in texts]
    assert lcp.to_text(lcp.sketches(texts)) == alone


def test_equal_substrings_share_names():
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    a, b = ("".join(rng.choice("xyz") for _ in range(n)) + body for n in (7, 100))

    def names(text, level):
        x, doc = np.array([ord(c) for c in text], np.uint64), np.zeros(len(text), int)
        for _ in range(level):
            x, doc = lcp.parse(x, doc)
        return Counter(x.tolist())

    for level in (1, 2, 3):
        x, y = names(a, level), names(b, level)
        assert sum((x & y).values()) > 0.8 * sum(names(body, level).values())


def fingerprint_by_hand(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_by_hand(fps, radius=3):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, doc_rows):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.digest(docs).collect())
    fps = [fingerprint_by_hand(t) for _, t, *_ in doc_rows]
    roots = components_by_hand(fps)
    least = {}
    for r, (d, *_) in zip(roots, doc_rows):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    assert got == Counter((d, f"{f:016x}", least.get(r)) for (d, *_), f, r in zip(doc_rows, fps, roots))


def test_simhash_keeps_one_row_a_group(docs, doc_rows):
    kept = simhash.first_of_groups(docs, wide=False)
    assert kept.columns == docs.columns
    fps = {d: fingerprint_by_hand(t) for d, t, *_ in doc_rows if d is not None}
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 110 not in ids and 5 in ids
    assert not [1 for a in ids for b in ids if a is not None and b is not None and a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert set(range(60)) <= set(ids)


def test_similar_documents(spark):
    """Copies with some words changed are found at likeness 0.8 and over, unrelated texts stay apart."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, near = [], []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(120, 400))]
        texts.append(words)
        if i < 60:
            copy = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // 90)):
                copy[at] = "changed"
            near.append((i, copy))
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(1000 + i, " ".join(w)) for i, w in near] + [(2000, " ".join(texts[0]))]

    def jaccard(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        return len(x & y) / len(x | y)

    kept = {r[0] for r in simhash.first_of_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id").collect()}
    assert set(range(150)) <= kept and 2000 not in kept
    alike = [i for i, w in near if jaccard(texts[i], w) >= 0.8]
    assert len(alike) > 40 and not [i for i in alike if 1000 + i in kept]


@pytest.mark.parametrize("slice_size", [512, 40])
def test_similar_pairs_inside_a_family(spark, monkeypatch, slice_size):
    """Documents of one template, about 0.74 alike, with planted pairs over 0.8: every pair is one group, and nothing else is."""
    monkeypatch.setattr(simhash, "FAMILY", slice_size)
    rng = random.Random(12)
    template = [f"t{rng.randrange(5000)}" for _ in range(340)]
    family = [template + [f"u{rng.randrange(10**6)}" for _ in range(60)] for _ in range(240)]
    pairs = [(i, family[i][:-25] + [f"v{rng.randrange(10**6)}" for _ in range(25)]) for i in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(family)] + [(1000 + i, " ".join(w)) for i, w in pairs]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in [*enumerate(family), *((1000 + i, w) for i, w in pairs)]}
    alike = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike == {(i, 1000 + i) for i in range(40)}
    kept = {r[0] for r in simhash.first_of_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id").collect()}
    assert kept == set(range(240))


def test_likeness_is_of_whole_sets():
    """At exactly 0.8 a pair is a link, one shingle below it is none, however long the texts are."""
    for n in (5, 250, 5000):
        rest = np.arange(10**9, 10**9 + 10 * n).astype(np.uint64)
        at = [rest[: 9 * n], rest[n : 10 * n]]
        assert simhash.alike(at, np.arange(2)) == [(0, 1)]
        assert simhash.alike([np.append(at[0], np.uint64(1)), at[1]], np.arange(2)) == []
        assert simhash.alike(at, np.zeros(2)) == []


def shingles_of(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_by_hand(texts):
    """For each text the first place of its group: equal sets of shingles, or likeness 0.8 or more."""
    sets, up = [shingles_of(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))]


def test_keys_find_borderline_pairs():
    """Sets of likeness 0.8 to 0.83 share a key, and their fingerprints are near."""
    rng = np.random.default_rng(3)
    missed = far = 0
    for n in (15, 60, 400):
        for _ in range(400):
            h = np.unique(rng.integers(0, 1 << 63, 10 * n).astype(np.uint64))
            a, b = np.sort(h[: 9 * n]), np.sort(h[n:])
            both, counts = np.concatenate([a, b]), [len(a), len(b)]
            keys, fps = simhash.bands_of(both, counts), simhash.majorities(both, counts, simhash.WIDE)
            missed += not (keys[0] == keys[1]).any()
            far += simhash.distance(fps[0], fps[1]) > simhash.wide_radius()
    assert missed <= 3 and far <= 3
    assert 1 - (1 - 0.8**simhash.BAND) ** simhash.BANDS > 0.99998


def test_similar_documents_of_all_kinds(docs, doc_rows):
    """The wide form on nulls, empty and long texts, ties, repeated rows and clashing columns, against plain Python."""
    order = sorted({(d is None, d or 0, t is None, t or "") for d, t, *_ in doc_rows})
    roots = groups_by_hand([t for _, _, _, t in order])
    # text hashes order rows without an id among themselves, so those are only counted
    want = Counter(None if order[i][0] else order[i][1] for i, r in enumerate(roots) if r == i)
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_similar_documents_at_the_border(spark):
    """Pairs of likeness 0.77 to 0.86: linked are those of 0.8 and more, and no others."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(300)]
        copy = list(words)
        for at in range(3, 300, 300 // rng.choice([5, 6, 7]) + 1):
            copy[at] = "changed"
        texts += [" ".join(words), " ".join(copy)]
    roots = groups_by_hand(texts)
    assert 30 < sum(r != i for i, r in enumerate(roots)) < 110
    kept = simhash.first_of_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in enumerate(roots) if r == i}


def test_repeated_words_make_no_likeness(spark):
    """Texts that are mostly one word share few of their distinct shingles."""
    rng = random.Random(5)
    texts = ["spam " * 1000 + " ".join(f"{i}x{rng.randrange(10**6)}" for _ in range(300)) for i in range(8)]
    kept = simhash.first_of_groups(spark.createDataFrame(list(enumerate(texts + texts)), "doc_id bigint, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(8))


def test_similar_whole_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows_ = sorted((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect())
    roots = groups_by_hand([t for _, t in rows_])
    want = {rows_[i][0] for i, r in enumerate(roots) if r == i}
    assert {r["doc_id"] for r in simhash.first_of_groups(d).select("doc_id").collect()} == want


def test_simhash_empty(no_docs):
    assert simhash.digest(no_docs).count() == 0 and simhash.first_of_groups(no_docs).count() == 0


@pytest.mark.parametrize("slice_size", [4096, 20])
def test_all_links_found_in_dense_groups(spark, monkeypatch, slice_size):
    """Chains and stars of fingerprints around a few centres; small slices deal large buckets out."""
    monkeypatch.setattr(simhash, "SLICE", slice_size)
    rng = random.Random(4)
    fps = []
    for _ in range(4):
        c = rng.getrandbits(64)
        for _ in range(60):
            fps.append(c)
            for _ in range(rng.randint(1, 2)):
                c ^= 1 << rng.randrange(64)
    fps = list(dict.fromkeys(fps + [rng.getrandbits(64) for _ in range(200)]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.link_classes(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    found = dict(components.components(edges).collect())
    want = components_by_hand(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (want[i] == want[j]) == (found.get(signed[i], signed[i]) == found.get(signed[j], signed[j]))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 4)]
    got = dict(components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_mixing(docs, doc_rows):
    out = [r.asDict() for r in mixing.mix(docs, repetition=1.5).collect()]
    assert len(out) == len(doc_rows)
    words = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["mix_tokens"]) for r in out) == Counter((d, words(t)) for d, t, *_ in doc_rows)
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    epochs = {s: rs[0]["mix_epochs"] for s, rs in by.items()}
    tokens = {s: sum(r["mix_tokens"] for r in rs) for s, rs in by.items()}
    assert min(epochs.values()) == 1.0 and max(epochs.values()) <= 1.5 + 1e-6
    assert math.isclose(sum(rs[0]["mix_weight"] for rs in by.values()), 1, rel_tol=1e-9)
    for s, rs in by.items():
        real = sum(r["mix_tokens"] * r["mix_copies"] for r in rs)
        assert abs(real - epochs[s] * tokens[s]) <= max(r["mix_tokens"] for r in rs)
        assert all(r["mix_copies"] in (math.floor(epochs[s]), math.floor(epochs[s]) + 1) for r in rs)
    places = mixing.expand(mixing.mix(docs, repetition=1.5))
    assert places.count() == sum(r["mix_copies"] for r in out)
    assert places.where("mix_place < 0 or mix_place >= 1").count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of longs, ints (given as ('int', n)), strings and nulls in a row."""
    seed = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else v[1].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def mix_by_hand(rows, repetition):
    """Copies of each row: shares, the exponent by bisection, budgets, then blocks in their hashed order."""
    words, by = [len((t or "").encode().split()) for _, t, *_ in rows], defaultdict(list)
    for i, r in enumerate(rows):
        by["n" if r[3] is None else "s" + r[3]].append(i)
    tokens = {s: sum(words[i] for i in m) for s, m in by.items()}
    p = {s: n / sum(words) for s, n in tokens.items() if n}
    lo, hi = 0.0, 1.0
    spread = max(p.values()) / min(p.values())
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if spread ** (1 - mid) <= repetition * (1 + 1e-12) else (mid, hi)
    a = 0.0 if spread <= repetition * (1 + 1e-12) else hi
    raw = {s: v**a for s, v in p.items()}
    z, budget = sum(raw.values()), max(tokens[s] / raw[s] for s in raw)
    copies = [1] * len(rows)
    for s in raw:
        epochs = max(1.0, round(raw[s] / z * (budget * z) / tokens[s], 9))
        left = (epochs - math.floor(epochs)) * tokens[s]
        blocks = defaultdict(list)
        for i in by[s]:
            blocks[spark_hash(rows[i][0], "block") % mixing.BLOCKS].append(i)
        for b in sorted(blocks, key=lambda b: (spark_hash(s, ("int", b), "turn"), b)):
            inner = sorted(blocks[b], key=lambda i: spark_hash(rows[i][0], zlib.crc32((rows[i][1] or "").encode())))
            whole, upto = sum(words[k] for k in inner), 0
            for i in inner:
                copies[i] = math.floor(epochs) + (whole > 0 and left > 0 and (left >= whole or upto + words[i] / 2 <= left))
                upto += words[i]
            left -= whole
    return copies


def test_mixing_matches_plain_permutations(spark):
    rng = random.Random(17)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), "en", rng.choices(["a", "b", "c", None], [70, 20, 8, 2])[0]) for i in range(1500)]
    got = {r["doc_id"]: r["mix_copies"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3), repetition=1.7).collect()}
    want = mix_by_hand(rows, 1.7)
    assert set(want) == {1, 2} and got == {r[0]: n for r, n in zip(rows, want)}


def test_mixing_by_entropy(spark):
    shares = [0.7, 0.2, 0.06, 0.04]
    a = mixing.solve_exponent(spark.createDataFrame([(p,) for p in shares], "p double"), entropy=0.9)
    w = np.array(shares) ** a
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 0.9 * math.log(4)) < 1e-4


def test_mixing_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).columns == no_docs.columns


def test_sharding(docs, doc_rows):
    out = [r.asDict() for r in sharding.digest(docs).collect()]
    data = [((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for d, t, *_ in doc_rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(data)
    slots = defaultdict(list)
    for r in out:
        assert 0 <= r["shard"] < 16 and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def ring_by_hand(docs, shards, points=128, slack=0.001):
    """Shard by document (id, size) with distinct ids, by a plain walk around the ring."""
    segment = lambda d: xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42) >> 48
    ring = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % 65536, s) for s in range(shards) for v in range(points))
    held = defaultdict(list)
    for d, size in docs:
        held[segment(d)].append((d, size))
    limit = math.ceil((1 + slack) * sum(n for _, n in docs) / shards)
    used, out = Counter(), {}
    for seg, members in sorted(held.items(), key=lambda x: (-sum(n for _, n in x[1]), x[0])):
        load = sum(n for _, n in members)
        after = [s for p, s in ring if p >= seg] + [s for p, s in ring if p < seg]
        shard = next((s for s in after if used[s] + load <= limit), None)
        if shard is None:
            return None  # this one would be cut
        used[shard] += load
        out.update((d, shard) for d, _ in members)
    return out


@pytest.mark.parametrize("shards", [3, 16])
def test_sharding_matches_plain_ring(spark, shards):
    rng = random.Random(shards)
    docs = [(rng.randrange(-(10**12), 10**12), rng.randint(1, 40)) for _ in range(3000)]
    want = ring_by_hand(docs, shards, slack=0.2)
    df = spark.createDataFrame([(d, "x" * (n - 1)) for d, n in docs], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, shards, slack=0.2).collect()}
    assert want is not None and got == want


def test_sharding_is_even_and_moves_little(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.col("id") * 37, F.lit(400)).cast("int")).alias("text"))
    a, b = sharding.shard_documents(df, 16).toPandas(), sharding.shard_documents(df, 17).toPandas()
    for out, n in ((a, 16), (b, 17)):
        size = out.groupby("shard")["size"].sum()
        assert len(size) == n and size.max() <= 1.001 * size.mean() + 401
    both = a.merge(b, on="doc_id")
    moved = (both["shard_x"] != both["shard_y"]).mean()
    assert 1 / 17 < moved < 0.2, moved


def test_sharding_of_one_hot_id(spark):
    """A third of all rows without an id: they are dealt out, and no shard is over its bound."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") % 50).cast("int")).alias("text")).repartition(4)
    out = sharding.shard_documents(df, 8).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert len(out) == 9000 and len(size) == 8 and size.max() <= 1.001 * size.mean() + 50
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])


def test_written_shards_are_whole(spark, docs, doc_rows, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), shards=4)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["doc_id"], r["text"]) for r in got.select("doc_id", "text").collect()) == Counter((d, t) for d, t, *_ in doc_rows)
    slots = got.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("k"), F.max("slot").alias("m")).collect()
    assert len(slots) == 4 and all(r["n"] == r["k"] == r["m"] + 1 for r in slots)


def test_ring_plan_covers_every_byte():
    loads = {i: (1 + (i * 7919) % 100, 2) for i in range(0, 65536, 11)} | {77: (90_000, 5), 78: (50_000, 1)}
    plan = sharding.ring_plan(loads, 5, 32, 0.01)
    got = Counter()
    for seg, _, lo, hi in plan:
        got[seg] += hi - lo
    assert got == Counter({k: v for k, (v, _) in loads.items()})
    size = Counter()
    for _, shard, lo, hi in plan:
        size[shard] += hi - lo
    assert max(size.values()) <= 1.02 * sum(size.values()) / 5


def test_sharding_empty(no_docs):
    assert sharding.digest(no_docs).count() == 0
