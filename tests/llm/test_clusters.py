"""op11, op12, op13: clusters of vectors, alignment of tokenizers, line dedup, against plain Python."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import align, centroids, lines, queries, tokens

from ..conftest import rows
from .conftest import SCHEMA

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
VECTORS = "vec_id bigint, embedding array<double>, cluster int, v string"


# --- op11 -----------------------------------------------------------------------------------------
def make_vectors(n=300, seed=5):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 64))
    v = [(i, (middles[i % 5] + 0.4 * rng.normal(size=64)).tolist()) for i in range(n)]
    v += [(n + i, v[0][1]) for i in range(150)]  # a third are one vector
    v += [(7, v[3][1]), (None, v[4][1]), (None, v[5][1])]
    odd = [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [None] + [1.0] * 63), (904, [math.nan] + [1.0] * 63), (905, [math.inf] + [1.0] * 63), (906, []), (907, [1e300] + [1.0] * 63)]
    return v, odd


def plain_clusters(vectors, k=8, rounds=10):
    x = [(i, [math.floor(1024 * c) for c in v]) for i, v in vectors]
    first = sorted(x, key=lambda r: (sha(f"3:{'null' if r[0] is None else r[0]}"), r[1]))
    cs = [list(r[1]) for r in first[:k]]
    m = np.array([r[1] for r in x], np.int64)

    def near():
        d = np.stack([((m - np.array(c)) ** 2).sum(1) for c in cs], 1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        own, _ = near()
        cs = [[int(s) // int((own == j).sum()) for s in m[own == j].sum(0)] if (own == j).any() else cs[j] for j in range(len(cs))]
    own, d = near()
    names = [sha(",".join(map(str, c))) for c in cs]
    return Counter((x[i][0], int(own[i]), int(d[i]), int(d[own == own[i]].sum()), int(d.sum()), names[own[i]]) for i in range(len(x)))


def test_clusters_match_plain_k_means(spark):
    v, odd = make_vectors()
    df = spark.createDataFrame([(*r, 9, "x") for r in v + odd], VECTORS).repartition(5)
    got = Counter(tuple(r) for r in centroids.digest(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
    assert got == plain_clusters(v)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, n):
    v = [(i, [float(i)] * 64) for i in range(n)]
    df = spark.createDataFrame([(*r, 9, "x") for r in v], VECTORS)
    got = Counter(tuple(r) for r in centroids.digest(df).collect())
    assert got == (plain_clusters(v) if v else Counter())


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-900, 900, (400, 64)), np.zeros((100, 64), np.int64), np.full((1, 64), 1 << 26)])
    now = x[rng.choice(400, 8, replace=False)].copy()
    now[7] = now[6]  # a tie for every vector near both
    own, upper, lower = centroids.scan(x, now)
    scans = 0
    for _ in range(12):
        before, now = now, np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else now[j] for j in range(8)])
        own, upper, lower, n = centroids.Move(before, now).apply(x, own, upper, lower)
        scans += n
        assert (own == np.stack([((x - c) ** 2).sum(1) for c in now], 1).argmin(1)).all()
    assert scans < 12 * len(x) * 0.9


# --- op12 -----------------------------------------------------------------------------------------
ODD_TEXTS = ["", " ", "  ", "x", " lead", "trail ", "two  spaces   here", "a\nb\n\n c \n", "<|endoftext|> x <s> </s>", "a▁b", "▁", "日本語 テキスト です", "é é ﬁ Å", "🙂🙂 zero​width   nbsp", "\x00 nul", "z" * 500, "1234567890 12 3.14", "can't won't I'll", "tab\tand \tspace", "᠎ x", "<0x41> <unk>", "x \x1c y"]


def plain_alignment(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = align.default_paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    letter = {c: i for i, c in tokens._byte_letters().items()}
    found, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False), b.encode(text or "")
        ba = [bytes(letter[c] for c in t) for t in ia.tokens]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ba) != whole or b"".join(bb) != whole:
            found.append(None)
            continue
        ea, eb = (np.cumsum([len(t) for t in side]).tolist() for side in (ba, bb))
        ra, rb = list(zip([0, *ea], ea)), list(zip([0, *eb], eb))
        links, groups, j, start = [], [], 0, (0, 0)
        for i, (lo, hi) in enumerate(ra):
            while j and rb[j - 1][1] > lo:
                j -= 1
            while j < len(rb) and rb[j][0] < hi:
                if rb[j][1] > lo:
                    links.append((ia.ids[i], ib[j]))
                j += 1
        for end in sorted(set(ea) & set(eb)):
            stop = (ea.index(end) + 1, eb.index(end) + 1)
            groups.append(",".join(map(str, ia.ids[start[0] : stop[0]])) + "|" + ",".join(map(str, ib[start[1] : stop[1]])))
            start = stop
        counts.update(links)
        found.append((len(ea), len(eb), len(groups), links, sha(";".join(groups))))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(counts[p] == highest[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) for f in found]


def test_alignment_matches_plain_version(spark, docs, doc_rows):
    odd = spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(ODD_TEXTS)], SCHEMA)
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).withColumns({c: F.lit("x") for c in ("block", "key", "times", "held", "segments", "n_links")})
    got = align.digest(both).collect()
    source = [(r[0], r[1]) for r in doc_rows] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    want = Counter(zip([d for d, _ in source], plain_alignment([t for _, t in source])))
    assert Counter((r["doc_id"], tuple(r[1:])) for r in got) == want


def test_alignment_without_cuts_is_the_same(monkeypatch):
    pair = align.Pair.get(*align.default_paths())
    assert pair.cuts
    for text in ODD_TEXTS:
        if not text:
            continue
        cells, _, keys, times = align._encode_block(pair, [text, text])
        monkeypatch.setattr(pair, "cuts", False)
        assert (cells[0][:4], keys, times.tolist()) == (lambda o: (o[0][0][:4], o[2], o[3].tolist()))(align._encode_block(pair, [text, text]))
        monkeypatch.setattr(pair, "cuts", True)


def test_alignment_pairs_and_empty(spark, no_docs):
    out, pairs = align.align(no_docs)
    assert out.collect() == [] and pairs.collect() == []
    df = spark.createDataFrame([(1, "the cat"), (2, "the dog")], "doc_id bigint, text string")
    out, pairs = align.align(df)
    assert sum(r["pair_count"] for r in pairs.collect()) == sum(r["n_links"] for r in out.collect())
    assert max(r["pair_count"] for r in pairs.collect()) == 2


# --- op13 -----------------------------------------------------------------------------------------
LONG = "This line is long enough to count"
LINE_DOCS = [
    (1, f"{LONG}\nown one\n  {LONG.upper()} \t"), (2, f"a\n{LONG}\r\nb"), (3, f"{LONG}"), (9, f"{LONG}\n{LONG}\nend"), (4, None), (5, ""), (6, "\n\n"), (7, "short\nshort"), (8, "short"), (10, "short\n"),
    (11, "only two documents hold it"), (12, "only two documents hold it"), (13, "ÄÖ é letters of other kinds é"), (14, "ÄÖ É letters of other kinds é"), (15, "äÖ é LETTERS of other kinds é"), (16, "ÄÖ é LETTERS of other KINDS é"), (17, "äö É letters of other kinds é"),
    (18, "x" * 19 + "\n" + "y" * 20), (19, "x" * 19 + "\n" + "y" * 20), (20, "x" * 19 + "\n" + "Y" * 20 + " "), (21, "x" * 19 + "\n" + "Y" * 20),
    (None, f"null id\n{LONG}"), (None, f"{LONG}\nagain"), (3, f"{LONG}"), (30, "many\n" + "\n".join(f"line number {i} of a long text" for i in range(3000))), (31, "\n".join(f"line number {i} of a long text" for i in range(0, 3000, 2))), (32, "\n".join(f"line number {i} of a long text" for i in range(0, 3000, 3)) + "\n"),
]


def plain_lines(docs):
    up = {ord(c): c.lower() for c in lines.UPPER}
    key = lambda s: s.strip(lines.SPACE).translate(up)
    held = defaultdict(set)
    for d, t in docs:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 20:
                held[key(s)].add(d)
    keeper = {k: max(x for x in ds if x is not None) for k, ds in held.items() if len(ds) >= 3}
    out = []
    for d, t in docs:
        ls = (t or "").split("\n")
        stay = [s for s in ls if keeper.get(key(s), d) == d]
        out.append((d, len(ls), len(ls) - len(stay), sha("\n".join(stay))))
    return Counter(out)


def test_lines_match_plain_version(spark):
    df = spark.createDataFrame(LINE_DOCS, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("at", "line", "h1", "h2", "t1", "keeper", "gone", "g", "held")})
    for broadcast in (True, False):
        with pytest.MonkeyPatch.context() as m:
            if not broadcast:
                m.setattr(lines, "small", lambda df: df)
            got = Counter(tuple(r) for r in lines.digest(df).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
        assert got == plain_lines(LINE_DOCS)


def test_lines_empty_and_limits(spark, no_docs):
    assert lines.digest(no_docs).collect() == []
    df = spark.createDataFrame([(1, "ab\nc"), (2, "ab")], "doc_id bigint, text string")
    assert {tuple(r) for r in lines.dedup_lines(df, 2, 2).select("doc_id", "text", "n_dropped").collect()} == {(1, "c", 1), (2, "ab", 0)}


def test_lines_query_matches_sql(spark, sf, duck):
    assert rows(queries.QUERIES["op13_lines"](spark, sf).toPandas()) == rows(duck.sql(queries.SQL["op13_lines"]).df())


def test_lines_stay_in_the_jvm(spark, sf):
    plan = queries.QUERIES["op13_lines"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
