"""op1, op3, op4: chat formatting, packing, token shards."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import chat, packing, queries, tokens, wavelet

from ..conftest import rows

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "héllo <|im_end|>\n"), (1, 3, "assistant", ""),
    (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", "tie b"), (2, 1, "assistant", "tie a"), (2, 1, "assistant", "tie a"),
    (3, 5, "we\nird \\n role\\\\n", "[\\INST] <\\\\|im_end|> [INST] <<SYS>>"), (3, None, "user", "null turn"), (None, 1, "assistant", "null conv"),
]


def digest_by_hand(turns):
    by, out = defaultdict(list), {}
    for c, t, r, x in turns:
        by[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    for c, ts in by.items():
        ts.sort()
        learnt = "".join(t[5] for t in ts if t[3] == "assistant")
        out[c] = (len(ts), sha("".join(f"{t[3]}\n{t[5]}\n" for t in ts)), len(learnt), sha(learnt))
    return out


def test_chat_digests(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS slot", "'y' AS kind")
    got = {r[0]: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(chat.with_probe(df))).collect()}
    assert got == digest_by_hand([*TURNS, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)])


def test_chat_output_has_no_foreign_marks(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    for r in chat.format_turns(df).collect():
        assert r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == r["n_turns"]
        assert "[INST]" not in r["formatted"]


def test_chat_events(spark):
    log = [(1, 0, 0, "user", "message", "q"), (1, 1, 1, "assistant", "delta", "he"), (1, 2, 1, "assistant", "delta", "llo"), (1, 3, 2, "user", "message", "more"), (1, 4, 3, "assistant", "message", "x"), (1, 5, 1, "assistant", "regenerate", ""), (1, 6, 1, "assistant", "delta", "new"), (1, 7, 0, "user", "edit", "Q?")]
    rng = random.Random(1)
    rng.shuffle(log)
    events = spark.createDataFrame(log, "conv_id bigint, seq bigint, slot bigint, role string, kind string, text string")
    got = [(r["slot"], r["role"], r["text"]) for r in chat.reconstruct(events).orderBy("slot").collect()]
    assert got == [(0, "user", "Q?"), (1, "assistant", "new")]


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_turns(df)).count() == 0


def test_chat_matches_sql(spark, sf, duck):
    got = rows(queries.QUERIES["op1_chat"](spark, sf).toPandas())
    assert got == rows(duck.sql(queries.SQL["op1_chat"]).df())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_tokenizer_path())


def test_memo_never_changes_ids(library, monkeypatch):
    rng = random.Random(1)
    letters = ["a", "b", " ", "  ", "\n", "\t", ".", "'s", "é", "1", "\x1c", "\x85", "\u00a0", "\u3000", "<|endoftext|>", " the", "\r\n", "日"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(5000)] + [None]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for limit in (2_300_000, 50):  # room for all, and a memo that is full at once
        monkeypatch.setattr(tokens, "_MEMO_LIMIT", limit)
        encoder = tokens.Encoder(tokens.default_tokenizer_path())
        for _ in range(2):
            flat, sizes = encoder.encode(texts)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            assert [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == want


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096])
def test_colliding_chunks_keep_their_ids(library, size):
    """Sums of powers modulo 2**64 are equal for a Thue-Morse word and its complement of 1024 letters and more."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    for texts in (["wxyz" + word, "wxyz" + other], ["wxyz" + word + " wxyz" + other], [f"q wxyz{other}", f"q wxyz{word} end"]):
        encoder = tokens.Encoder(tokens.default_tokenizer_path())
        for text in texts:
            assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def whole_ids(library, text, end):
    return library.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, doc_rows, library):
    out = [r.asDict() for r in packing.pack_documents(docs, length=256, open_windows=4).collect()]
    wanted = Counter()
    for d, t, *_ in doc_rows:
        ids = whole_ids(library, t, 1)
        wanted[d, len(ids), crc(ids)] += 1
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
    assert sum(r["length"] for r in out) == sum(n * k[1] for k, n in wanted.items())
    texts = {(d, len(ids)): ids for d, t, *_ in doc_rows for ids in [whole_ids(library, t, 1)]}
    for d, pieces in by_doc.items():
        for r in pieces:
            ids = texts[d, r["doc_tokens"]]
            assert crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
    # each id in one piece: per document as many covers of each place as it has rows
    for (d, n), ids in texts.items():
        cover = np.zeros(n, int)
        for r in by_doc[d]:
            if r["doc_tokens"] == n:
                cover[r["start"] : r["start"] + r["length"]] += 1
        assert set(cover) == {sum(k for (a, b, _), k in wanted.items() if (a, b) == (d, n))}
    windows = defaultdict(list)
    for r in out:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    used = 0
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:i]) for i in range(len(w))]
        assert sum(n for _, n in w) <= 256
        used += sum(n for _, n in w)
    assert used / (256 * len(windows)) > 0.9


def test_packing_empty(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


def test_windows_rule():
    w = packing.Windows(10, 2, 3)
    for i, n in enumerate([6, 7, 3, 2, 8]):
        w.add(i, np.arange(n))
    # 6 and 7 open two windows, 3 fills the second, 2 the first, 8 opens one
    assert [[(d, len(x)) for d, _, x, _ in win] for win in w.done] == [[(1, 7), (2, 3)]]
    assert [[(d, len(x)) for d, _, x, _ in win] for win in w.held] == [[(0, 6), (3, 2)], [(4, 8)]]


@pytest.mark.parametrize("chunk", [512, 1024, wavelet.CHUNK])
@pytest.mark.parametrize("n,sigma", [(0, 1), (1, 1), (7, 1), (513, 3), (3000, 300), (2048, 70_000)])
def test_wavelet_matrix(n, sigma, chunk):
    rng = np.random.default_rng(n)
    seq = rng.integers(0, sigma, n)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(seq, chunk).to_bytes())
    assert np.array_equal(m.decode(), seq)
    for i in rng.integers(0, n, 50) if n else []:
        t = int(seq[i])
        places = np.flatnonzero(seq == t)
        assert m.access(int(i)) == t
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(t, lo, hi) == int((seq[lo:hi] == t).sum()) and m.count(t) == len(places)
        j = int(rng.integers(0, len(places)))
        assert m.select(t, j) == places[j] and m.select(t, len(places)) == -1
    assert m.count(sigma + 5) == 0 and m.select(sigma + 5, 0) == -1


def test_shards(docs, doc_rows, library):
    shards = wavelet.write_shards(docs, shard_tokens=1000)
    assert shards.count() > 1
    got = sorted(tuple(r) for r in wavelet.read_shards(shards).select("start", "n_tokens", "ids_crc32", "doc_id").collect())
    key = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    order = sorted(doc_rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r[1])))
    start, want = 0, []
    for d, t, *_ in order:
        ids = whole_ids(library, t, 0)
        want.append((start, len(ids), crc(ids), d))
        start += len(ids)
    assert got == want


def test_shards_keep_extreme_ids(spark):
    ids = [None, -(1 << 63), (1 << 63) - 1, 0, 5]
    df = spark.createDataFrame([(i, f"t {i}") for i in ids], "doc_id bigint, text string")
    got = [r["doc_id"] for r in wavelet.read_shards(wavelet.write_shards(df)).orderBy("start").collect()]
    assert got == [None, -(1 << 63), 0, 5, (1 << 63) - 1]


def test_one_hot_id_is_dealt_out(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text")).repartition(4)
    shards = wavelet.write_shards(df)
    docs = [r["n"] for r in shards.groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(docs) == 400 and max(docs) < 160
    starts = sorted((r["start"], r["n_tokens"]) for r in wavelet.read_shards(shards).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_files_are_read_in_parts(spark, tmp_path, library):
    """Access, count and occurrence lookup from a file, without reading all of it."""
    rng = random.Random(8)
    words = [library.decode([i]) for i in range(1000, 3000)]
    df = spark.createDataFrame([(i, "".join(rng.choice(words) for _ in range(2000))) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    files = wavelet.save_files(wavelet.write_shards(df, chunk=1 << 13), f"file://{tmp_path}/shards").collect()
    assert len(files) == 1 and sorted(p.name for p in (tmp_path / "shards").iterdir()) == [files[0]["path"].rsplit("/", 1)[1]]
    ids = [i for d in df.collect() for i in whole_ids(library, d["text"], 0)]
    shard = wavelet.open_file(files[0]["path"])
    read, seen = shard.sections.read, []
    shard.sections.read = lambda at, size: seen.append(size) or read(at, size)
    assert shard.matrix.access(70_000) == ids[70_000]
    assert 0 < sum(seen) < 0.25 * (tmp_path / "shards" / files[0]["path"].rsplit("/", 1)[1]).stat().st_size
    token = ids[500]
    assert shard.matrix.count(token) == ids.count(token) and shard.matrix.select(token, 3) == [i for i, x in enumerate(ids) if x == token][3]
    assert shard.doc_ids() == list(range(60)) and shard.matrix.decode().tolist() == ids


def test_shards_empty(no_docs):
    assert wavelet.read_shards(wavelet.write_shards(no_docs)).count() == 0
