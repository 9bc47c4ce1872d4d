"""Alignment of two tokenizers' ids over byte offsets, by a dictionary of groups.

Byte offsets where a token of A and a token of B both end cut a text into groups, each a run of A ids and a
run of B ids over the same bytes.  Inside a group no other end is shared, so its links (pairs of tokens whose
byte ranges overlap) are a merge of both runs, one fewer than their tokens together.  Texts repeat groups: a
batch of documents is a block with a dictionary of its own, whose groups Spark interns over all blocks, with
their frequencies.  Links are expanded once for each distinct group, counted with its frequency, and what a
group is worth (links, best links, sum of counts) is joined back to the blocks' dictionaries by the group's
key.  Only dictionaries are shuffled by group: a group that every document holds is a row a block at most.

Where a single space stands between two visible characters, both tokenizers begin a token, so a text is cut
there into segments and each distinct segment of a block is encoded once.  The cut is taken for A where its
pipeline is plain byte-level BPE, and for B where it changes no character and no piece has a space behind
another character; else a text is one segment.

Cases: a null or empty text, and one whose tokens' bytes are not space and text (B has no sign for U+2581),
has no tokens, and its groups are not counted; rows count one by one, repeated ones too; special tokens'
strings in texts are plain text; a null doc_id is kept; an empty table gives no rows; other columns are left
out.  A text of any length is encoded segment by segment; its segment numbers must fit into a row (2 GB).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bound_batches, tidy, written

#: White space, and characters that some version of Unicode calls so.
_WHITE = r"\s\x1c-\x1f\u180e\u200b\u2060\ufeff"
_CUT = re.compile(rf" (?<=[^{_WHITE}] )(?=[^{_WHITE}])")
_EDGE = re.compile(rf"\A[{_WHITE}]|[{_WHITE}]\Z")
#: Segments that a worker remembers over its blocks, and how many the libraries get at once.
_MEMO, _RUN = 400_000, 512
_ENCODED_SQL = "block string, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, segments binary, held binary, keys array<string>, times array<bigint>"
_ENCODED = pa.schema([("block", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("segments", pa.binary()), ("held", pa.binary()), ("keys", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])
_LINKS_SQL = "key string, times bigint, a int, b int, links bigint"
_LINKS = pa.schema([("key", pa.string()), ("times", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("links", pa.int64())])
_PAIRS: dict[tuple[str, str], "Pair"] = {}


class Pair:
    """Both tokenizers, and each id's bytes; one per worker process and pair of files."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {c: i for i, c in tokens._byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            if all(c in letters for c in piece):
                self.a_bytes[i] = bytes(letters[c] for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        kind = str(self.a.pre_tokenizer)
        plain_a = self.a.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
        odd = " x  y\u212b"
        plain_b = not any("\u2581" in p.lstrip("\u2581") for p in pieces) and b"".join(self.b_bytes[i] for i in self.b.encode(odd)) == (" " + odd).encode()
        self.cuts = plain_a and plain_b
        self.clear()

    def clear(self) -> None:
        """Forgets segments and groups; results do not depend on what is remembered."""
        self.places: dict[str, int] = {}  # segments
        self.numbers: dict[str, int] = {}  # groups
        # of each segment: its A and B ids (-1: bytes differ), its groups, and where they begin in flat
        self.n_a, self.n_b, self.sizes, self.starts, self.flat = (np.zeros(0, np.int64) for _ in range(5))

    @classmethod
    def get(cls, a_path: str, b_path: str) -> "Pair":
        if (a_path, b_path) not in _PAIRS:
            _PAIRS[a_path, b_path] = cls(a_path, b_path)
        return _PAIRS[a_path, b_path]

    def segments(self, text: str) -> list[str]:
        """text in segments, each without the space before it."""
        if not self.cuts:
            return [text]
        return text.split(" ") if text.isascii() and " ".join(text.split()) == text else _CUT.split(text)

    def learn(self, segments: list[str]) -> np.ndarray:
        """Places of segments among those that are remembered; unseen ones are encoded, all at once."""
        if len(self.places) + len(segments) > _MEMO:
            self.clear()
        known = len(self.places)
        at = np.array([self.places.setdefault(s, len(self.places)) for s in segments], np.int64)
        if new := list(self.places)[known:] if len(self.places) > known else []:
            self._encode(new)
        return at

    def _encode(self, segments: list[str]) -> None:
        """Adds segments in their order.  Those with a visible character at both ends go to the libraries many at a
        time, with spaces between them, where tokens begin anyway; what does not come back as it was goes alone."""
        inner = [i for i, s in enumerate(segments) if self.cuts and s and not _EDGE.search(s)]
        alone = sorted(set(range(len(segments))) - set(inner))
        runs = [inner[lo : lo + _RUN] for lo in range(0, len(inner), _RUN)] + [[i] for i in alone]
        good, a_all, b_all = [], [], []
        while runs:
            texts = [" ".join([segments[i] for i in run]) for run in runs]
            a_got = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
            b_got = self.b.encode(texts, num_threads=1)
            again = []
            for run, text, a, b in zip(runs, texts, a_got, b_got):
                whole = (" " + text).encode("utf-8", "surrogatepass")
                if b"".join(map(self.a_bytes.__getitem__, a.ids)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
                    good += run
                    a_all.append(np.array(a.ids, np.int64))
                    b_all.append(np.array(b, np.int64))
                elif len(run) > 1:
                    again += [[i] for i in run]
            runs = again
        n_a, n_b, sizes = (np.full(len(segments), v, np.int64) for v in (-1, -1, 0))
        flat, order = np.zeros(0, np.int64), np.array(good, np.int64)
        if good:
            ends = np.cumsum([len(segments[i].encode("utf-8", "surrogatepass")) + 1 for i in good])
            n_a[order], n_b[order], sizes[order], flat = self._grouped(np.concatenate(a_all), np.concatenate(b_all), ends)
        starts = np.zeros(len(segments), np.int64)
        starts[order] = len(self.flat) + np.cumsum(sizes[order]) - sizes[order]
        for name, more in (("n_a", n_a), ("n_b", n_b), ("sizes", sizes), ("starts", starts), ("flat", flat)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def _grouped(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, B ids, groups of each segment; groups' numbers) of segments that end at byte offsets ends."""
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        at_b = np.searchsorted(ends_b, ends_a)
        both = ends_b[at_b] == ends_a
        stop_a, stop_b = np.flatnonzero(both) + 1, at_b[both] + 1
        start_a, start_b = np.append(0, stop_a[:-1]), np.append(0, stop_b[:-1])
        len_a, len_b = stop_a - start_a, stop_b - start_b
        numbers, bits = np.zeros(len(stop_a), np.int64), max(len(self.a_sizes), len(self.b_sizes)).bit_length()
        # groups of one shape are rows of a matrix; a key is written once for each distinct row
        shapes, shape = np.unique(np.stack([len_a, len_b], 1), axis=0, return_inverse=True)
        shape = shape.ravel()
        by_shape = np.argsort(shape, kind="stable")
        for (p, q), at in zip(shapes.tolist(), np.split(by_shape, np.cumsum(np.bincount(shape))[:-1])):
            cells = np.concatenate([a[start_a[at][:, None] + np.arange(p)], b[start_b[at][:, None] + np.arange(q)]], 1)
            if bits * (p + q) < 63:
                rows = (cells << (bits * np.arange(p + q))).sum(1)
            else:
                rows = np.ascontiguousarray(cells.astype(np.int32)).view(np.dtype((np.void, 4 * (p + q)))).ravel()
            _, first, back = np.unique(rows, return_index=True, return_inverse=True)
            own = [self.numbers.setdefault(key_of(r[:p], r[p:]), len(self.numbers)) for r in cells[first].tolist()]
            numbers[at] = np.array(own, np.int64)[back.ravel()]
        cuts = [np.searchsorted(x, ends) + 1 for x in (ends_a, ends_b, ends_a[both])]
        return *(np.diff(c, prepend=0) for c in cuts), numbers

    def links(self, key: str) -> dict[tuple[int, int], int]:
        """The linked id pairs of a group, with how often it links them."""
        a, b = ([int(x) for x in side.split(",")] for side in key.split("|"))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]).tolist(), np.cumsum(self.b_sizes[b]).tolist()
        out: dict[tuple[int, int], int] = {}
        i = j = 0
        while i < len(a) and j < len(b):
            pair = a[i], b[j]
            out[pair] = out.get(pair, 0) + 1
            p, q = ends_a[i], ends_b[j]
            i, j = i + (p <= q), j + (q <= p)
        return out


def key_of(a: list[int], b: list[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


def default_paths() -> tuple[str, str]:
    """The public 50k byte-level vocabulary and the 32k piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _numbered(items: list[str], places: dict[str, int]) -> list[int]:
    """Numbers of items, in order of their first appearance."""
    return [places.setdefault(x, len(places)) for x in items]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs, one after another."""
    stops = np.cumsum(sizes)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)


def _encode_block(pair: Pair, texts: list[str | None]) -> tuple[list[tuple], bytes, list[str], np.ndarray]:
    """(documents' cells; which groups each segment holds; groups' keys; their frequencies) of a batch."""
    places: dict[str, int] = {}
    docs = [np.array(_numbered(pair.segments(t), places), np.int32) if t else np.zeros(0, np.int32) for t in texts]
    at = pair.learn(list(places))
    bad, sizes = pair.n_a[at] < 0, pair.sizes[at]
    used, flat = np.unique(pair.flat[_spread(pair.starts[at], sizes)], return_inverse=True)
    flat = flat.ravel()
    starts = np.cumsum(sizes) - sizes
    known = list(pair.numbers)
    keys = [known[i] for i in used.tolist()]
    counts = np.stack([pair.n_a[at], pair.n_b[at], sizes], 1) if len(at) else np.zeros((0, 3), np.int64)
    cells, times = [], np.zeros(len(keys), np.int64)
    for ids in docs:
        if not len(ids) or bad[ids].any():
            cells.append((0, 0, 0, "", b""))
            continue
        sha = hashlib.sha256()
        for lo in range(0, len(ids), 200_000):
            part = ids[lo : lo + 200_000]
            groups = flat[_spread(starts[part], sizes[part])]
            times += np.bincount(groups, minlength=len(keys))
            sha.update((";" if lo else "").encode() + ";".join(map(keys.__getitem__, groups.tolist())).encode())
        cells.append((*counts[ids].sum(0).tolist(), sha.hexdigest(), ids.tobytes()))
    held = np.concatenate([[len(sizes)], sizes, flat]).astype(np.int32)
    return cells, held.tobytes(), keys, times


def encoded(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """A row a document, with its segments' numbers in its block, and a row a block, with its groups.

    A block is an Arrow batch, which bound_batches keeps to a few megabytes or one long text.
    """
    a_path, b_path = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.get(a_path, b_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            name = hashlib.sha256(os.urandom(16)).hexdigest()[:24]
            cells, held, keys, times = _encode_block(pair, batch.column(1).to_pylist())
            n_a, n_b, n_groups, sha, segments = zip(*cells)
            n = len(cells) + 1
            columns = [[name] * n, [*batch.column(0).to_pylist(), None], [*n_a, None], [*n_b, None], [*n_groups, None], [*sha, None], [*segments, None], [None] * (n - 1) + [held], [None] * (n - 1) + [keys], [None] * (n - 1) + [times]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENCODED)], schema=_ENCODED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), _ENCODED_SQL)


def group_links(groups: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """key, times, a, b, links: the links of each distinct group (key, times), expanded once."""
    a_path, b_path = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.get(a_path, b_path)
        for batch in batches:
            rows = [(key, times, a, b, n) for key, times in zip(*(batch.column(i).to_pylist() for i in (0, 1))) for (a, b), n in pair.links(key).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINKS)], schema=_LINKS)

    return groups.select("key", "times").mapInArrow(tidy(run), _LINKS_SQL)


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, pair_count, best: how many links of the corpus hold an id pair, and whether no pair of b has more."""
    pairs = links.groupBy("a", "b").agg(F.sum(F.col("times") * F.col("links")).alias("pair_count"))
    highest = pairs.groupBy("b").agg(F.max("pair_count").alias("highest")).withColumnRenamed("b", "hb")
    # a row for each id of B's vocabulary at most
    joined = pairs.join(F.broadcast(highest), F.col("b") == F.col("hb"))
    return joined.select("a", "b", "pair_count", (F.col("pair_count") == F.col("highest")).alias("best"))


def group_worths(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, n_links, n_best, count_sum of each distinct group, once."""
    found = links.join(pairs, ["a", "b"])
    n = F.col("links")
    return found.groupBy("key").agg(F.sum(n).alias("n_links"), F.sum(F.when(F.col("best"), n).otherwise(F.lit(0))).alias("n_best"), F.sum(n * F.col("pair_count")).alias("count_sum"))


_OUT_SQL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _block_sums(docs, block):
    """What a block's documents are worth: its groups' worths summed over segments, then over documents."""
    sums = np.zeros((len(docs), 3), np.int64)
    if len(block):
        held = np.frombuffer(block["held"].iloc[0], np.int32)
        sizes, flat = held[1 : 1 + held[0]], held[1 + held[0] :]
        worth = np.stack([np.array(block[c].iloc[0], np.int64) for c in ("n_links", "n_best", "count_sum")], 1)
        so_far = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(worth[flat], 0)])
        ends = np.cumsum(sizes)
        of = so_far[ends] - so_far[ends - sizes]
        for i, ids in enumerate(docs["segments"]):
            if ids:
                sums[i] = of[np.frombuffer(ids, np.int32)].sum(0)
    out = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups")} | {c: sums[:, i] for i, c in enumerate(("n_links", "n_best", "count_sum"))} | {"groups_sha256": docs["groups_sha256"]}
    out["doc_id"] = pd.array(out["doc_id"], "Int64")
    return pd.DataFrame(out)


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; the corpus's id
    pairs: a, b, pair_count, best)."""
    bound_batches(docs.sparkSession)
    blocks = written(encoded(docs, paths), "encoded")
    held = blocks.where("held is not null").select("block", F.posexplode(F.arrays_zip("keys", "times")).alias("at", "g"))
    held = held.select("block", "at", F.col("g.keys").alias("key"), F.col("g.times").alias("times"))
    groups = held.where("times > 0").groupBy("key").agg(F.sum("times").alias("times"))
    links = written(group_links(groups, paths), "links")
    pairs = written(pair_counts(links), "pairs")
    worths = written(group_worths(links, pairs), "worths")
    cells = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    back = held.select("block", "at", "key").join(worths, "key", "left").select("block", F.struct("at", *cells).alias("w"))
    back = back.groupBy("block").agg(F.sort_array(F.collect_list("w")).alias("w"))
    back = back.select("block", *[F.col(f"w.{c}").alias(c) for c in ("n_links", "n_best", "count_sum")])
    of_block = blocks.where("held is not null").select(F.col("block").alias("name"), "held").join(back, F.col("name") == F.col("block")).drop("block")
    rows = blocks.where("held is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "segments")
    out = rows.groupBy("block").cogroup(of_block.groupBy("name")).applyInPandas(_block_sums, _OUT_SQL)
    return out, pairs


def digest(docs: DataFrame) -> DataFrame:
    return align(docs)[0]
