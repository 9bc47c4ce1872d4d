"""Quality rules by n-gram perplexity: a modified Kneser-Ney model over UTF-8 bytes, per language.

Spark counts the byte 5-grams of all distinct texts by language and derives the lower orders' continuation
counts, discounts, interpolated probabilities and back-off weights as DataFrames.  Texts fall into two
halves by their hash, each half has its own model, and a text is scored by the model of the other half:
a model that had counted a text would find even its noise likely.

The model lives in sorted hash arrays: keys of kind, language and n-gram, mixed by a one-to-one hash and in
ascending order, values beside them, and an index of the keys' leading bits; nothing is dropped and no two
entries share a key.  The arrays grow with the corpus, so they come in slices of about SLICE entries.  What
scores a byte (its n-grams and their contexts) shares the model's language and the two bytes before it, so
slices are ranges of these and each scores its own bytes of a text.  Slices are broadcast one after another,
each to one pass over the texts of its languages, and a text's losses are added up as integers: sums do not
depend on where slices begin.  One way serves any size; what grows is the number of passes.

A document's log-perplexity is its log-loss per word, words being those that hold a letter, so that what
stands between words costs but does not count.  Outside its language's band it is rejected; a band reaches
from the lower to the upper outer fence (three quartile ranges beyond the quartiles) of all the language's
distinct texts that pass the base rules.

Cases: a null text has no words and fails; null languages form a language of their own; documents
without a letter have no perplexity and are rejected; copies count once in the model and the bands, and each is judged; an empty
table gives no rows; columns other than doc_id, text and lang are ignored; over 2**19 languages raise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, give_back, small, tidy, written

ORDER = 5
#: Model entries of a slice, about: 12 bytes each, and an index of 4 bytes each at most.
SLICE = 1 << 21
#: Losses are added up in parts of a nat.
UNIT = 1 << 24
#: Keys that hold over one row in so many are joined by broadcast; there are no more of them than that.
HOT = 1000
#: A pass reads only its slice's languages where they are no more than these.
_LISTED = 100
LANGUAGES = 1 << 19
#: A band reaches so many quartile ranges beyond the quartiles (outer fences), each at least FLOOR nats wide.
FENCE, FLOOR = 3.0, 0.1
#: Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS, REPEAT_PERCENT = 50, 50
_STEP = 200_000
_PAD = b"\n" * (ORDER - 1)
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_GAP = np.isin(np.arange(256), list(SPACES))
#: Bytes of ASCII letters and of all characters beyond ASCII.
_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123)) | (np.arange(256) > 127)
_INK = ~np.isin(np.arange(256), list(SPACES)) & ~((np.arange(256) & 0xC0) == 0x80)


def language_codes(docs: DataFrame) -> dict[str | None, int]:
    """A number for each language, null included: 48 bytes a language on the driver, LANGUAGES at most."""
    langs = [r[0] for r in docs.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(langs) > LANGUAGES:
        raise ValueError(f"lang has over {LANGUAGES} values")
    return {x: i for i, x in enumerate(sorted(langs, key=lambda x: (x is not None, x)))}


def text_half(text: Column) -> Column:
    """The half, 0 or 1, that a text falls into."""
    return F.xxhash64(text, F.lit("half")).bitwiseAND(F.lit(1)).cast("int")


def _stream(texts: list, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(5-gram ending at each byte, code of each byte's text, bytes per text)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    raw = np.frombuffer(_PAD + _PAD.join(data), np.uint8).astype(np.int64)
    gram = raw[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        gram |= raw[ORDER - 1 - k : len(raw) - k] << (8 * k)
    # the pads between texts are context only
    skip = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)) * (ORDER - 1), sizes)
    return gram[skip], np.repeat(np.asarray(codes, np.int64), sizes), sizes


def _slices(texts: list) -> Iterator[slice]:
    """Ranges of texts of _STEP characters, which bounds the arrays made from them."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _STEP or i == len(texts) - 1:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def count_grams(texts: DataFrame, codes: dict) -> DataFrame:
    """(lang, gram, c): how often each byte 5-gram occurs in each half of each language.

    lang is twice the language's code, plus the half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for b in batches:
            texts, own = b.column(0).to_pylist(), _codes(b.column(1), b.column(2), codes)
            for part in _slices(texts):
                gram, lang, _ = _stream(texts[part], own[part])
                k, c = np.unique(gram | lang << 40, return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > 500_000:
                    k, c = _merged(keys, counts)
                    keys, counts, held = [k], [c], 0
                    if len(k) > 250_000:  # Spark adds up what a task gives in parts
                        yield _grams(k, c)
                        keys, counts = [], []
        if keys:
            yield _grams(*_merged(keys, counts))

    out = texts.select("text", "lang", text_half(F.col("text"))).mapInArrow(tidy(run), "lang int, gram bigint, c bigint")
    return out.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _codes(langs: pa.Array, halves: pa.Array, codes: dict) -> np.ndarray:
    return np.array([2 * codes[x] for x in langs.to_pylist()], np.int64) + halves.to_numpy(zero_copy_only=False)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(text, lang, key): each text of a language once; only texts that occur more than once are shuffled."""
    keyed = docs.select("text", "lang", F.xxhash64(F.col("lang").isNull(), "lang", "text").alias("key"))
    again = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    few = small(again)
    copies = keyed.join(few, "key", "left_semi").dropDuplicates(["key"])
    return keyed.join(few, "key", "left_anti").unionByName(copies).select("text", "lang", "key")


def _grams(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array((k >> 40).astype(np.int32)), pa.array(k & ((1 << 40) - 1)), pa.array(c.astype(np.int64))], names=["lang", "gram", "c"])


def _low(n_bytes: int):
    return F.col("gram").bitwiseAND(F.lit((1 << (8 * n_bytes)) - 1))


def kneser_ney(top: DataFrame) -> DataFrame:
    """Model rows (kind, lang, gram, value) from the counts of the highest order.

    kind k: log-probability of a k-gram; kind 16 + k: log weight of a k-gram's context, the k - 1 bytes
    before its last, for what the k-gram table leaves to the next lower order.
    """
    counts = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):  # distinct left extensions
        counts[k] = counts[k + 1].select("lang", _low(k).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
        counts[k] = written(counts[k], f"kn{k}")
    rows, lower = None, None
    for k in range(1, ORDER + 1):
        c = counts[k]
        n = c.groupBy("lang").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.expr("n1 / greatest(n1 + 2 * n2, 1)")
        d = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0)))).alias(f"d{i}") for i in (1, 2, 3)]
        discounts = n.select("lang", *d)
        near = c.withColumn("ctx", F.shiftright("gram", 8))
        contexts = near.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), *[F.count_if(cond).alias(f"m{i}") for i, cond in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") >= 3))])
        contexts = contexts.join(discounts, "lang").withColumn("left", (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total"))
        p = near.join(contexts, ["lang", "ctx"])
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = (F.col("c") - off) / F.col("total")
        if lower is None:
            p = p.select("lang", "gram", "c", (own + F.col("left") / 256).alias("p"))
        else:
            below = lower.select(F.col("lang").alias("l"), F.col("gram").alias("g"), F.col("p").alias("q"))
            p = p.join(below, (F.col("lang") == F.col("l")) & (_low(k - 1) == F.col("g")))
            p = p.select("lang", "gram", "c", (own + F.col("left") * F.col("q")).alias("p"))
        lower = written(p, f"p{k}")
        these = lower.select(F.lit(k).alias("kind"), "lang", "gram", F.log("p").cast("float").alias("value"))
        these = these.unionByName(contexts.select(F.lit(16 + k).alias("kind"), "lang", F.col("ctx").alias("gram"), F.log("left").cast("float").alias("value")))
        rows = these if rows is None else rows.unionByName(these)
    return rows


def hash_keys(kind: int | np.ndarray, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """64-bit keys, one for each (kind, lang, gram): odd factors and shifted differences can be undone."""
    kind = np.asarray(kind, np.uint64)
    kind = np.where(kind > 16, kind - np.uint64(11), kind)  # 1 to 5 and 17 to 21 in four bits
    x = gram.astype(np.uint64) | lang.astype(np.uint64) << np.uint64(40) | kind << np.uint64(60)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class HashArrays:
    """Sorted keys, their values, and where each leading-bit range begins."""

    def __init__(self, keys: list[bytes], values: list[bytes]):
        """keys ascend over all parts."""
        self.keys = np.frombuffer(b"".join([*keys, b"\xff" * 8]), "<u8")
        self.values = np.frombuffer(b"".join([*values, bytes(4)]), "<f4")
        n = len(self.keys) - 1
        self.bits = min(23, max(8, n.bit_length() - 1))
        self.begin = np.searchsorted(self.keys[:n], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, found) of each key."""
        at = self.begin[keys >> np.uint64(64 - self.bits)]
        got = self.keys[at]
        more = np.flatnonzero(got < keys)
        while len(more):
            at[more] += 1
            got[more] = now = self.keys[at[more]]
            more = more[now < keys[more]]
        return self.values[at], (got == keys) & (at < len(self.keys) - 1)


class Packed:
    """The parts of HashArrays as bytes, which a worker that unpickles them makes into arrays; the driver does not."""

    def __init__(self, keys: list[bytes], values: list[bytes]):
        self.keys, self.values = keys, values

    def __reduce__(self):
        return HashArrays, (self.keys, self.values)

    def open(self) -> HashArrays:
        return HashArrays(self.keys, self.values)


def units_of(kind: int | np.ndarray, lang: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) unit that needs an entry.

    A unit is a model's number and the two bytes before the last, the nearer one first.  Entries with one
    byte of context, or none, are needed by all units that agree with them.
    """
    kind, lang, gram = np.asarray(kind, np.int64), lang.astype(np.int64), gram.astype(np.int64)
    context, size = np.where(kind > 16, gram, gram >> 8), (kind & 15) - 1
    first = lang << 16 | np.where(size > 0, (context & 255) << 8, 0) | np.where(size > 1, context >> 8 & 255, 0)
    return first, first + np.where(size > 1, 0, np.where(size > 0, (1 << 8) - 1, (1 << 16) - 1))


def slice_cuts(model: DataFrame) -> np.ndarray:
    """The first unit of each slice, ascending from 0: a number a slice to the driver.

    Running sums go by model (2 * LANGUAGES rows at most) and by unit inside a model (2 ** 16 at most).
    """
    context = F.expr("if(kind > 16, gram, shiftright(gram, 8))")
    near = F.expr("if(kind % 16 > 1, 1, 0)") * context.bitwiseAND(F.lit(255))
    far = F.expr("if(kind % 16 > 2, 1, 0)") * F.shiftright(context, 8).bitwiseAND(F.lit(255))
    unit = F.col("lang").cast("bigint") * 65536 + near * 256 + far
    n = written(model.groupBy("lang", unit.alias("unit")).agg(F.count("*").alias("n")), "units")
    before = n.groupBy("lang").agg(F.sum("n").alias("all")).select("lang", (F.sum("all").over(Window.orderBy("lang")) - F.col("all")).alias("before"))
    start = F.col("before") + F.sum("n").over(Window.partitionBy("lang").orderBy("unit")) - F.col("n")
    cuts = n.join(before, "lang").select("unit", F.floor(start / SLICE).alias("slice")).groupBy("slice").agg(F.min("unit").alias("unit"))
    got = np.sort(np.array([r["unit"] for r in cuts.collect()] or [0], np.int64))
    got[0] = 0
    return got


def hash_arrays(model: DataFrame, cuts: np.ndarray) -> DataFrame:
    """(slice, keys, values): a row a slice, its entries' keys in ascending order and their values, as bytes."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, lang, gram, value = (b.column(i).to_numpy() for i in range(4))
            first, last = (np.searchsorted(cuts, u, "right") - 1 for u in units_of(kind, lang, gram))
            times = last - first + 1
            of = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            # signed numbers in the order of the unsigned keys
            keys = (hash_keys(kind, lang, gram) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.repeat(keys, times)), pa.array(np.repeat(value, times))], names=["slice", "key", "value"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, values = None, [], []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(keys)], pa.binary()), pa.array([b"".join(values)], pa.binary())], names=["slice", "keys", "values"])

        for b in batches:
            of = b.column(0).to_numpy()
            key = (b.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)).astype("<u8")
            value = b.column(2).to_numpy().astype("<f4")
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(of)]):
                if of[lo] != now:
                    if now is not None:
                        yield packed()
                    now, keys, values = int(of[lo]), [], []
                keys.append(key[lo:hi].tobytes())
                values.append(value[lo:hi].tobytes())
        if now is not None:
            yield packed()

    keyed = model.select("kind", "lang", "gram", "value").mapInArrow(tidy(key), "slice bigint, key bigint, value float")
    return keyed.repartition(len(cuts), "slice").sortWithinPartitions("slice", "key").mapInArrow(tidy(pack), "slice bigint, keys binary, values binary")


def log_probabilities(arrays: HashArrays, gram: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Natural log-probability of each byte given the four before it."""
    value, found = arrays.find(hash_keys(ORDER, lang, gram))
    out = np.where(found, value, np.float32(0)).astype(np.float64)
    left = np.flatnonzero(~found)
    for k in range(ORDER, 0, -1):
        if not len(left):
            break
        g, lg = gram[left] & ((1 << (8 * k)) - 1), lang[left]
        weight, known = arrays.find(hash_keys(16 + k, lg, g >> 8))
        out[left] += np.where(known, weight, 0)
        if k == 1:
            out[left] += np.log(1 / 256)
            break
        value, found = arrays.find(hash_keys(k - 1, lg, g & ((1 << (8 * (k - 1))) - 1)))
        out[left] += np.where(found, value, 0)
        left = left[~found]
    return out


def repeat_words(words: list) -> int:
    """Words that lie in three-word windows found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    raw = np.frombuffer(data, np.uint8)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), int(_INK[raw].sum()), int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeat_words(words)


BASE = "doc_id bigint, key bigint, lang_code int, n_lettered bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_NAMES = [x.split()[0] for x in BASE.split(", ")]


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", text_half(F.col("text")).alias("half"), F.xxhash64(F.col("lang").isNull(), "lang", "text").alias("key"))


def base_table(docs: DataFrame, codes: dict) -> DataFrame:
    """BASE of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            lettered = [lettered_words(texts[part]) for part in _slices(texts)]
            lang = np.array([codes[x] for x in b.column(2).to_pylist()], np.int32)
            columns = [b.column(0).cast(pa.int64()), b.column(4), pa.array(lang), pa.array(np.concatenate([np.zeros(0, np.int64), *lettered])), *(pa.array(base[:, i]) for i in range(5))]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return _marked(docs).mapInArrow(tidy(run), BASE)


def lettered_words(texts: list) -> np.ndarray:
    """How many words of each text hold a letter."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    at = np.flatnonzero(_LETTER[raw])
    word = np.cumsum(_GAP[raw], dtype=np.int32)[at]
    first = at[np.flatnonzero(np.diff(word, prepend=-1))]
    return np.bincount(np.searchsorted(np.cumsum([len(d) + 1 for d in data]), first, "right"), minlength=len(texts))


def losses(texts: list, own: np.ndarray, arrays: HashArrays, lo: int, hi: int) -> np.ndarray:
    """Sums of the losses, in parts of 1 / UNIT nat, of each text's bytes whose units are from lo to hi - 1."""
    out = []
    for part in _slices(texts):
        gram, lang, sizes = _stream(texts[part], own[part])
        unit = units_of(ORDER, lang, gram)[0]
        at = np.flatnonzero((unit >= lo) & (unit < hi))
        sums = np.zeros(len(gram) + 1, np.int64)
        sums[1:][at] = np.rint(log_probabilities(arrays, gram[at], lang[at]) * -UNIT).astype(np.int64)
        ends = np.cumsum(sizes)
        np.cumsum(sums, out=sums)
        out.append(sums[ends] - sums[ends - sizes])
    return np.concatenate([np.zeros(0, np.int64), *out])


def _broadcast(array: DataFrame):
    """A slice's row of hash_arrays as a broadcast; the driver keeps no bytes of it."""
    rows = array.collect()
    shared = array.sparkSession.sparkContext.broadcast(Packed([bytes(r["keys"]) for r in rows], [bytes(r["values"]) for r in rows]))
    del rows
    give_back()
    return shared


def slice_losses(docs: DataFrame, codes: dict, array: DataFrame, lo: int, hi: int) -> DataFrame:
    """(key, loss): the losses of one slice, whose row of hash_arrays is array, for each text and language that may have some; written."""
    langs = [x for x, c in codes.items() if lo >> 17 <= c <= (hi - 1) >> 17]
    if len(langs) <= min(_LISTED, len(codes) - 1):
        docs = docs.where(F.col("lang").isin([x for x in langs if x is not None]) | (F.col("lang").isNull() if None in langs else F.lit(False)))
    shared = _broadcast(array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = shared.value
        for b in batches:
            # a text is scored by the model of the other half; copies in a batch once
            own, (keys, first) = _codes(b.column(2), b.column(3), codes) ^ 1, np.unique(b.column(4).to_numpy(), return_index=True)
            mine = (own[first] >= lo >> 16) & (own[first] <= (hi - 1) >> 16)
            keys, first = keys[mine], first[mine]
            texts = b.column(1).take(pa.array(first)).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(losses(texts, own[first], arrays, lo, hi))], names=["key", "loss"])

    part = _marked(docs).mapInArrow(tidy(run), "key bigint, loss bigint").groupBy("key").agg(F.max("loss").alias("loss"))
    part = written(part, "slice")
    shared.destroy()
    return part


def text_losses(docs: DataFrame, model: DataFrame, codes: dict) -> DataFrame:
    """(key, loss) of each text and language: the sums over all slices."""
    cuts = slice_cuts(model)
    arrays = written(hash_arrays(model, cuts), "arrays")
    ends = [*cuts[1:].tolist(), 2 * len(codes) << 16]
    summed = lambda: reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("loss").alias("loss"))
    parts: list[DataFrame] = []
    for i, (lo, hi) in enumerate(zip(cuts.tolist(), ends)):
        parts.append(slice_losses(docs, codes, arrays.where(F.col("slice") == i), lo, hi))
        if len(parts) == 16:  # plans stay short
            parts = [written(summed(), "losses")]
    return written(summed(), "losses")


def score(docs: DataFrame, model: DataFrame, codes: dict) -> DataFrame:
    """BASE and log_perplexity of every document."""
    base, loss = written(base_table(docs, codes), "base"), text_losses(docs, model, codes)
    # HOT keys at most
    hot = base.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > base.count() / HOT).select("key")
    hot = F.broadcast(written(hot.join(loss, "key", "left"), "hot"))
    out = base.join(hot.select("key"), "key", "left_anti").join(loss, "key", "left").unionByName(base.join(hot, "key"))
    lettered = F.when(F.col("n_lettered") > 0, F.coalesce("loss", F.lit(0)) / UNIT / F.col("n_lettered"))
    return out.withColumn("log_perplexity", lettered)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, log_perplexity and kept of every document."""
    bound_batches(docs.sparkSession)
    codes, texts = language_codes(docs), distinct_texts(docs)
    model = written(kneser_ney(written(count_grams(texts, codes), "grams")), "model")
    scored = written(score(docs, model, codes), "scored")
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    scored = scored.withColumn("base_failed", failed)
    once = scored.where("not base_failed").groupBy("lang_code", "key").agg(F.first("log_perplexity").alias("log_perplexity"))
    bands = once.groupBy("lang_code").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 10000).alias("q"))
    wide = F.greatest(F.expr("q[1] - q[0]"), F.lit(FLOOR))
    bands = bands.select("lang_code", (F.expr("q[0]") - FENCE * wide).alias("lo"), (F.expr("q[1]") + FENCE * wide).alias("hi"))
    # a band a language, LANGUAGES at most
    out = scored.join(F.broadcast(bands), "lang_code", "left")
    inside = F.coalesce(F.expr("log_perplexity between lo and hi"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject."""
    rejected = small(written(judge(docs).where("not kept").select(F.col("key").alias("__key")).distinct(), "rejected"))
    return docs.join(rejected, F.xxhash64(docs["lang"].isNull(), docs["lang"], docs["text"]) == rejected["__key"], "left_anti")
