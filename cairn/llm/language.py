"""Language identification by nearest centroid.

A text is a TF-IDF vector over hashed character bigrams and trigrams of its lower-cased letters (all
else counts as a space).  Every language has several centroids, clustered by spherical k-means over a
bounded sample of its labelled documents; a text gets the language of the centroid with the greatest
cosine, and is rejected if this cosine is under half of what all but the farthest twentieth of the language's
sample reach, so that some junk in the sample moves nothing.  Document frequencies cover all training
documents.

Cases: a null text and a text without letters are 'und' with score 0; null languages are not learnt;
without any training document all are 'und'; repeated rows are predicted alike; an empty table gives
no rows; over LANGUAGES languages raise; columns other than doc_id, text and (for training) lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy, written

DIM_BITS = 12
DIM = 1 << DIM_BITS
CENTROIDS, ROUNDS = 3, 12
#: Bound of the sample that centroids are fitted on: about so many documents of each language.
SAMPLE = 400
#: Rejected are cosines below this part of this quantile of the language's sample, smaller for short texts.
MARGIN, QUANTILE = 0.5, 0.05
#: Languages at most: 48 KB each are gathered and sent to the tasks.
LANGUAGES = 2000
_STEP = 1 << 20
_LETTER = np.array([chr(c).isalpha() for c in range(0xD800)] + [False] * 0x800 + [chr(c).isalpha() for c in range(0xE000, 0x10000)])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts_of(texts: list) -> np.ndarray:
    """(texts, DIM) counts of hashed bigrams and trigrams; float32."""
    low = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in low], np.int64) + 2  # a space at both ends, so no n-gram reaches into the next text
    c = np.frombuffer(("".join(f" {t} " for t in low) + "   ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[~np.where(c < 0x10000, _LETTER[np.minimum(c, 0xFFFF)], True)] = 32
    n = int(sizes.sum())
    base = np.repeat(np.arange(len(texts), dtype=np.int64) << DIM_BITS, sizes)
    blank = c == 32
    shift = np.uint32(32 - DIM_BITS)
    out = np.zeros(len(texts) << DIM_BITS, np.float32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    for h, dull in ((two, blank[:-1] & blank[1:]), (two[:-1] * np.uint32(5) + c[2:] * np.uint32(0xC2B2AE3D), blank[:-2] & blank[1:-1])):
        h = h * np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h = h * np.uint32(0x165667B1)
        at = (base + (h[:n] >> shift))[~dull[:n]]
        out += np.bincount(at, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), DIM)


def pieces(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size for counts_of."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > _STEP or i - lo >= 255 or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def vectors(texts: list, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors (zero where a text has no letters)."""
    x = np.log1p(counts_of(texts)) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centroids; seeds stand at even ranks by their cosine to the mean, and the farthest texts
    (QUANTILE of all) move no centroid, so none ends at an outlier."""
    k = min(k, len(x))
    ranked = np.argsort(x @ x.sum(0), kind="stable")
    cents = x[ranked[(2 * np.arange(k) + 1) * len(x) // (2 * k)]]
    for _ in range(rounds):
        cos = x @ cents.T
        near = np.where(cos.max(1) >= np.quantile(cos.max(1), QUANTILE), cos.argmax(1), -1)
        sums = np.stack([x[near == j].sum(0) if (near == j).any() else cents[j] for j in range(len(cents))])
        cents = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return cents


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], cents: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.cents, self.least = idf, langs, cents, least

    def predict(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or 'und', score, rejected) of each text."""
        names: list[str] = []
        scores, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        for lo, hi in pieces(texts):
            part = texts[lo:hi]
            cos = vectors(part, self.idf) @ self.cents.T if self.langs else np.zeros((len(part), 0))
            for i, t in enumerate(part):
                if not self.langs or not has_letter(t):
                    names.append("und")
                    continue
                j = int(cos[i].argmax())
                names.append(self.langs[j])
                scores[lo + i] = min(1.0, max(0.0, float(cos[i, j])))
                # a text of n letters can fill n of the dimensions only
                short = min(1.0, (len(t) / 400) ** 0.5)
                rejected[lo + i] = scores[lo + i] < MARGIN * self.least[j] * short
        return names, scores, rejected


def fit(training: DataFrame) -> Model:
    """training: doc_id, text, lang, neither text nor lang null."""
    bound_batches(training.sparkSession)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in pieces(texts):
                df[:DIM] += (counts_of(texts[lo:hi]) > 0).sum(0)
                df[DIM] += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(df)], names=["f", "n"])

    rows = training.select("text").mapInArrow(tidy(frequencies), "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIM + 1)
    df[rows["f"]] = rows["n"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])).astype(np.float32) + np.float32(0.1)
    # about SAMPLE documents of each language, by a hash of doc_id
    sizes = written(training.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    if (n_langs := sizes.count()) > LANGUAGES:
        raise ValueError(f"{n_langs} languages, over {LANGUAGES}")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = training.join(F.broadcast(sizes), "lang").where(chance < F.lit(float(SAMPLE)) / F.col("n"))

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(1).to_pylist(), b.column(0).to_pylist()
            for lo, hi in pieces(texts):
                x = vectors(texts[lo:hi], idf).astype("<f2")
                yield pa.RecordBatch.from_arrays([pa.array(langs[lo:hi], pa.string()), b.column(2).slice(lo, hi - lo).cast(pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "doc_id", "v"])

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "v"])
        x = np.stack([np.frombuffer(v, "<f2") for v in pdf["v"]]).astype(np.float32)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "c": [], "least": []})
        cents = spherical_kmeans(x, CENTROIDS, ROUNDS)
        least = float(np.quantile((x @ cents.T).max(1), QUANTILE))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(cents), "c": [c.astype("<f4").tobytes() for c in cents], "least": [least] * len(cents)})

    found = sample.select("lang", "text", "doc_id").mapInArrow(tidy(vectorise), "lang string, doc_id bigint, v binary")
    found = found.groupBy("lang").applyInPandas(cluster, "lang string, c binary, least double").toPandas().sort_values(["lang", "c"])
    cents = np.stack([np.frombuffer(c, "<f4") for c in found["c"]]) if len(found) else np.zeros((0, DIM), np.float32)
    return Model(idf, found["lang"].tolist(), cents, found["least"].to_numpy(float))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row; reads doc_id and text only."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, rejected = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, lang_pred string, score double, rejected boolean")


def held_out():
    """Every third document by its id's crc32, kept out of training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))


def digest(docs: DataFrame) -> DataFrame:
    out = predict(docs, fit_documents(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def accepted_documents(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that are rejected: 'und', or far from every language."""
    model = fit_documents(docs)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, _, rejected = shared.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([n != "und" and not r for n, r in zip(names, rejected.tolist())], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
