"""URL filters: host and path rules first, then a character language-model ratio.

Rules (host suffix, path prefix) decide what they fit; the longest wins.  All other URLs are scored by two
smoothed variable-order Markov models, one of accepted and one of rejected URLs: the log-likelihood
difference per character, above a threshold, blocks a URL.

What a rule decides by is no evidence for other URLs, so models read a URL's evidence only: the host without
its top-level domain, and the path behind its first segment, with each run of digits as one.  Equal evidence
of a class counts once, so that no host outweighs the others by its pages.  Characters are folded to SYMBOLS (letters
without case, one symbol for digits, some signs, one for all else), so all n-grams of up to four symbols
have their own place in a table of 34**4 counts: exact, and of a size that no input exceeds.  An order's
probability is mixed with the shorter one's by Witten-Bell weights.  A class's model is the even mixture of a
model of the URLs that rules decide and of one of seeds: URLs built from words that public lists use as
names of their kinds, by the same patterns for both classes.

A fifth of the evidence is held out.  The threshold is the inner fence of the scores of what rules accept in it:
one and a half quartile ranges over the upper quartile.  A rule accepts a whole domain, whoever is in it;
quartiles stay where they are if some of these sites are of the rejected kinds.

Cases: a null url or one without '://' has empty host and path, fits no rule and is allowed (score 0);
equal URLs are judged alike; repeated rows are judged as often as they occur; an empty table gives no
rows; where only one class has URLs of its rules, both classes mix in the model of those; columns other than page_id and url are
ignored; a very long URL is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy, written

#: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words for kinds of sites that filters reject and accept.
KINDS = {
    "block": "casino poker slots roulette betting bets jackpot lottery bingo pharmacy pills viagra cialis steroids diet-pills porn xxx sex webcams escort dating-adult warez crack keygen torrent serials hacks phishing malware adserver ads tracker banners popups clicks affiliate spam seo-links backlinks payday loans fast-cash forex replica-watches fake-id get-rich miracle-cure",
    "allow": "news journal magazine library museum university school college wiki encyclopedia docs manual handbook science physics biology history geography weather climate garden recipes cooking travel railway city council parliament health hospital clinic music theatre cinema sports football books poetry language dictionary maps software support forum community photo art design",
}
PATTERNS = ("{}.com/x/", "www.{}.net/x/index", "online-{}.info/x/", "{}-online.org/x/start", "best-{}.net/x/1", "my{}.com/x/page/2", "{}-world.example.com/x/3", "the{}.net/x/home.html", "{}s.org/x/about", "free-{}.com/x/4")
ORDERS = 4
#: The threshold is so many quartile ranges over the upper quartile of accepted scores.
FENCE = 1.5
SYMBOLS = 34
_START, _END = 32, 33
_FOLD = np.full(256, 31, np.uint8)
for _i in range(26):
    _FOLD[97 + _i] = _FOLD[65 + _i] = _i
_FOLD[48:58] = 26
for _i, _c in enumerate(b"-./_"):
    _FOLD[_c] = 27 + _i


def seeds(kinds: dict[str, str] = KINDS) -> list[tuple[str, str]]:
    """(url, label) of all seeds."""
    return [(p.format(w), label) for label, words in kinds.items() for w in words.split() for p in PATTERNS]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruling: the longest rule that fits, and its verdict."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # longer ones override
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return p.select("page_id", "host", "path", rule.alias("rule"), ruling.alias("ruling"))


def evidence_of(host: Column, path: Column) -> Column:
    """The host without its last label, and the path behind its first segment; runs of digits as one 0."""
    return F.regexp_replace(F.concat(F.regexp_replace(host, r"\.?[^.]*$", ""), F.lit("/"), F.regexp_replace(path, r"^/[^/]*/?", "")), "[0-9]+", "0")


def codes_of(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(by order n, the code of the n symbols that end at each symbol; each symbol's text)."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) + 1 for d in data], np.int64)
    gap = ORDERS - 1  # start symbols before each text
    raw = np.full(int(sizes.sum()) + gap * len(data), _START, np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat((np.arange(len(data)) + 1) * gap, sizes)
    body = np.ones(len(at), bool)
    body[np.cumsum(sizes) - 1] = False
    raw[at[body]] = _FOLD[np.frombuffer(b"".join(data), np.uint8)]
    raw[at[~body]] = _END
    codes, code = [], np.zeros(len(at), np.int64)
    for n in range(ORDERS):
        code = raw[at - n] * SYMBOLS**n + code
        codes.append(code)
    return codes, np.repeat(np.arange(len(data)), sizes)


class Markov:
    """Witten-Bell mixture of orders over exact counts of all n-grams, shorter ones summed from longer ones."""

    def __init__(self, counts: np.ndarray):
        """counts: of n-grams of ORDERS symbols, by code."""
        self.tables = []
        longest = counts.astype(np.float64)
        for n in range(ORDERS, 0, -1):
            grams = longest.reshape(-1, SYMBOLS**n).sum(0)  # over the symbols further left
            by_context = grams.reshape(-1, SYMBOLS)
            self.tables.append((grams.astype(np.float32), by_context.sum(1).astype(np.float32), (by_context > 0).sum(1).astype(np.float32)))
        self.tables.reverse()

    def probability(self, codes: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(codes[0]), 1 / SYMBOLS)
        for code, (grams, total, kinds) in zip(codes, self.tables):
            t, k = total[code // SYMBOLS].astype(float), kinds[code // SYMBOLS].astype(float)
            p = np.where(t > 0, (grams[code] + k * p) / np.maximum(t + k, 1), p)
        return p


class Ratio:
    """The models of both classes (each a list, mixed evenly) and the threshold of the difference."""

    def __init__(self, models: dict[str, list[Markov]], threshold: float = 0.0):
        self.models, self.threshold = models, threshold

    def scores(self, texts: list[str]) -> np.ndarray:
        """Mean over symbols of log P(rejected) - log P(accepted)."""
        out, lo, size = np.zeros(len(texts)), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > 200_000 or i == len(texts) - 1:
                codes, of = codes_of(texts[lo : i + 1])
                log = {k: np.log(sum(m.probability(codes) for m in ms) / len(ms)) for k, ms in self.models.items()}
                out[lo : i + 1] = np.bincount(of, log["block"] - log["allow"]) / np.bincount(of)
                lo, size = i + 1, 0
        return out


def _held_out() -> Column:
    return F.pmod(F.xxhash64("evidence"), F.lit(5)) == 0


def count_codes(labelled: DataFrame) -> DataFrame:
    """(seed, label, code, c): counts of n-grams of ORDERS symbols: at most 4 * SYMBOLS ** ORDERS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}  # dense, of a fixed size each
        for b in batches:
            texts, labels, seed = (b.column(i).to_pylist() for i in range(3))
            for kind in sorted(set(zip(seed, labels))):
                part = [t for t, x in zip(texts, zip(seed, labels)) if x == kind]
                have = sums.setdefault(kind, np.zeros(SYMBOLS**ORDERS, np.int64))
                for lo in range(0, len(part), 2000):
                    codes = codes_of(part[lo : lo + 2000])[0][-1]
                    k, c = np.unique(codes, return_counts=True)
                    have[k] += c
        for (seed, label), have in sums.items():
            k = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([seed] * len(k), pa.bool_()), pa.array([label] * len(k), pa.string()), pa.array(k), pa.array(have[k])], names=["seed", "label", "code", "c"])

    counts = labelled.select("evidence", "label", "seed").mapInArrow(tidy(run), "seed boolean, label string, code bigint, c bigint")
    return counts.groupBy("seed", "label", "code").agg(F.sum("c").alias("c"))


def fit(labelled: DataFrame, kinds: dict[str, str] = KINDS) -> Ratio:
    """labelled: evidence and label ('allow' or 'block'); kinds: words for seeds of both."""
    spark = labelled.sparkSession
    bound_batches(spark)
    own = spark.createDataFrame(seeds(kinds), "url string, label string")
    cut = F.expr("substring_index(url, '/', 1)"), F.expr("substr(url, instr(url, '/'))")
    own = own.select(evidence_of(*cut).alias("evidence"), "label", F.lit(True).alias("seed"))
    rows = written(labelled.select("evidence", "label", F.lit(False).alias("seed")).unionByName(own).distinct(), "evidence")
    got = count_codes(rows.where(~_held_out())).toPandas()
    found: dict[tuple, Markov] = {}
    for key, part in got.groupby(["seed", "label"]):
        counts = np.zeros(SYMBOLS**ORDERS, np.int64)
        counts[part["code"]] = part["c"]
        found[key] = Markov(counts)
    ordinary = {"block": found.get((False, "block"), found.get((False, "allow"))), "allow": found.get((False, "allow"), found.get((False, "block")))}
    ratio = Ratio({k: [m for m in (ordinary[k], found[True, k]) if m is not None] for k in ordinary})
    held = score(rows.where(_held_out()), ratio)
    quartiles = held.where("label = 'allow'").groupBy("seed").agg(F.percentile_approx("score", [0.25, 0.75], 10000).alias("q"))
    q = sorted((r["seed"], r["q"]) for r in quartiles.collect())[0][1]  # of rules; of seeds where rules accept nothing
    ratio.threshold = max(0.0, q[1] + FENCE * (q[1] - q[0]))
    return ratio


def score(rows: DataFrame, ratio: Ratio) -> DataFrame:
    """label, seed and score of rows with evidence."""
    shared = rows.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.scores(b.column(2).to_pylist()))], names=["label", "seed", "score"])

    return rows.select("label", "seed", "evidence").mapInArrow(tidy(run), "label string, seed boolean, score double")


def judge(pages: DataFrame, rules=RULES, kinds: dict[str, str] = KINDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    bound_batches(pages.sparkSession)
    r = ruled(pages, rules).withColumn("evidence", evidence_of(F.col("host"), F.col("path")))
    labelled = r.where("ruling is not null").select("evidence", F.col("ruling").alias("label"))
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled, kinds))
    names = ["page_id", "host", "path", "rule", "verdict", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            real = [bool(h or p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            s = np.where(real, shared.value.scores(b.column(5).to_pylist()), 0.0)
            verdict = [r or ("block" if x and v > shared.value.threshold else "allow") for r, x, v in zip(b.column(4).to_pylist(), real, s.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), b.column(2), b.column(3), pa.array(verdict, pa.string()), pa.array(s, pa.float64())], names=names)

    return r.mapInArrow(tidy(run), "page_id bigint, host string, path string, rule string, verdict string, score double")
