"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source with share p of all tokens gets weight p ** a / sum of all p ** a.  The exponent a is bisected
(each job tries 32 points at once) to the greatest value, nearest to the natural shares, at which the
weights reach a target entropy, or no source is repeated more than the limit.  The budget is the least
at which no source falls under a floor of epochs, so with floor 1 every document is used.

A source's epochs are whole passes and a part of one.  The part is taken in blocks: documents fall into
1024 blocks of their source by a hash, blocks are permuted by another, whole blocks are taken until the
next would pass the budget, and that one is taken document by document.  All passes of all documents
get a place in (0, 1): the passes of a source share it out evenly, each in its own block permutation,
so sorting by place interleaves the sources at their weights.

Cases: a null source is a source of its own; a null text has no tokens; sources without tokens have
weight 0 and one pass; repeated rows are documents like others; an empty table gives no rows; other
columns are kept, but for earlier mix_ columns, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCKS, POINTS = 1024, 32
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    solid = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(solid == "", F.lit(0)).otherwise(F.regexp_count(solid, F.lit(SPACE)) + 1).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def solve_exponent(shares: DataFrame, entropy: float | None = None, repetition: float | None = None, rounds: int = 5) -> float:
    """The greatest exponent in [0, 1] that meets the target, from a table of shares (p > 0).

    entropy is a part of the greatest possible one, log(sources); repetition is the greatest ratio of
    two sources' epochs.  Each round is one aggregate over the shares, so any number of sources will do.
    """
    n, top, low = shares.agg(F.count("*"), F.max("p"), F.min("p")).first()
    if n < 2:
        return 1.0
    if repetition is not None:  # epochs go as p ** (a - 1): their greatest ratio is (top / low) ** (1 - a)
        measure = lambda a: (top / low) ** (1 - a)
        met = lambda v: v <= repetition * (1 + 1e-12)
        lo, hi = 0.0, 1.0
        if met(measure(0.0)):
            return 0.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if met(measure(mid)) else (mid, hi)
        return hi
    target = entropy * math.log(n)
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / POINTS for i in range(POINTS + 1)]
        # entropy of weights p**a / z is log z - a * sum(p**a log p) / z
        sums = shares.agg(*[F.sum(F.pow("p", F.lit(a))).alias(f"z{i}") for i, a in enumerate(grid)], *[F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"s{i}") for i, a in enumerate(grid)]).first()
        flat = [math.log(sums[f"z{i}"]) - a * sums[f"s{i}"] / sums[f"z{i}"] for i, a in enumerate(grid)]
        best = max((i for i, h in enumerate(flat) if h >= target - 1e-12), default=0)
        if best == POINTS:
            return hi
        lo, hi = grid[best], grid[best + 1]
    return lo


def plan_sources(docs: DataFrame, entropy: float | None, repetition: float | None, floor: float) -> DataFrame:
    """(__src, tokens, weight, epochs) from docs with __src and __tokens."""
    sources = written(docs.groupBy("__src").agg(F.sum("__tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(total or 1))).alias("p"))
    a = solve_exponent(shares, entropy, repetition)
    raw = sources.withColumn("raw", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))).otherwise(0.0))
    z, budget = raw.agg(F.sum("raw"), F.max(F.col("tokens") / F.col("raw")).alias("b")).first()
    weight = F.col("raw") / F.lit(z or 1.0)
    # budget: floor epochs of the source that is used least
    whole = (budget or 0.0) * (z or 1.0) * floor
    epochs = F.when(F.col("tokens") > 0, F.greatest(F.lit(floor), F.round(weight * F.lit(whole) / F.col("tokens"), 9))).otherwise(1.0)
    return raw.select("__src", "tokens", weight.alias("weight"), epochs.alias("epochs"))


def mix(docs: DataFrame, entropy: float | None = None, repetition: float | None = 2.0, floor: float = 1.0, tokens: Column | None = None) -> DataFrame:
    """docs with mix_tokens, mix_weight, mix_epochs and mix_copies (passes that the document is in).

    tokens counts a document's tokens (words by default).  Texts are neither shuffled nor sorted: the
    plan joins documents to small tables of sources and blocks, and only the documents of the one block
    a source that its budget ends in are ordered.
    """
    docs = docs.drop("mix_tokens", "mix_weight", "mix_epochs", "mix_copies")
    count = word_count(F.col("text")) if tokens is None else tokens
    dealt = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(BLOCKS)).cast("int")
    order = F.xxhash64("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    marked = docs.select(row, source_key(F.col("source")).alias("__src"), count.alias("__tokens"), dealt.alias("__block"), order.alias("__order"))
    narrow = written(marked.select("__src", "__tokens", "__block", "__order"), "mixdocs")
    plan = written(plan_sources(narrow, entropy, repetition, floor), "mixplan")
    blocks = narrow.groupBy("__src", "__block").agg(F.sum("__tokens").alias("n"))
    budget = plan.select("__src", F.floor("epochs").cast("int").alias("passes"), ((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("budget"))
    turn = F.xxhash64("__src", "__block", F.lit("turn"))
    so_far = Window.partitionBy("__src").orderBy(turn, "__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("before", F.sum("n").over(so_far) - F.col("n")).join(budget, "__src")
    # of the partial pass a block gives all, none, or what is left of the budget
    left = F.greatest(F.lit(0.0), F.least(F.col("n").cast("double"), F.col("budget") - F.col("before")))
    blocks = written(blocks.select("__src", "__block", "passes", left.alias("left"), "n"), "mixblocks")
    cut = blocks.where("left > 0 and left < n").select("__src", "__block", "left")
    # documents of cut blocks in hashed order; one is taken if its middle is within the budget
    inner = Window.partitionBy("__src", "__block").orderBy("__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = narrow.join(cut, ["__src", "__block"]).withColumn("middle", F.sum("__tokens").over(inner) - F.col("__tokens") / 2)
    edge = edge.groupBy("__src", "__block").agg(F.max(F.when(F.col("middle") <= F.col("left"), F.struct("middle", "__order"))).getField("__order").alias("__cut"))
    small = blocks.select("__src", "__block", "passes", (F.col("left") >= F.col("n")).alias("full"), "left").join(edge, ["__src", "__block"], "left")
    more = F.when(F.col("left") <= 0, F.lit(0)).when(F.col("full"), F.lit(1)).when(F.col("__order") <= F.col("__cut"), F.lit(1)).otherwise(F.lit(0))
    small = small.join(plan.select("__src", "weight", "epochs"), "__src")
    # at most 1024 rows a source; broadcast only where their number is small
    out = marked.join(F.broadcast(small) if small.count() <= 200_000 else small, ["__src", "__block"])
    copies = (F.col("passes") + more).cast("long")
    return out.select("row.*", F.col("__tokens").alias("mix_tokens"), F.col("weight").alias("mix_weight"), F.col("epochs").alias("mix_epochs"), copies.alias("mix_copies"))


def expand(mixed: DataFrame) -> DataFrame:
    """One row per document and pass, with mix_pass and mix_place in (0, 1)."""
    rows = mixed.where("mix_copies > 0").withColumn("mix_pass", F.explode(F.expr("sequence(1L, mix_copies)")))
    block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(BLOCKS)).cast("int")
    partial = F.when(F.col("mix_pass") > F.floor("mix_epochs"), F.lit(0)).otherwise(F.col("mix_pass"))
    # the block's place in this pass, then the document's within its block
    turn = F.pmod(F.xxhash64(source_key(F.col("source")), block, partial), F.lit(1 << 20))
    inner = F.pmod(F.xxhash64("doc_id", partial), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.withColumn("mix_place", (F.col("mix_pass") - 1 + (turn + inner) / F.lit(float(1 << 20))) / F.ceil("mix_epochs"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document and pass of the mixture."""
    out = expand(mix(docs, repetition=2.0, floor=1.0))
    return out.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_epochs", "mix_pass", "mix_place")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as often as the mixture uses it."""
    names = docs.columns
    out = mix(docs, **options).where("mix_copies > 0")
    return out.select(*names, F.explode(F.expr("sequence(1L, mix_copies)"))).select(*names)
