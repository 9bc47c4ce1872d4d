"""Statistics over a numeric or time column."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import format_time, interval


#: Rows that the last round of a selection sorts at most, and the accuracy of the sketches that narrow it down.
FEW, ACCURACY = 10_000, 10_000


def at_ranks(df: DataFrame, column: str, ranks: list[int], few: int = FEW, accuracy: int = ACCURACY) -> list:
    """The non-null values at 0-based ranks of the column's order, exactly.

    A round asks a sketch for two values around a rank and counts rows below, at, between and above them; the counts
    are exact, so they tell which part holds the rank, whatever the sketch said.  A part of one value is the
    answer, one of few rows is sorted; else the next round takes that part.  Each round leaves out the two values
    at least, and commonly all but a few ten-thousandths of the rows; no task holds more than a sketch or few rows.
    """
    here = df.select(F.col(column).alias("v")).where("v is not null")

    def one(part: DataFrame, n: int, rank: int):
        while n > few:
            near = [max(0.0, rank / n - 2 / accuracy), min(1.0, rank / n + 2 / accuracy)]
            lo, hi = part.agg(F.percentile_approx("v", near, accuracy)).first()[0]
            low, high, v = F.lit(lo), F.lit(hi), F.col("v")
            tests = [v < low, v == low, (v > low) & (v < high), (v == high) & (v > low), v > high]
            counts = part.agg(*[F.count_if(t) for t in tests]).first()
            at = next(i for i in range(5) if rank < sum(counts[: i + 1]))
            if at in (1, 3):
                return lo if at == 1 else hi
            part, n, rank = part.where(tests[at]), counts[at], rank - sum(counts[:at])
        return part.orderBy("v").limit(rank + 1).tail(1)[0]["v"]

    n = here.count()
    return [one(here, n, r) for r in ranks]


def exact_median(df: DataFrame, column: str, few: int = FEW, accuracy: int = ACCURACY) -> float | None:
    """The mean of the middle value or two; null where there is no value.  NaN is greater than any other."""
    n = df.select(F.count(column)).first()[0]
    if not n:
        return None
    lo, hi = (n - 1) // 2, n // 2
    found = at_ranks(df, column, [lo] if lo == hi else [lo, hi], few, accuracy)
    return (float(found[0]) + float(found[-1])) / 2


def calculate_stats(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    median = F.lit(exact_median(df, column)).cast("double")
    return df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("count"), F.count_distinct(c).alias("unique")).select("mean", median.alias("median"), "std", "min", "max", "count", "unique")


def detect_anomalies(df: DataFrame, column: str, threshold: float = 2.0) -> DataFrame:
    """Rows farther than threshold standard deviations from the mean, with both."""
    m = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    return df.crossJoin(F.broadcast(m)).where(F.abs(F.col(column) - F.col("mean")) > F.lit(threshold) * F.col("std"))


def group_by_time(df: DataFrame, column: str = "ts", every: str = "1h", fill: bool = False) -> DataFrame:
    """bucket and n; fill adds empty buckets between the first and the last."""
    size = int(interval(every).total_seconds())
    bucket = F.window(column, f"{size} seconds").getField("start")
    out = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    if fill:
        ends = out.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
        spine = ends.select(F.explode(F.sequence("a", "b", F.make_dt_interval(secs=F.lit(size)))).alias("bucket"))
        out = spine.join(out, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    return out.select(format_time(F.col("bucket")).alias("bucket"), "n")


def heatmap_counts(df: DataFrame, x: str, y: str, values: str, known: list) -> DataFrame:
    """Rows y, a column per known x value: counts of non-null values, null where there is no row."""
    return df.groupBy(y).pivot(x, known).agg(F.count(values))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all ordered pairs of columns; at least two are needed."""
    if len(columns) < 2:
        raise ValueError("a correlation needs two numeric columns at least")
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{i}", 6).alias("corr")) for i, p in enumerate(pairs) for a, b in {p, p[::-1]}]
    return one.select(F.inline(F.array(*cells)))


def distribution_histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin from 0, n): bins of equal width between the least and the greatest value; empty ones too."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / width))).cast("int")
    n = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(n), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def distribution_density(df: DataFrame, column: str, points: int = 20) -> DataFrame:
    """(x, density): a Gaussian kernel estimate by Scott's rule at even points from the least to the greatest value.

    One aggregate over the rows, whatever their number.
    """
    c = F.col(column).cast("double")
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.stddev_samp(c).alias("std"), F.count(c).alias("n"))
    ends = ends.withColumn("h", F.col("std") * F.pow(F.col("n"), F.lit(-0.2))).withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(points - 1))
    at = lambda i: F.col("lo") + i * F.col("step")
    kernel = lambda i: F.exp(-0.5 * F.pow((at(i) - c) / F.col("h"), 2)) / (F.col("h") * F.lit((2 * math.pi) ** 0.5))
    sums = df.where(c.isNotNull()).crossJoin(F.broadcast(ends)).groupBy("lo", "step", "n").agg(*[F.sum(kernel(i)).alias(f"k{i}") for i in range(points)])
    return sums.select(F.inline(F.array(*[F.struct(at(i).alias("x"), (F.col(f"k{i}") / F.col("n")).alias("density")) for i in range(points)])))


def value_histogram(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """by and histogram, a map of each non-null value to its rows: values are counted before they are gathered."""
    n = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias("histogram"))


def timeseries(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(x, y).where(F.col(x).isNotNull()).orderBy(x)
