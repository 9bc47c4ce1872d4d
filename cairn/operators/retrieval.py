"""Event-centric retrieval and the deterministic analytics on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.times import format_time, interval, interval_column
from .search import like


def _anchored(logs: DataFrame, anchor: DataFrame) -> DataFrame:
    """logs beside a one-row table: the row count of the broadcast side is one by construction."""
    return logs.crossJoin(F.broadcast(anchor))


def causality_window(logs: DataFrame, event: str, window: str = "1h") -> DataFrame:
    """Rows from window before the event's latest occurrence up to it, itself included."""
    anchor = logs.where(like("message", event)).agg(F.max("ts").alias("anchor"))
    rows = _anchored(logs, anchor).where((F.col("ts") <= F.col("anchor")) & (F.col("ts") >= F.col("anchor") - interval_column(window)))
    return rows.drop("anchor")


def causality_candidates(logs: DataFrame, event: str, window: str = "1h") -> DataFrame:
    """Templates in that window without the event's own rows: counts and lift over all rows."""
    near = causality_window(logs, event, window).where(~like("message", event))
    inside = near.groupBy("template_id").agg(F.count("*").alias("n_win"))
    everywhere = logs.groupBy("template_id").agg(F.count("*").alias("n_all"))
    totals = inside.agg(F.sum("n_win").alias("w")).crossJoin(everywhere.agg(F.sum("n_all").alias("a")))
    out = _anchored(inside.join(everywhere, "template_id"), totals)
    return out.select("template_id", "n_win", "n_all", F.round((F.col("n_win") / F.col("w")) / (F.col("n_all") / F.col("a")), 6).alias("lift")).orderBy(F.desc("lift"), "template_id")


def causes(logs: DataFrame, event: str, window: str = "1h", alpha: float = 0.01) -> DataFrame:
    """causality_candidates with confidence: score, p_bound and whether the template is more frequent than chance allows.

    score is the log-likelihood ratio of the window's rate against the other rows' rate.  Twice its tail bounds the
    chance of such a score, and times the number of templates that of any of them (p_bound, one at most).
    """
    found = causality_candidates(logs, event, window)
    totals = found.agg(F.sum("n_win").alias("w"), F.count("*").alias("m"))
    rows = _anchored(_anchored(found, totals), logs.agg(F.count("template_id").alias("a")))
    inside, outside = F.col("n_win"), F.col("n_all") - F.col("n_win")
    rest = F.col("a") - F.col("w")
    term = lambda k, n: F.when(k > 0, k * F.log(k / (n * F.col("n_all") / F.col("a")))).otherwise(0.0)
    gone = lambda n, k: F.when(n - k > 0, (n - k) * F.log((n - k) / (n * (F.col("a") - F.col("n_all")) / F.col("a")))).otherwise(0.0)
    score = 2 * (term(inside, F.col("w")) + term(outside, rest) + gone(F.col("w"), inside) + gone(rest, outside))
    scored = rows.withColumn("score", F.round(score, 6))
    bound = F.least(F.lit(1.0), 2 * F.col("m") * F.exp(-F.col("score") / 2))
    return scored.select("template_id", "n_win", "n_all", "lift", "score", F.round(bound, 9).alias("p_bound"), ((bound < alpha) & (F.col("lift") > 1)).alias("confident"))


def evidence(logs: DataFrame, event: str, window: str = "1h", rows: int = 3, alpha: float | None = 0.01) -> DataFrame:
    """The latest rows of each cause in the window: template_id, rank, id, ts, message; ties by id.

    Causes are the confident ones, or with alpha None all templates that are more frequent there than elsewhere.

    Tasks keep so many rows of a template each before the shuffle, so a frequent template is no hot key.
    """
    sure = causes(logs, event, window, alpha or 0.0).where("lift > 1" if alpha is None else "confident").select("template_id")
    near = causality_window(logs, event, window).where(~like("message", event))
    w = Window.partitionBy("template_id").orderBy(F.desc("ts"), F.desc("id"))
    top = near.select("template_id", "id", "ts", "message", F.row_number().over(w).alias("rank")).where(F.col("rank") <= rows)
    return top.join(sure, "template_id").select("template_id", "rank", "id", "ts", "message")


def user_impact(logs: DataFrame, event: str, user: str = "user_id") -> DataFrame:
    hits = logs.where(like("message", event))
    out = hits.agg(F.count_distinct(user).alias("affected_users"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return out.select("affected_users", F.coalesce(F.expr("timestampdiff(SECOND, a, b)"), F.lit(0)).cast("bigint").alias("impact_seconds"))


def user_impact_breakdown(logs: DataFrame, event: str, user: str = "user_id") -> DataFrame:
    return logs.where(like("message", event)).groupBy(F.col(user).alias("user")).agg(F.count("*").alias("n"))


def service_logs(logs: DataFrame, service: str, window: str = "1h", now=None) -> DataFrame:
    """Rows that name the service in the window before now (by default the latest time)."""
    anchor = logs.agg((F.max("ts") if now is None else F.lit(str(now)).cast("timestamp_ntz")).alias("anchor"))
    hits = logs.where(like("message", service))
    return _anchored(hits, anchor).where(F.col("ts") >= F.col("anchor") - interval_column(window)).drop("anchor")


#: Rows that a task of service_edges takes about at once.
EDGE_ROWS = 50_000


def service_edges(logs: DataFrame, within: str = "10m", rows: int = EDGE_ROWS) -> DataFrame:
    """How often a row of one service is followed, for the same user and in time, by one of another: no pairs.

    Rows of one user, time and service are one with a weight before they are shuffled.  Time is cut into buckets
    as wide as the range; a bucket gets the rows of the one before as guests.  Running weights of each service
    tell by two binary searches how much of it lies in the range before each row, so work grows with rows and
    services, not with pairs.  Buckets are dealt out in groups of about so many rows; a user's bucket is in one.
    Null users, times and services have no edges.  The range is a year at most.
    """
    width = int(interval(within).total_seconds()) * 1_000_000
    if not 0 < width <= 366 * 86_400_000_000:
        raise ValueError(f"a range of {within!r} is not between a second and a year")
    seen = logs.where("user_id is not null and ts is not null and service is not null")
    seen = seen.groupBy("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "service").agg(F.count("*").alias("n"))
    seen = written(seen, "seen")
    bucket = F.expr(f"(at - pmod(at, {width}L)) div {width}L")
    dealt = seen.select("user_id", "at", "service", "n", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    parts = max(1, -(-2 * seen.count() // rows))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("user_id", "bucket"), F.lit(parts)))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = pdf.groupby(["user_id", "bucket"], sort=False).ngroup().to_numpy()
        # times of one cell lie in two widths; cells are set four widths apart, so ranges never reach over
        at = cell * (4 * width) + (pdf["at"] - (pdf["bucket"] - 1) * width).to_numpy()
        weight, own = pdf["n"].to_numpy(), (pdf["at"] >= pdf["bucket"] * width).to_numpy()
        code, names = pd.factorize(pdf["service"])
        out = []
        for source, name in enumerate(names):
            here = code == source
            order = np.argsort(at[here], kind="stable")
            times, running = at[here][order], np.concatenate([[0], np.cumsum(weight[here][order])])
            targets = own & ~here
            before = running[np.searchsorted(times, at[targets], "left")] - running[np.searchsorted(times, at[targets] - width, "left")]
            sums = np.zeros(len(names), np.int64)
            np.add.at(sums, code[targets], before * weight[targets])
            out += [(name, names[t], int(sums[t])) for t in np.flatnonzero(sums)]
        return pd.DataFrame(out, columns=["source", "target", "n"])

    found = dealt.groupBy("part").applyInPandas(sweep, "source string, target string, n bigint")
    return found.groupBy("source", "target").agg(F.sum("n").alias("n"))


def service_bottlenecks(logs: DataFrame, within: str = "10m") -> DataFrame:
    """Per target service: edges into it, its share of error rows, and their product."""
    into = service_edges(logs, within).groupBy(F.col("target").alias("service")).agg(F.sum("n").alias("in_edges"))
    errors = logs.groupBy("service").agg(F.avg((F.col("level") == "ERROR").cast("double")).alias("share"))
    return into.join(errors, "service").select("service", "in_edges", F.round("share", 6).alias("error_share"), F.round(F.col("in_edges") * F.col("share"), 4).alias("score"))


def critical_paths(logs: DataFrame, start: str, within: str = "10m", depth: int = 3) -> DataFrame:
    """Paths of up to depth edges from a service, without repeats, by their least edge count."""
    edges = service_edges(logs, within)
    now = edges.where(F.col("source") == start).select(F.array("source", "target").alias("path"), F.col("n").alias("strength"))
    out = now
    for _ in range(depth - 1):
        step = now.select("path", "strength", F.element_at("path", -1).alias("source")).join(edges, "source").where(~F.array_contains("path", F.col("target")))
        now = step.select(F.concat("path", F.array("target")).alias("path"), F.least("strength", "n").alias("strength"))
        out = out.unionByName(now)
    return out.select(F.array_join("path", ">").alias("path"), "strength")


def event_context(logs: DataFrame, event_id: int, window: str = "5m") -> DataFrame:
    """Rows within the window around an event: preceding, target or following, and whether of its template."""
    anchor = logs.where(F.col("id") == event_id).agg(F.first("ts").alias("t"), F.first("template_id").alias("tid"))
    w = interval_column(window)
    rows = _anchored(logs, anchor).where((F.col("ts") >= F.col("t") - w) & (F.col("ts") <= F.col("t") + w))
    relation = F.when(F.col("id") == event_id, "target").when(F.col("ts") < F.col("t"), "preceding").otherwise("following")
    return rows.select("id", format_time(F.col("ts")).alias("at"), "level", "message", relation.alias("relation"), (F.col("template_id") == F.col("tid")).alias("same_template"))


def compare_events(logs: DataFrame, first: str, second: str, metrics: tuple[str, ...] = ()) -> DataFrame:
    """Per level: rows of either event, their difference, distinct users, first and last time; for each of metrics
    the means of that column, as a number, in the rows of either (<metric>_1, <metric>_2)."""
    a, b = like("message", first), like("message", second)
    means = [F.avg(F.when(c, F.col(m).try_cast("double"))).alias(f"{m}_{i}") for m in metrics for i, c in ((1, a), (2, b))]
    out = logs.where(a | b).groupBy("level").agg(F.count_if(a).alias("n1"), F.count_if(b).alias("n2"), F.count_distinct(F.when(a, F.col("user_id"))).alias("users1"), F.count_distinct(F.when(b, F.col("user_id"))).alias("users2"), F.min("ts").alias("x"), F.max("ts").alias("y"), *means)
    return out.select("level", "n1", "n2", (F.col("n1") - F.col("n2")).alias("diff"), "users1", "users2", format_time(F.col("x")).alias("first_ts"), format_time(F.col("y")).alias("last_ts"), *[f"{m}_{i}" for m in metrics for i in (1, 2)])


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, value: str, bucket: str = "1d") -> DataFrame:
    """left with the latest non-null right value at or before its time, by key: no pairs.

    A union and a running last value inside each bucket of time, so a hot key is many tasks; what earlier buckets
    leave is a running last value over one row a key and bucket.
    """
    seconds = int(interval(bucket).total_seconds())
    at = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(seconds * 1_000_000))
    a = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(F.col(by), F.col(time), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__bucket", at)
    here = Window.partitionBy(by, "__bucket").orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn(value, F.last("__v", ignorenulls=True).over(here)).where("__side = 1")
    ends = both.groupBy(by, "__bucket").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(time))).alias("__end"))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(by).alias("__by"), F.col("__bucket").alias("__at"), F.last("__end", ignorenulls=True).over(before).alias("__carried")).where("__carried is not null")
    out = rows.join(ends, rows[by].eqNullSafe(ends["__by"]) & rows["__bucket"].eqNullSafe(ends["__at"]), "left")
    return out.withColumn(value, F.coalesce(value, "__carried")).drop("__side", "__v", "__bucket", "__by", "__at", "__carried")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of left beside the n-th of right, each in its order; the shorter side is filled with null."""
    from ..sources.reader import with_ordinal

    a, b = with_ordinal(left, left_order).withColumnRenamed("id", "__a"), with_ordinal(right, right_order).withColumnRenamed("id", "__b")
    return a.join(b, F.col("__a") == F.col("__b"), "full").drop("__a", "__b")
