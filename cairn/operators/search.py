"""Canned queries over log_entries and log_templates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import format_time, interval

SHOWN = ("id", "ts", "level", "message")


def like(column: str, text: str) -> Column:
    """message LIKE '%text%': % and _ are wildcards, a backslash is itself."""
    return F.col(column).like("%" + text.replace("\\", "\\\\") + "%")


def search_logs(logs: DataFrame, query: str, limit: int = 100) -> DataFrame:
    return logs.where(like("message", query)).select(*SHOWN).orderBy(F.desc("id")).limit(limit)


def get_template(templates: DataFrame, template_id: str) -> DataFrame:
    return templates.where(F.col("template_id") == template_id)


def time_range(logs: DataFrame) -> DataFrame:
    """start and end as text ('N/A' without rows) and seconds between them."""
    out = logs.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = F.coalesce(F.expr("timestampdiff(SECOND, a, b)"), F.lit(0)).cast("double")
    return out.select(F.coalesce(format_time(F.col("a")), F.lit("N/A")).alias("start_time"), F.coalesce(format_time(F.col("b")), F.lit("N/A")).alias("end_time"), seconds.alias("duration_seconds"))


def count_occurrences(logs: DataFrame, pattern: str, group_by: str | None = None) -> DataFrame:
    """n, or group and n, most frequent first; the group of a null key is 'None'."""
    hits = logs.where(like("message", pattern))
    if group_by is None:
        return hits.agg(F.count("*").alias("n"))
    if group_by not in ("level", "template_id"):
        raise ValueError("group_by is 'level' or 'template_id'")
    out = hits.groupBy(group_by).agg(F.count("*").alias("n"))
    return out.select(F.coalesce(group_by, F.lit("None")).alias(group_by), "n").orderBy(F.desc("n"), group_by)


def between(logs: DataFrame, since: datetime | str | None = None, until: datetime | str | None = None) -> DataFrame:
    """Rows of a time range, both ends included, either open."""
    for end, op in ((since, "__ge__"), (until, "__le__")):
        if end is not None:
            logs = logs.where(getattr(F.col("ts"), op)(F.lit(str(end)).cast("timestamp_ntz")))
    return logs


def summarize(logs: DataFrame, since=None, until=None) -> DataFrame:
    return between(logs, since, until).groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level")


def filter_by_time(logs: DataFrame, since=None, until=None, limit: int = 100) -> DataFrame:
    return between(logs, since, until).select(*SHOWN).orderBy(F.desc("id")).limit(limit)


def filter_by_level(logs: DataFrame, levels=(), exclude_levels=(), limit: int = 100) -> DataFrame:
    if levels:
        logs = logs.where(F.col("level").isin(list(levels)))
    if exclude_levels:
        logs = logs.where(~F.col("level").isin(list(exclude_levels)))
    return logs.select(*SHOWN).orderBy(F.desc("id")).limit(limit)


def statistics(logs: DataFrame) -> DataFrame:
    """Per level and in all (level 'ALL'): n, first and last time."""
    out = logs.groupBy("level").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    whole = out.agg(F.lit("ALL").alias("level"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    return out.unionByName(whole).select("level", "n", format_time(F.col("a")).alias("first_ts"), format_time(F.col("b")).alias("last_ts"))


def top_templates(templates: DataFrame, limit: int = 5) -> DataFrame:
    return templates.orderBy(F.desc("count"), "template_id").limit(limit)


def trending(logs: DataFrame, window: str = "1h", top: int = 5) -> DataFrame:
    """Per window: the most frequent templates, their change since the template's last window, rank."""
    size = f"{int(interval(window).total_seconds())} seconds"
    n = logs.groupBy(F.window("ts", size).alias("w"), "template_id").agg(F.count("*").alias("n"))
    n = n.select(F.col("w.start").alias("start"), "template_id", "n")
    n = n.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("template_id").orderBy("start")))
    rank = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("n"), "template_id"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top).select(format_time(F.col("start")).alias("window_start"), "template_id", "n", "delta", "rank")


def latest(logs: DataFrame, limit: int = 100) -> DataFrame:
    return logs.select(*SHOWN).orderBy(F.desc("id")).limit(limit)
