"""log_entries over the events table: the mapping that all canned queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One text for both engines; integers only inside message.
COMMON = """
SELECT event_id AS id, ts,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END AS level,
       concat(event_type, ' user ', user_id, ' ', props) AS message,
       user_id, value, event_type AS service
FROM events
"""
#: DuckDB CTE that every SQL text over log_entries starts with.
SQL = f"WITH log0 AS ({COMMON}), log_entries AS (SELECT *, md5(regexp_replace(message, '[0-9]+', '<*>', 'g')) AS template_id, regexp_replace(message, '[0-9]+', '<*>', 'g') AS template FROM log0), log_templates AS (SELECT template_id, template, count(*) AS count FROM log_entries GROUP BY 1, 2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, level, message, user_id, value, service, template, template_id."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").when(F.col("event_type") == "signup", "DEBUG").otherwise("INFO")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", level.alias("level"), F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" "), "props").alias("message"), "user_id", "value", F.col("event_type").alias("service"))
    e = e.withColumn("template", F.regexp_replace("message", "[0-9]+", "<*>"))
    return e.withColumn("template_id", F.md5(F.encode("template", "utf-8")))


def log_templates(entries: DataFrame) -> DataFrame:
    return entries.groupBy("template_id", "template").agg(F.count("*").alias("count"))
