"""The facade: one object with the log tables and the named operations over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import clean, dialect
from .operators import retrieval, search, stats, templates, vectors
from .plans.planner import SqlPlanner, Step, plan
from .sources.reader import LogReader


class EngineNotInitialised(RuntimeError):
    """An operation came before initialize()."""


@dataclass
class AnalysisResult:
    """What a named analysis gives back at the API's edge."""

    success: bool
    operation: str = ""
    error: str | None = None
    dataframes: list[DataFrame] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, planner: SqlPlanner | None = None):
        """planner: asked for SQL where no rule fits a question of chat()."""
        self.spark, self.planner = spark, planner
        self._logs: DataFrame | None = None
        self._kept: DataFrame | None = None
        self._templates: DataFrame | None = None
        self._store: DataFrame | None = None

    def initialize(self, path: str | list[str], format: str = "json", mine: bool = True, **options) -> "Engine":
        """Reads, parses and mines a log; replaces the views log_entries and log_templates."""
        records = LogReader(self.spark, format=format, **options).load(path)
        text = F.coalesce("body", F.nullif("message", F.lit("")), F.lit(""))
        logs = records.withColumnRenamed("timestamp", "ts").withColumn("__text", text)
        if mine:
            # messages have lost their headers in parsing; whole lines have not
            rows, _ = templates.mine(logs.select("id", "__text"), "__text", **({} if format in ("line", "text") else {"headers": ()}))
            rows = rows.select("id", "template_final").withColumn("template_id", F.md5(F.encode("template_final", "utf-8")))
            logs = logs.drop("template").join(rows.withColumnRenamed("template_final", "template"), "id")
        else:
            logs = logs.withColumn("template_id", F.lit(None).cast("string"))
        before, self._kept = self._kept, logs.drop("__text").persist()
        if before is not None:  # the log that was loaded before
            before.unpersist()
        return self.set_tables(self._kept)

    def set_tables(self, logs: DataFrame, log_templates: DataFrame | None = None) -> "Engine":
        self._logs = logs
        self._templates = log_templates if log_templates is not None else templates.roll_up(logs, "template")
        self._store = None
        logs.createOrReplaceTempView("log_entries")
        self._templates.createOrReplaceTempView("log_templates")
        return self

    @property
    def logs(self) -> DataFrame:
        if self._logs is None:
            raise EngineNotInitialised("call initialize() first")
        return self._logs

    @property
    def templates(self) -> DataFrame:
        self.logs
        return self._templates

    @property
    def store(self) -> DataFrame:
        if self._store is None:
            self._store = vectors.store_templates(self.templates)
        return self._store

    def execute_query(self, sql: str, args: dict | None = None) -> DataFrame:
        self.logs
        return dialect.execute(self.spark, sql, args)

    def search_logs(self, query: str, limit: int = 100) -> DataFrame:
        return search.search_logs(self.logs, query, limit)

    def get_template(self, template_id: str) -> DataFrame:
        return search.get_template(self.templates, template_id)

    def get_time_range(self) -> DataFrame:
        return search.time_range(self.logs)

    def count_occurrences(self, pattern: str, group_by: str | None = None) -> DataFrame:
        return search.count_occurrences(self.logs, pattern, group_by)

    def summarize_logs(self, since=None, until=None) -> DataFrame:
        return search.summarize(self.logs, since, until)

    def filter_by_time(self, since=None, until=None, limit: int = 100) -> DataFrame:
        return search.filter_by_time(self.logs, since, until, limit)

    def filter_by_level(self, levels=(), exclude_levels=(), limit: int = 100) -> DataFrame:
        return search.filter_by_level(self.logs, levels, exclude_levels, limit)

    def calculate_statistics(self) -> DataFrame:
        return search.statistics(self.logs)

    def get_trending_patterns(self, window: str = "1h") -> DataFrame:
        return search.trending(self.logs, window)

    def latest_logs(self, limit: int = 100) -> DataFrame:
        return search.latest(self.logs, limit)

    def analyze_causality(self, event: str, window: str = "1h") -> DataFrame:
        return retrieval.causality_candidates(self.logs, event, window)

    def causality_window(self, event: str, window: str = "1h") -> DataFrame:
        return retrieval.causality_window(self.logs, event, window)

    def find_causes(self, event: str, window: str = "1h", alpha: float = 0.01) -> DataFrame:
        return retrieval.causes(self.logs, event, window, alpha)

    def get_evidence(self, event: str, window: str = "1h", rows: int = 3, alpha: float | None = 0.01) -> DataFrame:
        return retrieval.evidence(self.logs, event, window, rows, alpha)

    def _with_fields(self, *names: str) -> DataFrame:
        """logs with the named columns, from the records' fields where the log has no such column."""
        return self.logs.withColumns({n: F.try_element_at("fields", F.lit(n)) for n in names if n not in self.logs.columns})

    def analyze_user_impact(self, event: str, user_field: str = "user_id") -> DataFrame:
        return retrieval.user_impact(self._with_fields(user_field), event, user_field)

    def get_event_context(self, event_id: int, window: str = "5m") -> DataFrame:
        return retrieval.event_context(self.logs, event_id, window)

    def compare_events(self, first: str, second: str, metrics: tuple[str, ...] = ()) -> DataFrame:
        return retrieval.compare_events(self._with_fields("user_id", *metrics), first, second, metrics)

    def _services(self, service_field: str) -> DataFrame:
        return self._with_fields(service_field, "user_id").withColumn("service", F.col(service_field))

    def analyze_service_dependencies(self, within: str = "10m", service_field: str = "service") -> DataFrame:
        return retrieval.service_edges(self._services(service_field), within)

    def service_bottlenecks(self, within: str = "10m", service_field: str = "service") -> DataFrame:
        return retrieval.service_bottlenecks(self._services(service_field), within)

    def critical_paths(self, start: str, within: str = "10m", depth: int = 3, service_field: str = "service") -> DataFrame:
        return retrieval.critical_paths(self._services(service_field), start, within, depth)

    def service_logs(self, service: str, window: str = "1h", now=None) -> DataFrame:
        return retrieval.service_logs(self.logs, service, window, now)

    def search_similar_templates(self, text: str, limit: int = 5) -> DataFrame:
        """Templates near a text by the offline embedding."""
        row = self.spark.createDataFrame([(text,)], "t string").select(vectors.embed_hash(F.col("t")).alias("e")).first()
        return vectors.search_similar(self.store, row["e"], limit)

    def extract_attributes(self, patterns: dict[str, str], column: str = "message") -> DataFrame:
        return clean.extract_attributes(self.logs, patterns, column)

    def calculate_stats(self, column: str) -> DataFrame:
        return stats.calculate_stats(self.logs, column)

    def detect_anomalies(self, column: str, threshold: float = 2.0) -> DataFrame:
        return stats.detect_anomalies(self.logs, column, threshold)

    def group_by_time(self, every: str = "1h", fill: bool = False) -> DataFrame:
        return stats.group_by_time(self.logs, "ts", every, fill)

    def health(self) -> dict:
        return {"status": "ok", "initialised": self._logs is not None}

    def chat(self, question: str) -> AnalysisResult:
        """A question in words to a named operation, by rules; nothing is generated or executed as code."""
        try:
            try:
                step = plan(question)
            except ValueError:
                if self.planner is None:
                    raise
                schema = "\n".join(f"log_entries.{f.name} {f.dataType.simpleString()}" for f in self.logs.schema)
                step = Step("execute_query", (self.planner.plan(question, schema),))
            return AnalysisResult(True, step.operation, None, [getattr(self, step.operation)(*step.args, **step.kwargs)])
        except (ValueError, EngineNotInitialised) as e:
            return AnalysisResult(False, error=str(e))
