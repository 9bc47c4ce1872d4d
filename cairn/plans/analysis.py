"""Queries of the analytic operators, each beside its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import format_time
from ..operators import ann, frames, retrieval, stats, templates, trigrams, vectors
from ..sources.events import SQL as LOGS
from ..sources.events import log_entries, log_templates, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _on_logs(name: str, sql: str) -> Callable:
    """Registers a query over log_entries with its SQL, which follows the CTEs of log_entries."""

    def register(run: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda s, d: run(log_entries(s, d))
        SQL[name] = f"{LOGS} {sql}"
        return run

    return register


def _on_table(name: str, source: str, sql: str) -> Callable:
    def register(run: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda s, d: run(table(s, d, source))
        SQL[name] = sql
        return run

    return register


# --- template mining with all lines in one leaf ------------------------------------------------------
@_on_logs(
    "drain_one_leaf",
    """
, m AS (SELECT id, service, user_id FROM log_entries),
f AS (
  SELECT service, row_number() OVER (ORDER BY min(id)) - 1 AS cluster_id,
         CASE WHEN count(DISTINCT user_id) > 1 THEN '<*>' ELSE min(user_id)::VARCHAR END AS who
  FROM m GROUP BY service
)
SELECT id, cluster_id, concat_ws(' ', service, service, service, 'user', who) AS template_final
FROM m JOIN f USING (service)
""",
)
def _one_leaf(logs: DataFrame) -> DataFrame:
    """Depth 0: the number of tokens alone is a line's place in the tree, so all lines share a leaf."""
    lines = logs.select("id", F.concat_ws(" ", "service", "service", "service", F.lit("user"), F.col("user_id").cast("string")).alias("message"))
    rows, _ = templates.mine(lines, depth=0, headers=())
    return rows.select("id", "cluster_id", "template_final")


# --- frames -----------------------------------------------------------------------------------------
_ITEMS = "SELECT l_orderkey, l_linenumber, {} FROM lineitem"
_OVER = "OVER (PARTITION BY l_partkey ORDER BY {} {} EXCLUDE {})"


def _frame_sql(cells: list[tuple[str, str, str, str, str]]) -> str:
    over = [(name, value, _OVER.format(order, span, exclude)) for name, value, order, span, exclude in cells]
    columns = [f"({value} {o}){'::BIGINT' if value.startswith('sum') else ''} AS {name}" for name, value, o in over]
    return _ITEMS.format(",\n  ".join(columns))


def _framed(items: DataFrame, order: list[str], *cells: tuple[dict, dict]) -> DataFrame:
    return frames.framed_all(items, list(cells), ["l_partkey"], order)


_NEAR = "GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING"


@_on_table(
    "frame_groups_exclude",
    "lineitem",
    _frame_sql(
        [(f"n_{e.replace(' ', '_')}", "count(*)", "l_linenumber", _NEAR, e) for e in frames.EXCLUDES]
        + [(f"sum_{e.replace(' ', '_')}", "sum(l_orderkey)", "l_linenumber", _NEAR, e) for e in frames.EXCLUDES]
        + [(f"max_{e.replace(' ', '_')}", "max(l_suppkey)", "l_linenumber", _NEAR, e) for e in frames.EXCLUDES]
    ),
)
def _groups(items: DataFrame) -> DataFrame:
    """Of each part number: peers are items at the same place of their orders."""
    items, cells = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), []
    for e in frames.EXCLUDES:
        name = e.replace(" ", "_")
        found = {f"n_{name}": ("count", "l_orderkey"), f"sum_{name}": ("sum", "l_orderkey"), f"max_{name}": ("max", "l_suppkey")}
        cells.append((found, {"start": -1, "end": 1, "exclude": e}))
    return _framed(items, ["l_linenumber"], *cells).drop("l_partkey", "l_suppkey")


@_on_table(
    "frame_groups_spans",
    "lineitem",
    _frame_sql(
        [
            ("n_before", "count(*)", "l_linenumber", "GROUPS BETWEEN 2 PRECEDING AND 1 PRECEDING", "NO OTHERS"),
            ("n_after", "count(*)", "l_linenumber", "GROUPS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING", "TIES"),
            ("n_so_far", "count(*)", "l_linenumber", "GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "GROUP"),
            ("least", "min(l_orderkey)", "l_linenumber", "GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW"),
        ]
    ),
)
def _spans(items: DataFrame) -> DataFrame:
    items = items.select("l_orderkey", "l_linenumber", "l_partkey")
    count = ("count", "l_orderkey")
    cells = [
        ({"n_before": count}, {"start": -2, "end": -1}),
        ({"n_after": count}, {"start": 1, "end": None, "exclude": "ties"}),
        ({"n_so_far": count}, {"end": 0, "exclude": "group"}),
        ({"least": ("min", "l_orderkey")}, {"end": 0, "exclude": "current row"}),
    ]
    return _framed(items, ["l_linenumber"], *cells).drop("l_partkey")


_UNIQUE = "l_extendedprice, l_orderkey"


@_on_table(
    "frame_rows_exclude",
    "lineitem",
    _frame_sql(
        [(f"sum_{e.replace(' ', '_')}", "sum(l_suppkey)", _UNIQUE, "ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING", e) for e in frames.EXCLUDES]
        + [("mean_others", "avg(l_suppkey)", _UNIQUE, "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", "CURRENT ROW")]
    ),
)
def _rows(items: DataFrame) -> DataFrame:
    items = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cells = [({f"sum_{e.replace(' ', '_')}": ("sum", "l_suppkey")}, {"units": "rows", "start": -3, "end": 2, "exclude": e}) for e in frames.EXCLUDES]
    cells.append(({"mean_others": ("avg", "l_suppkey")}, {"units": "rows", "start": None, "end": None, "exclude": "current row"}))
    return _framed(items, ["l_extendedprice", "l_orderkey"], *cells).drop("l_partkey", "l_suppkey", "l_extendedprice")


# --- selection by rank --------------------------------------------------------------------------------
@_on_table(
    "exact_ranks",
    "lineitem",
    """
SELECT r AS "rank", list_sort(list(l_extendedprice))[r + 1] AS value
FROM lineitem, (SELECT unnest([0, 1000, count(*) // 3, count(*) - 1]) AS r FROM lineitem) GROUP BY r
""",
)
def _ranks(items: DataFrame) -> DataFrame:
    n = items.count()
    ranks = [0, 1000, n // 3, n - 1]
    found = stats.at_ranks(items, "l_extendedprice", ranks, few=500, accuracy=200)
    return items.sparkSession.createDataFrame(list(zip(ranks, found)), "rank bigint, value double")


# --- causes with evidence -------------------------------------------------------------------------------
_EVENT = "purchase user 7 "
_CAUSES = f"""
, near AS (
  SELECT l.* FROM log_entries l, (SELECT max(ts) AS t FROM log_entries WHERE message LIKE '%{_EVENT}%') a
  WHERE ts <= t AND ts >= t - INTERVAL 1 DAY AND message NOT LIKE '%{_EVENT}%'
), c AS (
  SELECT template_id, n_win, n_all, (sum(n_win) OVER ())::DOUBLE AS w, count(*) OVER () AS m,
         (SELECT count(*) FROM log_entries)::DOUBLE AS a
  FROM (SELECT template_id, count(*) AS n_win FROM near GROUP BY 1)
  JOIN (SELECT template_id, count(*) AS n_all FROM log_entries GROUP BY 1) USING (template_id)
), g AS (
  SELECT *, [n_win, n_all - n_win, w - n_win, a - w - n_all + n_win] AS seen,
         [w * n_all / a, (a - w) * n_all / a, w * (a - n_all) / a, (a - w) * (a - n_all) / a] AS due,
         (n_win / w) / (n_all / a) AS lift
  FROM c
), s AS (
  SELECT *, round(2 * list_sum(list_transform(range(1, 5), lambda i: CASE WHEN seen[i] > 0 THEN seen[i] * ln(seen[i] / due[i]) ELSE 0 END)), 6) AS score
  FROM g
), p AS (SELECT *, least(1.0, 2 * m * exp(-score / 2)) AS bound FROM s)
"""


@_on_logs("causes", f"{_CAUSES} SELECT template_id, n_win, n_all, round(lift, 6) AS lift, round(score, 4) AS score, round(bound, 6) AS p_bound, bound < 0.5 AND lift > 1 AS confident FROM p")
def _causes(logs: DataFrame) -> DataFrame:
    found = retrieval.causes(logs, _EVENT, "1d", 0.5)
    return found.withColumns({"score": F.round("score", 4), "p_bound": F.round("p_bound", 6)})


@_on_logs(
    "cause_evidence",
    f"""{_CAUSES}
SELECT template_id, "rank", id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, message
FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts DESC, id DESC) AS "rank" FROM near)
JOIN p USING (template_id) WHERE "rank" <= 3 AND round(lift, 6) > 1
""",
)
def _evidence(logs: DataFrame) -> DataFrame:
    found = retrieval.evidence(logs, _EVENT, "1d", 3, None)
    return found.select("template_id", "rank", "id", format_time(F.col("ts")).alias("at"), "message")


# --- how often each value occurs, as a map ------------------------------------------------------------------
@_on_table("histogram", "lineitem", "SELECT l_returnflag, histogram(l_linenumber)[3] AS threes, len(map_keys(histogram(l_quantity))) AS quantities FROM lineitem GROUP BY l_returnflag")
def _histogram(items: DataFrame) -> DataFrame:
    by = ["l_returnflag"]
    found = stats.value_histogram(items, "l_linenumber", by).join(stats.value_histogram(items, "l_quantity", by).withColumnRenamed("histogram", "q"), by)
    return found.select("l_returnflag", found["histogram"][3].alias("threes"), F.size("q").cast("long").alias("quantities"))


# --- approximate search: no SQL, as which of the nearest are missed is the index's own; tests measure recall ----
def _vector_ann(s: SparkSession, d: str) -> DataFrame:
    store = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = ann.AnnIndex.build(store).search(store.where("id % 100 = 0"), store, 10)
    return found.select("query_id", "id", "rank", F.round("score", 4).alias("score"))


QUERIES["vector_ann"] = _vector_ann


# --- substring search that leaves files out -----------------------------------------------------------------
@_on_logs("search_trigrams", "SELECT id, message FROM log_entries WHERE message LIKE '%purchase user 1_ {%'")
def _trigrams(logs: DataFrame) -> DataFrame:
    index = trigrams.TrigramIndex.build(logs.select("id", "message"), rows=500)
    return index.search("purchase user 1_ {")


# --- two events by a metric ---------------------------------------------------------------------------------
@_on_logs(
    "compare_events_metrics",
    """
SELECT level, count(*) FILTER (message LIKE '%user 1%') AS n1, count(*) FILTER (message LIKE '%user 2%') AS n2,
       round(avg(value) FILTER (message LIKE '%user 1%'), 4) AS value_1, round(avg(value) FILTER (message LIKE '%user 2%'), 4) AS value_2
FROM log_entries WHERE message LIKE '%user 1%' OR message LIKE '%user 2%' GROUP BY level
""",
)
def _metrics(logs: DataFrame) -> DataFrame:
    found = retrieval.compare_events(logs, "user 1", "user 2", ("value",))
    return found.select("level", "n1", "n2", F.round("value_1", 4).alias("value_1"), F.round("value_2", 4).alias("value_2"))


# --- a cache in front of an embedder: the second load asks for what is new --------------------------------------
class _Counted:
    """An offline embedder of one component, a template's length."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t))] for t in texts]


@_on_logs(
    "vector_cache",
    "SELECT template_id AS point_id, length(template)::DOUBLE AS size, template LIKE 'error%' AS cached FROM log_templates",
)
def _cache(logs: DataFrame) -> DataFrame:
    known = log_templates(logs)
    _, cache = vectors.embed_cached(known.where("template like 'error%'"), _Counted())
    found, _ = vectors.embed_cached(known, _Counted(), cache)
    cached = cache.select("point_id", F.lit(True).alias("cached"))
    out = found.select("template_id", vectors.point_id(F.col("template")).alias("point_id"), F.col("embedding")[0].cast("double").alias("size"))
    return out.join(cached, "point_id", "left").select("point_id", "size", F.coalesce("cached", F.lit(False)).alias("cached"))
