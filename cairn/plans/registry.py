"""All queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, dialect, kernels, times
from ..operators import retrieval, search, stats, templates, vectors

from ..engine import Engine
from ..sources.events import SQL as LOGS
from ..sources.events import log_entries, log_templates, table
from ..functions.tables import new_path
from ..streaming import streams
from . import analysis, ingest
from .planner import plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = ingest.QUERIES | analysis.QUERIES
SQL: dict[str, str] = ingest.SQL | analysis.SQL
_AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def _on_logs(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(name, lambda s, d: run(log_entries(s, d)), f"{LOGS} {sql}")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", times.format_time(F.col("ts")).alias("at"), "level", "message")


# --- canned queries -------------------------------------------------------------------------------
_SHOW = f"SELECT id, {_AT.format('ts')} AS at, level, message FROM log_entries"
_on_logs("search_logs", lambda x: _shown(search.search_logs(x, "error user 1")), f"{_SHOW} WHERE message LIKE '%error user 1%' ORDER BY id DESC LIMIT 100")
_on_logs("get_template", lambda x: search.get_template(log_templates(x).withColumn("template_id", F.col("template")), 'error user <*> {"k": <*>}'), "SELECT template AS template_id, template, count FROM log_templates WHERE template = 'error user <*> {\"k\": <*>}'")
_on_logs("time_range", search.time_range, f"SELECT {_AT.format('min(ts)')} AS start_time, {_AT.format('max(ts)')} AS end_time, date_sub('second', min(ts), max(ts))::DOUBLE AS duration_seconds FROM log_entries")
_on_logs("count_occurrences", lambda x: search.count_occurrences(x, "error"), "SELECT count(*) AS n FROM log_entries WHERE message LIKE '%error%'")
_on_logs("count_occurrences_by_level", lambda x: search.count_occurrences(x, "user 14", "level"), "SELECT level, count(*) AS n FROM log_entries WHERE message LIKE '%user 14%' GROUP BY level")
_on_logs("count_occurrences_by_template", lambda x: search.count_occurrences(x, "user 1", "template_id"), "SELECT template_id, count(*) AS n FROM log_entries WHERE message LIKE '%user 1%' GROUP BY 1")
_on_logs("summarize_by_level", search.summarize, "SELECT level, count(*) AS n FROM log_entries GROUP BY level")
_on_logs("summarize_in_range", lambda x: search.summarize(x, "2024-01-03 00:00:00", "2024-01-10 00:00:00"), "SELECT level, count(*) AS n FROM log_entries WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10' GROUP BY level")
_on_logs("filter_by_time", lambda x: _shown(search.filter_by_time(x, "2024-01-03 00:00:00", "2024-01-10 00:00:00")), f"{_SHOW} WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10' ORDER BY id DESC LIMIT 100")
_on_logs("filter_by_level", lambda x: _shown(search.filter_by_level(x, ["ERROR", "WARN"])), f"{_SHOW} WHERE level IN ('ERROR', 'WARN') ORDER BY id DESC LIMIT 100")
_on_logs("filter_exclude_level", lambda x: _shown(search.filter_by_level(x, [], ["INFO"])), f"{_SHOW} WHERE level NOT IN ('INFO') ORDER BY id DESC LIMIT 100")
_on_logs("statistics", search.statistics, f"SELECT coalesce(level, 'ALL') AS level, count(*) AS n, {_AT.format('min(ts)')} AS first_ts, {_AT.format('max(ts)')} AS last_ts FROM log_entries GROUP BY ROLLUP (level)")
_on_logs("top_templates", lambda x: search.top_templates(log_templates(x)), "SELECT template_id, template, count FROM log_templates ORDER BY count DESC, template_id LIMIT 5")
_on_logs("trending_by_window", lambda x: search.trending(x, "1h"), f"SELECT {_AT.format('w')} AS window_start, template_id, n, delta, rank FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, template_id) AS rank FROM (SELECT *, n - lag(n) OVER (PARTITION BY template_id ORDER BY w) AS delta FROM (SELECT date_trunc('hour', ts) AS w, template_id, count(*) AS n FROM log_entries GROUP BY 1, 2))) WHERE rank <= 5")
_on_logs("latest_logs", lambda x: _shown(search.latest(x)), f"{_SHOW} ORDER BY id DESC LIMIT 100")

# --- event-centric retrieval ----------------------------------------------------------------------
_ANCHOR = "(SELECT max(ts) AS t FROM log_entries WHERE message LIKE '%purchase user 7 %') a"
_on_logs("causality_window", lambda x: _shown(retrieval.causality_window(x, "purchase user 7 ")), f"SELECT id, {_AT.format('ts')} AS at, level, message FROM log_entries, {_ANCHOR} WHERE ts <= t AND ts >= t - INTERVAL 1 HOUR")
_on_logs("causality_candidates", lambda x: retrieval.causality_candidates(x, "purchase user 7 ", "1d"), f"SELECT w.template_id, n_win, n_all, round((n_win / (sum(n_win) OVER ())) / (n_all / total), 6) AS lift FROM (SELECT template_id, count(*) AS n_win FROM log_entries, {_ANCHOR} WHERE ts <= t AND ts >= t - INTERVAL 1 DAY AND message NOT LIKE '%purchase user 7 %' GROUP BY 1) w JOIN (SELECT template_id, count(*) AS n_all, sum(count(*)) OVER () AS total FROM log_entries GROUP BY 1) e USING (template_id)")
_on_logs("user_impact", lambda x: retrieval.user_impact(x, "error user"), "SELECT count(DISTINCT user_id) AS affected_users, date_sub('second', min(ts), max(ts)) AS impact_seconds FROM log_entries WHERE message LIKE '%error user%'")
_on_logs("user_impact_breakdown", lambda x: retrieval.user_impact_breakdown(x, "error user"), 'SELECT user_id AS "user", count(*) AS n FROM log_entries WHERE message LIKE \'%error user%\' GROUP BY 1')
_on_logs("service_logs", lambda x: _shown(retrieval.service_logs(x, "click", "12h")), f"SELECT id, {_AT.format('ts')} AS at, level, message FROM log_entries, (SELECT max(ts) AS t FROM log_entries) a WHERE message LIKE '%click%' AND ts >= t - INTERVAL 12 HOUR")
_EDGES = "edges AS (SELECT a.service AS source, b.service AS target, count(*) AS n FROM log_entries a JOIN log_entries b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL {} AND a.service <> b.service GROUP BY 1, 2)"
_on_logs("service_edges", lambda x: retrieval.service_edges(x, "6h"), f", {_EDGES.format('6 HOUR')} SELECT * FROM edges")
_on_logs("service_bottlenecks", lambda x: retrieval.service_bottlenecks(x, "6h"), f", {_EDGES.format('6 HOUR')} SELECT service, in_edges::BIGINT AS in_edges, round(share, 6) AS error_share, round(in_edges * share, 4) AS score FROM (SELECT target AS service, sum(n) AS in_edges FROM edges GROUP BY 1) JOIN (SELECT service, avg((level = 'ERROR')::INT) AS share FROM log_entries GROUP BY 1) USING (service)")
_on_logs("critical_paths", lambda x: retrieval.critical_paths(x, "signup", "6h"), f", {_EDGES.format('6 HOUR')} , p AS (SELECT [source, target] AS path, n AS strength FROM edges WHERE source = 'signup'), q AS (SELECT list_append(path, target) AS path, least(strength, n) AS strength FROM p JOIN edges ON source = path[-1] WHERE NOT list_contains(path, target)), r AS (SELECT list_append(path, target) AS path, least(strength, n) AS strength FROM q JOIN edges ON source = path[-1] WHERE NOT list_contains(path, target)) SELECT array_to_string(path, '>') AS path, strength FROM (FROM p UNION ALL FROM q UNION ALL FROM r)")
_on_logs("event_context", lambda x: retrieval.event_context(x, 500, "2h"), f"SELECT e.id, {_AT.format('e.ts')} AS at, level, message, CASE WHEN e.id = 500 THEN 'target' WHEN e.ts < t THEN 'preceding' ELSE 'following' END AS relation, e.template_id = tid AS same_template FROM log_entries e, (SELECT ts AS t, template_id AS tid FROM log_entries WHERE id = 500) a WHERE e.ts BETWEEN t - INTERVAL 2 HOUR AND t + INTERVAL 2 HOUR")
_on_logs("compare_events", lambda x: retrieval.compare_events(x, "user 1", "user 2"), f"SELECT level, n1, n2, n1 - n2 AS diff, users1, users2, {_AT.format('x')} AS first_ts, {_AT.format('y')} AS last_ts FROM (SELECT level, count(*) FILTER (message LIKE '%user 1%') AS n1, count(*) FILTER (message LIKE '%user 2%') AS n2, count(DISTINCT user_id) FILTER (message LIKE '%user 1%') AS users1, count(DISTINCT user_id) FILTER (message LIKE '%user 2%') AS users2, min(ts) AS x, max(ts) AS y FROM log_entries WHERE message LIKE '%user 1%' OR message LIKE '%user 2%' GROUP BY 1)")

# --- statistics -----------------------------------------------------------------------------------
_ROUNDED = ("mean", "median", "std")
_on_logs("calculate_stats", lambda x: stats.calculate_stats(x, "value").select(*[F.round(c, 4).alias(c) if c in _ROUNDED else c for c in ("mean", "median", "std", "min", "max", "count", "unique")]), 'SELECT round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max, count(value) AS count, count(DISTINCT value) AS "unique" FROM log_entries')
_on_logs("detect_anomalies", lambda x: stats.detect_anomalies(x, "value").select("id", "value", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std")), "SELECT id, value, round(m, 4) AS mean, round(s, 4) AS std FROM log_entries, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM log_entries) WHERE abs(value - m) > 2 * s")
_on_logs("group_by_time", stats.group_by_time, f"SELECT {_AT.format(chr(100) + 'ate_trunc(' + repr('hour') + ', ts)')} AS bucket, count(*) AS n FROM log_entries GROUP BY 1")
_on_logs("group_by_time_filled", lambda x: stats.group_by_time(x.where("level = 'ERROR'"), every="1h", fill=True), f"SELECT {_AT.format('b')} AS bucket, count(id) AS n FROM (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS b FROM log_entries WHERE level = 'ERROR') LEFT JOIN (SELECT * FROM log_entries WHERE level = 'ERROR') ON date_trunc('hour', ts) = b GROUP BY 1")
_on_logs("heatmap_counts", lambda x: stats.heatmap_counts(x.withColumn("h", F.hour("ts")), "h", "level", "value", [0, 1, 2]).select("level", *[F.col(str(h)).alias(f"h{h}") for h in (0, 1, 2)]), "SELECT level, " + ", ".join(f"nullif(count(value) FILTER (hour(ts) = {h}), 0) AS h{h}" for h in (0, 1, 2)) + " FROM log_entries GROUP BY level")
_on_logs("correlation_matrix", lambda x: stats.correlation_matrix(x, ["value", "user_id", "id"]), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM log_entries" for a in ("value", "user_id", "id") for b in ("value", "user_id", "id")))
_on_logs("distribution_histogram", lambda x: stats.distribution_histogram(x, "value", 10), "SELECT bin, count(value) AS n FROM (SELECT unnest(range(10))::INT AS bin) LEFT JOIN (SELECT value, least(9, floor((value - lo) / ((hi - lo) / 10)))::INT AS bin FROM log_entries, (SELECT min(value) AS lo, max(value) AS hi FROM log_entries)) USING (bin) GROUP BY bin")
_on_logs("timeseries", lambda x: stats.timeseries(x.where("level = 'ERROR'"), "ts", "value").select(times.format_time(F.col("ts")).alias("at"), "value"), f"SELECT {_AT.format('ts')} AS at, value FROM log_entries WHERE level = 'ERROR'")
_on_logs("distribution_density", lambda x: stats.distribution_density(x, "value", 5).select(F.round("x", 6).alias("x"), F.round("density", 6).alias("density")), ", e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 4 AS step, count(value) AS n, stddev(value) * pow(count(value), -0.2) AS h FROM log_entries), p AS (SELECT lo + i * step AS x, n, h FROM e, range(5) r(i)) SELECT round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - value) / h, 2)) / (h * sqrt(2 * pi()))) / any_value(n), 6) AS density FROM p, log_entries GROUP BY x")
_on_logs("extract_patterns", lambda x: x.select("id", F.array_join(clean.extract_patterns(F.col("message"), r"[0-9]+"), ",").alias("found")), "SELECT id, array_to_string(regexp_extract_all(message, '[0-9]+'), ',') AS found FROM log_entries")
_add("parse_timestamp", lambda s, d: table(s, d, "orders").select("o_orderkey", times.format_time(times.parse_time(F.date_format("o_orderdate", "dd/MMM/yyyy:HH:mm:ss"), "%d/%b/%Y:%H:%M:%S")).alias("at")), f"SELECT o_orderkey, {_AT.format('o_orderdate')} AS at FROM orders")

# --- kernels over documents.text ------------------------------------------------------------------
def _kernel(name: str, value: Callable[[Column], Column], sql: str) -> None:
    _add(f"kernel_{name}", lambda s, d: table(s, d, "documents").select("doc_id", value(F.col("text")).alias("v")), f"SELECT doc_id, {sql} AS v FROM documents")


_kernel("replace_char", lambda t: F.md5(F.encode(kernels.replace_char(t, "e", "_"), "utf-8")), "md5(replace(text, 'e', '_'))")
_kernel("replace_chars", lambda t: F.md5(F.encode(kernels.replace_chars(t, "aeiou", "_"), "utf-8")), "md5(translate(text, 'aeiou', '_____'))")
_kernel("trim", lambda t: F.md5(F.encode(kernels.trim(F.concat(F.lit(" \t\x0b"), t, F.lit("\n \r"))), "utf-8")), "md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))")
_kernel("contains", lambda t: kernels.contains(t, "tion the"), "contains(text, 'tion the')")
_kernel("split", lambda t: F.size(kernels.split(t, ".")), "CASE WHEN text = '' THEN 0 WHEN suffix(text, '.') THEN len(string_split(text, '.')) - 1 ELSE len(string_split(text, '.')) END")
_kernel("to_lower", lambda t: F.md5(F.encode(kernels.to_lower(t), "utf-8")), f"md5(translate(text, '{kernels.UPPER}', '{kernels.LOWER}'))")
_kernel("find_char", lambda t: kernels.find_char(t, "q"), "nullif(instr(text, 'q'), 0) - 1")
_kernel("find_substring", lambda t: kernels.find_substring(t, "the"), "nullif(instr(text, 'the'), 0) - 1")
_kernel("find_last", lambda t: kernels.find_last(t, "\n"), "length(text) - nullif(instr(reverse(text), chr(10)), 0)")
_kernel("count_char", lambda t: kernels.count_char(t, "\n"), "length(text) - length(replace(text, chr(10), ''))")
_kernel("find_all_char", lambda t: F.array_join(kernels.find_all_char(t, "q"), ","), "array_to_string(list_filter(list_transform(string_split(text, ''), lambda x, i: CASE WHEN x = 'q' THEN i - 1 END), lambda x: x IS NOT NULL), ',')")
_kernel("substring_to", lambda t: F.md5(F.encode(kernels.substring_to(t, ". "), "utf-8")), "md5(string_split(text, '. ')[1])")
_kernel("percent_encode", lambda t: F.md5(F.encode(kernels.percent_encode(t), "utf-8")), "md5(url_encode(text))")
_add("kernel_json_path", lambda s, d: table(s, d, "events").select("event_id", kernels.json_path(F.col("props"), "k").alias("v")), "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
_add("kernel_fields", lambda s, d: table(s, d, "events").withColumn("f", kernels.set_field(F.from_json("props", "map<string,string>"), "type", F.col("event_type"))).select("event_id", kernels.has_field(F.col("f"), "k").alias("has_k"), kernels.get_field(F.col("f"), "type").alias("type"), kernels.get_field(F.col("f"), "none").alias("none")), "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, event_type AS type, '' AS none FROM events")
_on_logs("kernel_is_number", lambda x: x.select("id", F.explode(F.split("message", " ", -1)).alias("t")).groupBy(kernels.is_number(F.col("t")).alias("number")).agg(F.count("*").alias("n")), ", tok AS (SELECT unnest(string_split(message, ' ')) AS t FROM log_entries) SELECT CASE WHEN length(t) = 1 THEN regexp_full_match(t, '[0-9]') ELSE regexp_full_match(t, '[0-9+-][0-9]*\\.?[0-9]*|\\.[0-9]+') END AS number, count(*) AS n FROM tok GROUP BY 1")

_kernel("find_newline", lambda t: kernels.find_newline(t), "coalesce(nullif(instr(text, chr(10)), 0), nullif(instr(text, chr(13)), 0)) - 1")
_kernel("substring_at", lambda t: F.md5(F.encode(kernels.substring_at(t, 5, 40), "utf-8")), "md5(text[6:45])")
_add("kernel_cursor", lambda s, d: table(s, d, "documents").select("doc_id", kernels.advance(F.col("text"), F.lit(10), 200).alias("at"), kernels.at_end(F.col("text"), kernels.advance(F.col("text"), F.lit(10), 200)).alias("ended")), "SELECT doc_id, least(210, length(text)) AS at, length(text) <= 210 AS ended FROM documents")

# --- cleaning -------------------------------------------------------------------------------------
_CLEAN = "trim(regexp_replace(translate(message, ',;:|' || chr(9) || '[]{}()<>', '             '), ' +', ' ', 'g'), ' ')"


def _cleaned(x: DataFrame) -> DataFrame:
    out = clean.clean_lines(x, "message", replacements=[(r"[0-9]+", "<NUM>")])
    return out.select("id", "cleaned", F.array_join(F.try_element_at("terms", F.lit("<NUM>")), ",").alias("numbers"))


def _cleaned_by_pattern(x: DataFrame) -> DataFrame:
    out = clean.clean_lines(x, "message", mode="regex", delimiters=[r"[{}]", r"\s+"], replacements=[(r"user [0-9]+", "USER")])
    return out.select("id", "cleaned", F.array_join(F.try_element_at("terms", F.lit("USER")), ",").alias("users"))


_on_logs("clean_lines", _cleaned, f", c AS (SELECT id, {_CLEAN} AS c FROM log_entries) SELECT id, regexp_replace(c, '[0-9]+', '<NUM>', 'g') AS cleaned, array_to_string(regexp_extract_all(c, '[0-9]+'), ',') AS numbers FROM c")
_on_logs("clean_lines_regex", _cleaned_by_pattern, ", c AS (SELECT id, regexp_replace(regexp_replace(message, '[{}]', ' ', 'g'), '\\s+', ' ', 'g') AS c FROM log_entries) SELECT id, regexp_replace(c, 'user [0-9]+', 'USER', 'g') AS cleaned, array_to_string(regexp_extract_all(c, 'user [0-9]+'), ',') AS users FROM c")
_on_logs("extract_attributes", lambda x: clean.extract_attributes(x.select("id", "message"), {"uid": r"user ([0-9]+)", "k": r'"k": ([0-9]+)', "none": "user"}, "message").select("id", "uid", "k", "none"), "SELECT id, regexp_extract(message, 'user ([0-9]+)', 1) AS uid, regexp_extract(message, '\"k\": ([0-9]+)', 1) AS k, '' AS none FROM log_entries")
_on_logs("identify_timestamps", lambda x: x.select("id", times.format_time(clean.identify_timestamp(F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "message"))).alias("at")), f"SELECT id, {_AT.format('ts')} AS at FROM log_entries")
_on_logs("strip_header", lambda x: x.select("id", clean.strip_header(F.concat(F.lit("["), "level", F.lit("] "), "message")).alias("rest")), "SELECT id, message AS rest FROM log_entries")

# --- template mining ------------------------------------------------------------------------------
_MASK = "regexp_replace(regexp_replace(message, 'user [0-9]+', 'user <*>'), '[0-9]+}$', '<*>')"


def _mined(x: DataFrame) -> DataFrame:
    _, clusters = templates.mine(x, headers=())
    return clusters.groupBy("template").agg(F.sum("count").alias("count"), F.min("first_id").alias("first_id"))


def _mined_rows(x: DataFrame) -> DataFrame:
    rows, _ = templates.mine(x, headers=())
    return rows.select("id", "cluster_id", "template_final")


_on_logs("drain_templates", _mined, f"SELECT {_MASK} AS template, count(*) AS count, min(id) AS first_id FROM log_entries GROUP BY 1")
_on_logs("drain_rows", _mined_rows, f", m AS (SELECT id, {_MASK} AS template_final FROM log_entries), f AS (SELECT template_final, row_number() OVER (ORDER BY min(id)) - 1 AS cluster_id FROM m GROUP BY 1) SELECT id, cluster_id, template_final FROM m JOIN f USING (template_final)")
_on_logs("template_roll_up", lambda x: templates.roll_up(x, "template"), "SELECT template_id, template, count FROM log_templates WHERE template <> ''")
_on_logs("template_params", lambda x: x.select("id", templates.params_of(F.col("template"), F.col("message")).alias("p")).select("id", kernels.get_field(F.col("p"), "param_2").alias("user")), "SELECT id, string_split(message, ' ')[3] AS user FROM log_entries")

# --- vectors --------------------------------------------------------------------------------------


def _vector_topk(s: SparkSession, d: str) -> DataFrame:
    store = table(s, d, "embeddings")
    query = store.where("vec_id = 0").first()["embedding"]
    return vectors.search_similar(store, query, 5, "vec_id").select("vec_id", "label", F.round("score", 4).alias("score"))


def _vector_topk_many(s: SparkSession, d: str) -> DataFrame:
    store = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = vectors.search_many(store.where("id % 50 = 0"), store, 3)
    return found.select("query_id", "id", F.round("score", 4).alias("score"))


_SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_add("vector_topk", _vector_topk, f"SELECT b.vec_id, b.label, round({_SIM}, 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {_SIM} DESC, b.vec_id LIMIT 5")
_add("vector_topk_many", _vector_topk_many, f"SELECT query_id, id, round(s, 4) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_SIM} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE r <= 3")


def _store(s: SparkSession, d: str) -> DataFrame:
    return vectors.store_templates(log_templates(log_entries(s, d)))


def _vector_upsert(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d)
    new = store.where(F.col("template").startswith("error")).withColumn("payload", F.create_map(F.lit("count"), F.lit("0")))
    out = vectors.upsert(store, new)
    # the metadata of one known point
    out = vectors.update_metadata(out, hashlib.md5(b'view user <*> {"k": <*>}').hexdigest(), {"seen": "yes", "count": "-1"})
    return out.select("point_id", kernels.get_field(F.col("payload"), "count").alias("count"), kernels.get_field(F.col("payload"), "seen").alias("seen"))


_add("vector_store", lambda s, d: vectors.get_all(_store(s, d)).select("point_id", "template", kernels.get_field(F.col("payload"), "count").alias("count")), f"{LOGS} SELECT template_id AS point_id, template, count::VARCHAR AS count FROM log_templates ORDER BY point_id LIMIT 100")
_add("vector_upsert", _vector_upsert, f"{LOGS} SELECT template_id AS point_id, CASE WHEN template LIKE 'error%' THEN '0' WHEN template LIKE 'view%' THEN '-1' ELSE count::VARCHAR END AS count, CASE WHEN template LIKE 'view%' THEN 'yes' ELSE '' END AS seen FROM log_templates")
_add("vector_delete", lambda s, d: vectors.delete(_store(s, d), _store(s, d).where("template like 'error%'")).select("template"), f"{LOGS} SELECT template FROM log_templates WHERE template NOT LIKE 'error%'")
_add("embed_hash", lambda s, d: log_entries(s, d).select("id", F.array_join(F.transform(vectors.embed_hash(F.col("message")), lambda v: v.cast("int").cast("string")), ",").alias("places")), f"{LOGS} , t AS (SELECT id, list_transform(list_filter(regexp_split_to_array(lower(message), '[^a-z0-9<*>]+'), lambda x: x <> ''), lambda x: ('0x' || md5(x)[1:8])::BIGINT % 64) AS p FROM log_entries) SELECT id, array_to_string(list_transform(range(64), lambda i: len(list_filter(p, lambda x: x = i))), ',') AS places FROM t")

class _Flaky:
    """An embedder that fails for templates of errors."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[] if t.startswith("error") else [1.0] for t in texts]


_add("vector_load_counts", lambda s, d: vectors.load_counts(log_templates(log_entries(s, d)), _Flaky()), f"{LOGS} SELECT count(*) FILTER (template NOT LIKE 'error%') AS stored, count(*) FILTER (template LIKE 'error%') AS failed FROM log_templates")

# --- the facade: loads replace what was there; questions become operations --------------------------


def _loaded_twice(s: SparkSession, d: str) -> DataFrame:
    logs = log_entries(s, d)
    engine = Engine(s).set_tables(logs, log_templates(logs)).set_tables(logs.where("level = 'ERROR'"))
    return engine.execute_query("SELECT (SELECT count(*) FROM log_entries) AS n, (SELECT sum(count) FROM log_templates) AS in_templates, (SELECT count(DISTINCT level) FROM log_entries) AS levels")


_add("engine_load", _loaded_twice, f"{LOGS} SELECT count(*) AS n, count(*)::HUGEINT AS in_templates, 1 AS levels FROM log_entries WHERE level = 'ERROR'")
_on_logs("engine_frames", lambda x: Engine(x.sparkSession).set_tables(x, log_templates(x)).logs.groupBy("level").agg(F.count("*").alias("n")), "SELECT level, count(*) AS n FROM log_entries GROUP BY 1")
_on_logs("engine_question", lambda x: Engine(x.sparkSession).set_tables(x, log_templates(x)).chat("How often does 'user 14' occur by level?").dataframes[0], "SELECT level, count(*) AS n FROM log_entries WHERE message LIKE '%user 14%' GROUP BY level")
_ASKED = {"How many times does 'x' occur?": "count_occurrences", "Why did 'x' happen?": "analyze_causality", "compare 'a' with 'b'": "compare_events", "which users were affected by 'x'": "analyze_user_impact", "what is the time range": "get_time_range", "show the top patterns": "get_trending_patterns", "find 'x'": "search_logs", "SELECT 1": "execute_query"}
_add("planner", lambda s, d: s.createDataFrame([(q, plan(q).operation) for q in _ASKED], "question string, operation string"), "SELECT * FROM (VALUES " + ", ".join("('" + q.replace("'", "''") + f"', '{o}')" for q, o in _ASKED.items()) + ") v(question, operation)")

# --- SQL pass-through: the same statement, translated for Spark ------------------------------------


def _views(s: SparkSession, d: str) -> None:
    for name in ("orders", "customer", "nation", "region", "lineitem", "supplier", "part", "events"):
        table(s, d, name).createOrReplaceTempView(name)
    log_entries(s, d).createOrReplaceTempView("log_entries")


def _pass(name: str, sql: str, oracle: str | None = None) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        _views(s, d)
        return dialect.execute(s, sql)

    _add(f"sql_{name}", run, (f"{LOGS} " if "log_entries" in sql else "") + (oracle or sql))


_pass("equi_join", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
_pass("theta_join", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
_pass("semi_join", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
_pass("anti_join", "SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000) o ON o_custkey = c_custkey")
_pass("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_pass("rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_pass("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_pass("distinct_agg", "SELECT level, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS high FROM log_entries GROUP BY level")
_pass("window_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quarter FROM orders")
_pass("window_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders")
_pass("union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
_pass("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_pass("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
_pass("correlated_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_pass("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")
_pass("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (sum(l_quantity) AS q FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS o, sum(l_quantity) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY 1")
_pass("qualify_rewrite", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
_pass("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey DESC")
_pass("arg_max", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best, median(o_totalprice) AS mid FROM orders GROUP BY o_custkey")
_pass("exclude", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer WHERE c_acctbal > 0")
_pass("strftime", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
_pass("interval", "SELECT count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '90m'")
_pass("integer_division", "SELECT o_orderkey // 7 AS b, count(*) AS n FROM orders GROUP BY 1")
_LAG = "SELECT event_id, lag(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN event_id END AS v FROM events) q"
_pass("lag_ignore_nulls", _LAG)
_pass("json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
_pass("lateral", "SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x")


_pass("union_by_name", "SELECT n_name AS name, n_regionkey AS k FROM nation UNION ALL BY NAME SELECT r_regionkey AS k, r_name AS name, 1 AS region FROM region")
_pass("union_by_name_distinct", "SELECT n_regionkey AS k, 'a' AS x FROM nation UNION BY NAME SELECT 'a' AS x, r_regionkey AS k FROM region ORDER BY k")
_pass("strftime_letters", "SELECT strftime(o_orderdate, '%Y-W%m day %d') AS label, count(*) AS n FROM orders GROUP BY ALL")
_pass("nested_qualify", "SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2) t GROUP BY o_custkey")
_pass("cte_distinct_on", "WITH last AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey DESC) SELECT o_custkey, o_orderkey FROM last QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 10")
_pass("struct_literal", "SELECT r_name, {'key': r_regionkey, name: r_name}.key AS k FROM region WHERE r_name <> '{a: 1}'")
_pass("dynamic_pivot", "PIVOT (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) ON o_orderstatus USING count(o_orderkey) GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")

# --- functions and brackets whose meaning differs between the engines: the same text runs on both -----------
_pass(
    "string_split",
    """
SELECT c_custkey, string_split(c_name, '#')[2] AS number, len(string_split(c_mktsegment, '')) AS letters,
       array_to_string(string_split(c_acctbal::VARCHAR, '.'), '|') AS parts
FROM customer
""",
)
_pass(
    "json_extract",
    """
SELECT event_id, json_extract(concat('{"t": "', event_type, '"}'), '$.t')::VARCHAR AS t,
       json_extract(props, 'k')::VARCHAR AS k, json_extract(props, '$.none')::VARCHAR AS none
FROM events
""",
)
_pass(
    "time_bucket",
    """
SELECT strftime(time_bucket(INTERVAL 7 DAY, ts), '%Y-%m-%d') AS week, strftime(time_bucket(INTERVAL 2 MONTH, ts), '%Y-%m-%d') AS months,
       strftime(time_bucket(INTERVAL 25 MINUTE, ts), '%H:%M') AS part, count(*) AS n
FROM events GROUP BY 1, 2, 3
""",
)
_pass("epoch", "SELECT event_id, epoch(ts) AS seconds, epoch(ts + INTERVAL 500 MILLISECOND) AS half FROM events")
_pass(
    "regexp_replace",
    r"""
SELECT c_custkey, regexp_replace(c_name, '0', '-') AS first, regexp_replace(c_name, '(\d)(\d)', '\2\1', 'g') AS swapped,
       regexp_replace(c_name, '(C)u', '$\1', 'i') AS sign, regexp_replace(c_name, '0+', '7') AS digit
FROM customer
""",
)
_pass(
    "lists",
    """
SELECT n_name, list_transform(string_split(n_name, 'A'), lambda x, i: x || i)[1] AS head, [n_regionkey, n_nationkey][-1] AS last,
       len(list_filter([1, 2, n_regionkey], lambda x: x > 1)) AS n, list_contains([0, 1], n_regionkey) AS low
FROM nation
""",
)
_pass("unnest", "SELECT r_name, x, y.k AS k FROM (SELECT r_name, unnest([r_regionkey, 7]) AS x FROM region) q, (SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (1, 2)) y")
_pass(
    "ordered_agg",
    """
SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names, array_to_string(list(n_nationkey::VARCHAR ORDER BY n_name), ' ') AS keys,
       count(*) FILTER (n_nationkey > 10) AS high
FROM nation GROUP BY n_regionkey
""",
)
_pass(
    "date_functions",
    """
SELECT event_id, date_diff('day', ts, TIMESTAMP '2024-02-01 12:00:00') AS days, date_sub('day', ts, TIMESTAMP '2024-02-01 12:00:00') AS whole,
       date_diff('month', ts, TIMESTAMP '2024-12-31') AS months, strptime('03/Feb/2024', '%d/%b/%Y') > ts AS before
FROM events
""",
)
_pass("similar_to", "SELECT count(*) FILTER (c_name SIMILAR TO 'Customer#0*1[0-9]') AS a, count(*) FILTER (regexp_matches(c_name, '1[0-9]$')) AS b FROM customer")


def _summary(s: SparkSession, d: str) -> DataFrame:
    _views(s, d)
    return dialect.execute(s, "SUMMARIZE SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders").select("column_name", "min", "max", F.round("avg", 3).alias("avg"), F.round("std", 3).alias("std"), "count", "null_percentage")


_add("sql_summarize", _summary, "SELECT 'o_orderkey' AS column_name, min(o_orderkey)::VARCHAR AS min, max(o_orderkey)::VARCHAR AS max, round(avg(o_orderkey), 3) AS avg, round(stddev(o_orderkey), 3) AS std, count(*) AS count, 0.0::DOUBLE AS null_percentage FROM orders UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus), NULL, NULL, count(*), 0.0 FROM orders UNION ALL SELECT 'o_totalprice', min(o_totalprice)::VARCHAR, max(o_totalprice)::VARCHAR, round(avg(o_totalprice), 3), round(stddev(o_totalprice), 3), count(*), 0.0 FROM orders")
_add("sql_positional_join", lambda s, d: retrieval.positional_join(table(s, d, "nation").select("n_name"), table(s, d, "region").select("r_name"), ["n_name"], ["r_name"]), "SELECT n_name, r_name FROM (SELECT n_name FROM nation ORDER BY n_name) POSITIONAL JOIN (SELECT r_name FROM region ORDER BY r_name)")


def _asof(s: SparkSession, d: str) -> DataFrame:
    e = log_entries(s, d)
    errors = e.where("level = 'ERROR'").select("id", "user_id", "ts")
    clicks = e.where("service = 'click'").select("user_id", "ts", F.col("id").alias("click_id"))
    return retrieval.asof_join(errors, clicks, "user_id", "ts", "click_id").where("click_id is not null").select("id", "click_id")


_add("sql_asof_join", _asof, f"{LOGS} SELECT e.id, c.id AS click_id FROM (SELECT * FROM log_entries WHERE level = 'ERROR') e ASOF JOIN (SELECT * FROM log_entries WHERE service = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts")
_add("sql_sample", lambda s, d: table(s, d, "orders").sample(0.1, 7).agg((F.count("*") > 0).alias("some"), F.count_if(~F.col("o_orderkey").isNotNull()).alias("odd")).crossJoin(table(s, d, "orders").agg(F.count("*").alias("all"))), "SELECT count(*) > 0 AS some, 0::BIGINT AS odd, count(*) AS \"all\" FROM orders")

# --- streams over the events, written in several files and read a few at a time ----------------------------


def _stream(x: DataFrame, *columns: str) -> DataFrame:
    """log_entries as a stream.  Its files are in no order of time, so nothing is too late for a complete result."""
    path = new_path(x.sparkSession, "stream")
    rows = x.select(*columns)
    rows.repartition(6).write.parquet(path)
    return streams.read_table(x.sparkSession, path, rows.schema, 2)


def _sliding(x: DataFrame) -> DataFrame:
    counts = streams.window_counts(streams.event_time(_stream(x, "ts"), late=None), every="2h", slide="1h")
    return streams.collected(counts, "sliding", "complete").select(times.format_time(F.col("window_start")).alias("start"), "n")


def _sessions(x: DataFrame) -> DataFrame:
    found = streams.sessions(streams.event_time(_stream(x, "ts", "user_id"), late=None), gap="30m")
    return streams.collected(found, "sessions", "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def _live(x: DataFrame) -> DataFrame:
    """Lines of each template, as it stands at the end of the stream."""
    streams.use_rocksdb(x.sparkSession)
    tokens = F.split("message", " ", -1)
    keys = F.transform(F.slice(tokens, 1, 4), lambda t: F.when(kernels.is_number(t), F.lit("<*>")).otherwise(t))
    lines = x.select("id", F.array_join(F.concat(F.array(F.size(tokens).cast("string")), keys), " ").alias("leaf"), tokens.alias("tokens"))
    path = new_path(x.sparkSession, "live")
    lines.repartitionByRange(4, "id").write.parquet(path)
    out = streams.collected(streams.live_templates(streams.read_table(x.sparkSession, path, lines.schema, 1)), "live")
    return out.groupBy("leaf", "number").agg(F.max_by("template", "id").alias("template"), F.count("*").alias("n")).select("template", "n")


_on_logs("live_templates", _live, f"SELECT {_MASK} AS template, count(*) AS n FROM log_entries GROUP BY 1")
_on_logs("window_sliding", _sliding, f"SELECT {_AT.format('w')} AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM log_entries) GROUP BY 1")
_on_logs("sessions", _sessions, ", s AS (SELECT user_id, id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM log_entries), k AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, id) AS k FROM s), g AS (SELECT user_id, k, count(*) AS n FROM k GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY 1")


# --- parsers: events written as lines, parsed back ---------------------------------------------------


def _round_trip(format: str, line: Callable[[], Column], **options) -> Callable[[SparkSession, str], DataFrame]:
    from ..sources.parsers import parse_rows

    def run(s: SparkSession, d: str) -> DataFrame:
        r = parse_rows(log_entries(s, d).select("id", line().alias("line")), "line", format, "id", **options)
        return r.select("id", times.format_time(F.col("timestamp")).alias("at"), F.coalesce("level", F.lit("")).alias("level"), F.coalesce("message", F.lit("")).alias("message"))

    return run




def _iso() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")


def _csv(s: SparkSession, d: str) -> DataFrame:
    from ..sources.parsers import parse_rows

    lines = log_entries(s, d).select("id", F.concat_ws(",", _iso(), "level", "service", F.col("user_id").cast("string")).alias("line"))
    r = parse_rows(lines, "line", "csv", "id", dimensions=("timestamp", "severity", "body", "user"))
    return r.select("id", times.format_time(F.col("timestamp")).alias("at"), "severity", "body", F.col("fields")["user"].alias("who"))


_PARSED = f"{LOGS} SELECT id, {{at}} AS at, level, {{m}} AS message FROM log_entries"
_plain_at = _AT.format("ts")
_add("parse_json", _round_trip("json", lambda: F.to_json(F.struct(_iso().alias("time"), F.col("level"), F.col("message").alias("msg"), "user_id"))), _PARSED.format(at=_plain_at, m="message"))
_add("parse_logfmt", _round_trip("logfmt", lambda: F.concat(F.lit("time="), _iso(), F.lit("Z level="), "level", F.lit(' msg="'), "service", F.lit(' user" user='), F.col("user_id").cast("string"))), _PARSED.format(at=_plain_at, m="service || ' user'"))
_add("parse_syslog", _round_trip("syslog", lambda: F.concat(_iso(), F.lit(" host app[7]: "), "message")), f"{LOGS} SELECT id, {_plain_at} AS at, 'INFO' AS level, message FROM log_entries")
_add("parse_log4j", _round_trip("log4j", lambda: F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 "), "level", F.lit(" [main] org.sample.Oven: "), "message")), _PARSED.format(at=_plain_at, m="message"))
_add("parse_cef", _round_trip("cef", lambda: F.concat(F.lit("CEF:0|v|p|1|"), F.col("id").cast("string"), F.lit("|n|"), "level", F.lit("|msg="), "service", F.lit(" user src=1.2.3.4"))), f"{LOGS} SELECT id, NULL::VARCHAR AS at, level, service || ' user' AS message FROM log_entries")
_add("parse_csv", _csv, f"{LOGS} SELECT id, {_plain_at} AS at, level AS severity, service AS body, user_id::VARCHAR AS who FROM log_entries")
_add("parse_regex", _round_trip("regex", lambda: F.concat("level", F.lit("|"), "service"), log_pattern=r"([A-Z]+)\|(\w+)", groups=("level", "message")), f"{LOGS} SELECT id, NULL::VARCHAR AS at, level, service AS message FROM log_entries")
