"""Template mining in the order of the lines, without a global tree.

Clusters of a leaf depend on that leaf's lines only, and a line's leaf on its token count and first
keys, but for the cap on children: of the keys below one node only the first to arrive, up to the cap,
are kept, later ones become <*>.  Arrival order is the least line id of a key, so the caps are ranks of
distinct key paths, cut to the cap before they are shuffled; each line joins its leaf by its keys.  The
lines of a leaf are then folded in chunks by many tasks (module folding), with the result of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import HEADERS, strip_header
from ..functions.kernels import is_number
from ..functions.tables import written
from . import folding
from .folding import CHUNK, WILD

EMPTY = "<EMPTY>"
DEPTH, THRESHOLD, MAX_CHILDREN = 4, 0.5, 100


def tokenize(content):
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(content, " ", -1))


def leaves(lines: DataFrame, depth: int, max_children: int) -> DataFrame:
    """lines (id, tokens) with leaf: the path of count and keys after the caps; null for empty lines."""
    key = lambda i: F.when(F.size("tokens") > i, F.when(is_number(F.get("tokens", i)), F.lit(WILD)).otherwise(F.get("tokens", i)))
    names = [f"__k{i}" for i in range(depth)]
    rows = lines.withColumns({"__n": F.size("tokens")} | {n: key(i) for i, n in enumerate(names)})
    paths = rows.where("__n > 0").groupBy("__n", *names).agg(F.min("id").alias("first")).withColumn("leaf", F.col("__n").cast("string"))
    for n in names:
        # of a node's keys the first to arrive are kept (a line has one key, so no two tie); the others share
        # the wildcard.  Each task passes on max_children keys of a node at most, so no node is a hot task
        paths = written(paths, "paths")
        firsts = paths.where(F.col(n).isNotNull()).groupBy("leaf", n).agg(F.min("first").alias("__f"))
        ranked = firsts.withColumn("__r", F.row_number().over(Window.partitionBy("leaf").orderBy("__f"))).where(F.col("__r") <= max_children)
        kept = ranked.select(F.col("leaf").alias("__leaf"), F.col(n).alias("__key"), F.lit(True).alias("__kept"))
        paths = paths.join(kept, (F.col("leaf") == F.col("__leaf")) & (F.col(n) == F.col("__key")), "left")
        step = F.when(F.col(n).isNull(), F.lit("")).when(F.col("__kept"), F.concat(F.lit("\x1f"), n)).otherwise(F.lit("\x1f" + WILD))
        paths = paths.withColumn("leaf", F.concat("leaf", step)).drop("__leaf", "__key", "__kept")
    p = paths.select(F.col("__n").alias("__m"), *[F.col(n).alias(n + "_") for n in names], "leaf")
    on = F.col("__n") == F.col("__m")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(n + "_"))
    # lines of one path, or at depth 0 of one count, would be one task's share of a join by shuffle
    p = written(p, "leaves")
    size = p.agg(F.sum(3 * F.octet_length("leaf") + 64)).first()[0] or 0
    return rows.join(F.broadcast(p) if size <= folding.SMALL else p, on, "left").select("id", "tokens", "leaf")


def mine(lines: DataFrame, column: str = "message", depth: int = DEPTH, threshold: float = THRESHOLD, max_children: int = MAX_CHILDREN, headers=HEADERS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(rows, clusters) of lines with id (dense or not, but ordered) and a text column.

    rows: id, cluster_id, template_at_parse, template_final, params.  clusters: cluster_id, template,
    count, first_id, leaf (its place in the tree).  cluster_id counts clusters in order of their first line; every empty line is a
    cluster of its own.
    """
    content = strip_header(F.coalesce(F.col(column), F.lit("")), headers) if headers else F.coalesce(F.col(column), F.lit(""))
    dealt = leaves(lines.select("id", tokenize(content).alias("tokens")), depth, max_children)

    full = dealt.where("leaf is not null")
    got, final = folding.fold_leaves(full.select("leaf", "id", F.array_join("tokens", " ").alias("line")), threshold, chunk)
    counts = got.groupBy("leaf", "number").agg(F.count("*").alias("n"))
    final = final.join(counts, ["leaf", "number"])
    none = lines.select("id", content.alias("c")).where("c = ''").select("id")
    alone = none.select(F.lit(None).cast("string").alias("leaf"), F.lit(0).alias("number"), F.lit(EMPTY).alias("template"), F.col("id").alias("first_id"), F.lit(1).cast("bigint").alias("n"))
    numbered = _numbered(final.unionByName(alone))
    clusters = numbered.select("cluster_id", "template", F.col("n").alias("count"), "first_id", "leaf")
    known = numbered.where("leaf is not null").select("leaf", "number", "cluster_id", F.col("template").alias("template_final"))
    # a cluster of many lines would be one task's share of a join by shuffle
    size = known.agg(F.sum(F.octet_length("leaf") + F.octet_length("template_final") + 64)).first()[0] or 0
    rows = got.join(F.broadcast(known) if size <= folding.SMALL else known, ["leaf", "number"])
    rows = rows.select("id", "cluster_id", F.col("template").alias("template_at_parse"), "template_final", _params().alias("params"))
    empty = numbered.where("leaf is null").select(F.col("first_id").alias("id"), "cluster_id", F.lit(EMPTY).alias("template_at_parse"), F.lit(EMPTY).alias("template_final"), F.create_map().cast("map<string,string>").alias("params"))
    return rows.unionByName(empty), clusters


def _params():
    """A row's parameters from its line and its cluster's places at the time."""
    at, tokens = F.split("places", ","), F.split("line", " ", -1)
    pairs = F.map_from_arrays(F.transform(at, lambda i: F.concat(F.lit("param_"), i)), F.transform(at, lambda i: F.get(tokens, i.cast("int"))))
    return F.when(F.col("places") == "", F.create_map().cast("map<string,string>")).otherwise(pairs)


def _numbered(clusters: DataFrame) -> DataFrame:
    """clusters with cluster_id, by first_id: ranks of range parts, then offsets of the parts."""
    from ..sources.reader import with_ordinal

    return with_ordinal(clusters, ["first_id"]).withColumnRenamed("id", "cluster_id")


def mined_records(lines: DataFrame, column: str = "message", **options) -> DataFrame:
    """Lines as records of the mining parser: body, template at parse time, cluster_id, source and the
    first space-separated token as detected_timestamp if it holds ':' or '-'."""
    rows, _ = mine(lines, column, **options)
    head = F.substring_index(F.col(column), " ", 1)
    out = lines.join(rows, "id")
    fields = F.map_filter(F.create_map(F.lit("cluster_id"), F.col("cluster_id").cast("string"), F.lit("source"), F.lit("log"), F.lit("detected_timestamp"), F.when(head.rlike("[:-]"), head)), lambda _, v: v.isNotNull())
    return out.select("id", F.col(column).alias("body"), F.col("template_at_parse").alias("template"), fields.alias("fields"), "cluster_id", "template_final", "params")


def roll_up(rows: DataFrame, column: str = "template_final") -> DataFrame:
    """log_templates of mined rows: template_id, template, count; empty templates left out."""
    out = rows.where(F.col(column) != "").groupBy(F.col(column).alias("template")).agg(F.count("*").alias("count"))
    return out.select(F.md5(F.encode("template", "utf-8")).alias("template_id"), "template", "count")


def find_cluster(lines: DataFrame, clusters: DataFrame, column: str = "message", depth: int = DEPTH, threshold: float = THRESHOLD, headers=HEADERS) -> DataFrame:
    """id and the most similar cluster's id for lines that are not mined; -1 where none is near enough.

    A line walks down the tree: at each level to the child of its key, else to the wildcard child, else it
    is unknown.  Each step is a join with the tree's nodes; at the leaf it meets that leaf's clusters only.
    """
    content = strip_header(F.coalesce(F.col(column), F.lit("")), headers) if headers else F.coalesce(F.col(column), F.lit(""))
    known = written(clusters.where("leaf is not null").select("cluster_id", "leaf", F.split("template", " ", -1).alias("t")), "clusters")
    steps = F.split("leaf", "\x1f", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "\x1f"))
    nodes = written(known.select(F.explode(prefixes).alias("node")).distinct(), "nodes")
    rows = lines.select("id", tokenize(content).alias("tokens")).where(F.size("tokens") > 0).withColumn("path", F.size("tokens").cast("string"))
    rows = rows.join(nodes, F.col("path") == F.col("node"), "left_semi")
    for i in range(depth):
        token = F.get("tokens", i)
        key = F.when(is_number(token), F.lit(WILD)).otherwise(token)
        own, wild = F.concat("path", F.lit("\x1f"), key), F.concat("path", F.lit("\x1f" + WILD))
        rows = rows.join(nodes.select(F.col("node").alias("own")), own == F.col("own"), "left")
        rows = rows.join(nodes.select(F.col("node").alias("wild")), F.col("own").isNull() & (wild == F.col("wild")), "left")
        rows = rows.withColumn("path", F.when(F.size("tokens") > i, F.coalesce("own", "wild")).otherwise(F.col("path"))).drop("own", "wild").where("path is not null")
    same = F.size(F.filter(F.zip_with("t", "tokens", lambda p, q: (p == q) | (p == WILD)), lambda b: b)) / F.size("tokens")
    near = rows.join(known, rows["path"] == known["leaf"]).select("id", same.alias("s"), "cluster_id").where(F.col("s") >= threshold)
    best = near.groupBy("id").agg(F.max(F.struct("s", (-F.col("cluster_id")).alias("m"))).alias("b"))
    return lines.select("id").join(best, "id", "left").select("id", F.coalesce(-F.col("b.m"), F.lit(-1)).alias("cluster_id"))


def template_of(clusters: DataFrame, cluster_id: int) -> DataFrame:
    """The template of a cluster's id; no row for an unknown one."""
    return clusters.where(F.col("cluster_id") == cluster_id).select("template")


def params_of(template, text):
    """Values at a template's wildcards, as a map param_<i>."""
    pairs = F.zip_with(F.split(template, " ", -1), F.split(text, " ", -1), lambda t, x: F.when(t == WILD, x))
    keys = F.transform(pairs, lambda v, i: F.concat(F.lit("param_"), i.cast("string")))
    return F.map_filter(F.map_from_arrays(keys, pairs), lambda _, v: v.isNotNull())
