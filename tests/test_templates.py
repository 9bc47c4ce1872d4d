"""Distributed template mining against a sequential model with one tree."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import folding, templates


def sequential(lines, depth, threshold, cap):
    """One tree, one pass: final templates by line id."""
    root, out, clusters = {}, {}, []

    def key(t):
        return "<*>" if folding.number_like(t) else t

    for i, text in lines:
        if text == "":
            clusters.append({"tokens": ["<EMPTY>"]})
            out[i] = clusters[-1]
            continue
        tokens = text.split(" ")
        node = root.setdefault(len(tokens), {"kids": {}, "cs": []})
        for t in tokens[:depth]:
            k = key(t)
            if k not in node["kids"]:
                if len(node["kids"]) >= cap:
                    k = "<*>"
                node["kids"].setdefault(k, {"kids": {}, "cs": []})
            node = node["kids"][k]
        best, most = None, -1
        for c in node["cs"]:
            s = sum(a == b or a == "<*>" for a, b in zip(c["tokens"], tokens)) / len(tokens)
            if s > most:
                best, most = c, s
        if best is None or most < threshold:
            best = {"tokens": list(tokens)}
            node["cs"].append(best)
            clusters.append(best)
        else:
            best["tokens"] = [a if a == b or a == "<*>" else "<*>" for a, b in zip(best["tokens"], tokens)]
        out[i] = best
    number = {id(c): n for n, c in enumerate(clusters)}
    return {i: (number[id(c)], " ".join(c["tokens"])) for i, c in out.items()}


@pytest.mark.parametrize("seed,depth,threshold,cap", [(1, 4, 0.5, 100), (2, 2, 0.4, 3), (3, 3, 0.6, 2), (4, 1, 0.5, 1)])
def test_matches_sequential(spark, seed, depth, threshold, cap):
    rng = random.Random(seed)
    lines = [(i, " ".join(rng.choice(["a", "b", "c", "7", "-1", "x9", ""]) for _ in range(rng.randint(0, 5)))) for i in range(300)]
    df = spark.createDataFrame(lines, "id bigint, message string").repartition(5)
    rows, clusters = templates.mine(df, depth=depth, threshold=threshold, max_children=cap, headers=())
    got = {r["id"]: (r["cluster_id"], r["template_final"]) for r in rows.collect()}
    want = sequential(lines, depth, threshold, cap)
    assert got == want
    assert clusters.agg(F.sum("count")).first()[0] == len(lines)


@pytest.mark.parametrize("seed,chunk,threshold", [(1, 7, 0.5), (2, 40, 0.5), (3, 3, 0.7), (4, 1000, 0.4), (5, 1, 0.5)])
def test_one_leaf_in_many_chunks(spark, seed, chunk, threshold):
    """All lines in one leaf; templates keep changing, so guesses fail and chunks run again."""
    rng = random.Random(seed)
    lines = [(i * 3, " ".join(rng.choice(["a", "b", "c", "7", "x9", "", "<*>", f"v{i // 60}"]) for _ in range(5))) for i in range(240)]
    df = spark.createDataFrame(lines, "id bigint, message string").repartition(3)
    rows, clusters = templates.mine(df, depth=0, threshold=threshold, headers=(), chunk=chunk)
    got = rows.collect()
    assert {r["id"]: (r["cluster_id"], r["template_final"]) for r in got} == sequential(lines, 0, threshold, 100)
    leaf, at_parse = folding.Leaf(threshold), {}
    for i, text in lines:
        c = leaf.add(text.split(" "), i)
        at_parse[i] = (c.text, {f"param_{p}": text.split(" ")[p] for p in c.params})
    assert {r["id"]: (r["template_at_parse"], r["params"]) for r in got} == at_parse
    assert sum(r["count"] for r in clusters.collect()) == len(lines)


def test_a_hot_leaf_is_many_tasks(spark):
    """Ranges of one leaf go to several tasks, and no chunk has more lines than its size."""
    df = spark.range(20_000).select("id", F.lit("3").alias("leaf"), F.concat(F.lit("x y "), F.col("id").cast("string")).alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = folding.chunked(df, 0.5, 500).select(F.spark_partition_id().alias("p"), F.size("lines").alias("n"))
    by = {r["p"]: r["n"] for r in got.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(by) > 1 and sum(by.values()) == 20_000 and max(by.values()) < 15_000
    assert got.agg(F.max("n")).first()[0] <= 500


@pytest.mark.parametrize("seed", range(6))
def test_fold_is_add(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(["a", "b", "<*>", "5", "q"]) for _ in range(4)) for _ in range(120)]
    one, many = folding.Leaf(0.5), folding.Leaf(0.5)
    want = [(c.number, c.text, c.places) for c in (one.add(x.split(" "), i) for i, x in enumerate(lines))]
    got = [many.fold(lines[lo : lo + 50], list(range(lo, len(lines)))) for lo in range(0, 120, 50)]
    assert [x for g in got for x in zip(*g[:3])] == want


def test_find_cluster(spark):
    mined = spark.createDataFrame([(0, "user 5 in"), (1, "disk full"), (2, ""), (3, "user 6 in")], "id bigint, message string")
    _, clusters = templates.mine(mined, headers=())
    lines = spark.createDataFrame([(1, "user 7 in"), (2, "disk full"), (3, "a b c"), (4, "one"), (5, ""), (6, "user x in")], "id bigint, message string")
    assert dict(templates.find_cluster(lines, clusters, headers=()).collect()) == {1: 0, 2: 1, 3: -1, 4: -1, 5: -1, 6: 0}
    assert templates.template_of(clusters, 0).first()["template"] == "user <*> in" and templates.template_of(clusters, 9).count() == 0


@pytest.mark.parametrize("seed,depth,threshold,cap", [(1, 4, 0.5, 100), (2, 2, 0.4, 3), (3, 3, 0.6, 2)])
def test_find_cluster_walks_the_tree(spark, seed, depth, threshold, cap):
    """Against a walk over a tree of dicts, made from the mined clusters' places."""
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(["a", "b", "c", "7", "-1", "x9", ""]) for _ in range(rng.randint(0, 5)))
    mined = spark.createDataFrame([(i, line()) for i in range(150)], "id bigint, message string")
    clusters = templates.mine(mined, depth=depth, threshold=threshold, max_children=cap, headers=())[1]
    leaves, nodes = {}, set()
    for r in clusters.where("leaf is not null").collect():
        leaves.setdefault(tuple(r["leaf"].split("\x1f")), []).append((r["cluster_id"], r["template"].split(" ")))
    for path in leaves:
        nodes |= {path[: i + 1] for i in range(len(path))}

    def walk(text):
        tokens = text.split(" ") if text else []
        path = (str(len(tokens)),)
        for t in tokens[:depth]:
            path = next((p for p in (path + ("<*>" if folding.number_like(t) else t,), path + ("<*>",)) if p in nodes), ("none",))
        scored = [(sum(a == b or a == "<*>" for a, b in zip(c, tokens)) / len(tokens), -n) for n, c in leaves.get(path, [])]
        best = max((x for x in scored if x[0] >= threshold), default=(0, 1))
        return -best[1]

    asked = [(i, line()) for i in range(200)]
    got = dict(templates.find_cluster(spark.createDataFrame(asked, "id bigint, message string"), clusters, depth=depth, threshold=threshold, headers=()).collect())
    assert got == {i: walk(t) for i, t in asked} and max(got.values()) > -1


def test_empty_table(spark):
    rows, clusters = templates.mine(spark.createDataFrame([], "id bigint, message string"))
    assert rows.count() == 0 and clusters.count() == 0


def test_lines_of_a_cluster_are_not_one_task(spark):
    """Lines meet their clusters where they are, whatever their size; clusters are broadcast by their bytes."""
    lines = spark.range(3000).selectExpr("id", "concat('one big cluster ', id % 9) AS message")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, clusters = templates.mine(lines, depth=0, chunk=100)
        dealt = templates.leaves(lines.selectExpr("id", "split(message, ' ') AS tokens"), 0, 100)
        assert "SortMergeJoin" not in dealt._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.groupBy("template_final").count().collect() == [("one big cluster <*>", 3000)] and clusters.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
