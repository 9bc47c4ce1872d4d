"""Frames, selection by rank, edges and causes against plain Python."""

import math
import random
import statistics
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.operators import frames, retrieval, stats
from cairn.plans import analysis
from cairn.sources import reader


def plain_frame(rows, i, units, start, end, exclude):
    """Rows of (key, value), ordered by key, that row i's frame holds."""
    keys = sorted({k for k, _ in rows}, key=lambda k: (k is not None, k or 0))
    at = [keys.index(k) for k, _ in rows] if units == "groups" else list(range(len(rows)))
    inside = [j for j in range(len(rows)) if (start is None or at[j] >= at[i] + start) and (end is None or at[j] <= at[i] + end)]
    peer = {j for j in inside if rows[j][0] == rows[i][0]}
    gone = {"no others": set(), "current row": {i}, "group": peer, "ties": peer - {i}}[exclude]
    return [rows[j][1] for j in inside if j not in gone]


@pytest.mark.parametrize("exclude", frames.EXCLUDES)
@pytest.mark.parametrize("units,start,end", [("groups", -1, 1), ("groups", None, 0), ("groups", -2, -1), ("groups", 1, None), ("groups", 0, 0), ("groups", None, None), ("rows", -2, 1), ("rows", None, -1), ("rows", 0, None)])
def test_frames(spark, exclude, units, start, end):
    rng = random.Random(f"{exclude}{units}{start}{end}")
    # under ROWS, peers have one value, so their order does not matter
    keys = [rng.choice([None, 1, 2, 2, 5, 9]) for _ in range(14)]
    rows = [(k, rng.choice([None, 3, 7, -4]) if units == "groups" else (k or 0) * 3) for k in keys]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    df = spark.createDataFrame([(0, k, v, i) for i, (k, v) in enumerate(rows)], "p int, k int, v int, i int").unionByName(spark.createDataFrame([(1, None, None, 99)], "p int, k int, v int, i int"))
    order = ["k"] if units == "groups" else ["k", "i"]
    if units == "rows" and exclude in ("group", "ties"):
        order = ["k"]
    cells = {"s": ("sum", "v"), "n": ("count", "v"), "m": ("avg", "v")}
    if units == "groups" or exclude in ("no others", "current row"):
        cells |= {"lo": ("min", "v"), "hi": ("max", "v")}
    got = frames.framed(df, cells, ["p"], order, units, start, end, exclude).where("p = 0").collect()
    want = Counter()
    for i in range(len(rows)):
        xs = [v for v in plain_frame(rows, i, units, start, end, exclude) if v is not None]
        cell = {"s": sum(xs) if xs else None, "n": len(xs), "m": round(sum(xs) / len(xs), 9) if xs else None, "lo": min(xs, default=None), "hi": max(xs, default=None)}
        want[(rows[i][0], rows[i][1], *[cell[c] for c in cells])] += 1
    assert Counter((r["k"], r["v"], *[round(r[c], 9) if c == "m" and r[c] is not None else r[c] for c in cells]) for r in got) == want


def test_frames_refuse(spark):
    df = spark.createDataFrame([(1, 1)], "p int, k int")
    with pytest.raises(ValueError):
        frames.framed(df, {"m": ("min", "k")}, ["p"], ["k"], "rows", -1, 1, "ties")
    with pytest.raises(ValueError):
        frames.framed(df, {"m": ("min", "k")}, ["p"], ["k"], "range")


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_frames_share_windows(spark):
    """Frames of one order share their shuffle and sorts; more rows are more tasks, not larger ones."""
    df = spark.range(5000).selectExpr("id % 50 AS p", "id % 7 AS k", "id AS v")
    asked = [({f"{f}_{i}": (f, "v") for f in ("sum", "count", "max")}, {"start": -1, "end": 1, "exclude": e}) for i, e in enumerate(frames.EXCLUDES)]
    got = frames.framed_all(df, asked, ["p"], ["k"], rows=500)
    assert sorts(got) <= 2 and got.rdd.getNumPartitions() == 10
    for (cells, options) in asked:
        one = frames.framed(df, cells, ["p"], ["k"], **options)
        assert sorted(map(tuple, got.select("p", "k", "v", *cells).collect())) == sorted(map(tuple, one.collect()))


@pytest.fixture(scope="module")
def many_items(spark, tmp_path_factory):
    """A lineitem table of two million rows, 40 of each part number."""
    folder = str(tmp_path_factory.mktemp("items"))
    rows = spark.range(2_000_000).selectExpr("id AS l_orderkey", "int(id % 7) AS l_linenumber", "id % 50000 AS l_partkey", "id % 1000 AS l_suppkey", "double(id % 977) AS l_extendedprice")
    rows.write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["frame_groups_spans", "frame_rows_exclude"])
def test_frames_of_many_rows_are_more_tasks(spark, many_items, name):
    """What a task sorts stays about ROWS, however many rows the table has."""
    got = analysis.QUERIES[name](spark, many_items)
    tasks = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*got.columns))).collect()
    assert sum(t["n"] for t in tasks) == 2_000_000 and max(t["n"] for t in tasks) < 1.2 * frames.ROWS


@pytest.mark.parametrize("exclude", frames.EXCLUDES)
def test_frames_of_floats(spark, exclude):
    """No sum is told from a larger one that has swallowed it."""
    values = [1e300, 1.0, None, 2.5, 0.25, 1e300, 3.0]
    df = spark.createDataFrame([(0, i // 3, v) for i, v in enumerate(values)], "p int, k int, v double")
    got = frames.framed(df, {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, ["p"], ["k"], "groups", 0, 1, exclude).collect()
    want = Counter()
    for i, v in enumerate(values):
        xs = [x for x in plain_frame([(j // 3, x) for j, x in enumerate(values)], i, "groups", 0, 1, exclude) if x is not None]
        want[i // 3, v, sum(xs) if xs else None, min(xs, default=None), max(xs, default=None)] += 1
    assert Counter(tuple(r)[1:] for r in got) == want


def test_frames_to_the_end_are_not_quadratic(spark):
    """One partition of 100,000 groups: a frame up to its end is run from there."""
    df = spark.range(100_000).selectExpr("0 AS p", "id AS k")
    began = time.time()
    got = frames.framed(df, {"n": ("count", "k"), "lo": ("min", "k")}, ["p"], ["k"], "groups", 1, None, "ties")
    assert got.where("n <> 99999 - k OR NOT lo <=> nullif(k + 1, 100000)").count() == 0
    assert time.time() - began < 60


def test_rows_frame_without_the_row_is_not_quadratic(spark):
    """One partition of 100,000 rows: the mean of all others is told from the whole."""
    df = spark.range(100_000).selectExpr("0 AS p", "id AS k")
    began = time.time()
    got = frames.framed(df, {"m": ("avg", "k"), "hi": ("max", "k")}, ["p"], ["k"], "rows", None, None, "current row")
    assert got.where("m <> (4999950000 - k) / 99999 OR hi <> if(k = 99999, 99998, 99999)").count() == 0
    assert time.time() - began < 60


@pytest.mark.parametrize("values", [[], [None], [5.0], [1.0, 2.0], [None, 3.0, 1.0, 3.0], [7.0] * 50, [1.0] * 30 + [2.0] * 31, [float(i % 7) for i in range(100)], [math.exp(i) for i in range(-40, 41)], [float("nan"), 1.0, 2.0]])
def test_median_by_rounds(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    real = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    for few in (1, 3, 1000):
        assert stats.exact_median(df, "v", few, 10) == (statistics.median(real) if real else None)
    if len(real) > 3:
        ranks = [0, 1, len(real) - 1]
        assert [str(v) for v in stats.at_ranks(df, "v", ranks, 2, 10)] == [str(real[r]) for r in ranks]


def test_edges_without_pairs(spark):
    rng = random.Random(4)
    base = 1_700_000_000
    rows = [(rng.choice([1, 2, None]), base + rng.randint(-3000, 3000), rng.choice(["a", "b", "c", None])) for _ in range(300)] + [(1, None, "a")]
    df = spark.createDataFrame(rows, "user_id int, s bigint, service string").select("user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "service")
    want = Counter()
    for u, t, a in rows:
        for v, s, b in rows:
            if u is not None and u == v and None not in (t, s, a, b) and a != b and 0 < s - t <= 600:
                want[a, b] += 1
    for size in (50_000, 20):
        assert {(r["source"], r["target"]): r["n"] for r in retrieval.service_edges(df, "10m", size).collect()} == dict(want)
    hot = spark.range(100_000).select(F.lit(1).alias("user_id"), F.timestamp_micros(F.col("id") + base * 1_000_000).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("service"))
    assert {(r["source"], r["target"]): r["n"] for r in retrieval.service_edges(hot, "1h").collect()} == {("a", "b"): 50_000 * 50_001 // 2, ("b", "a"): 50_000 * 49_999 // 2}


def test_causes_and_evidence(spark):
    at = lambda h, m: f"2024-01-0{1 + h // 24} {h % 24:02d}:{m:02d}:00"
    rows = [(at(h, m), "calm", f"calm {h}") for h in range(47) for m in (1, 20, 40)] + [(at(46, m), "storm", f"storm {m}") for m in range(30, 58)] + [(at(46, 59), "event", "the event")]
    df = spark.createDataFrame([(i, t, tid, x) for i, (t, tid, x) in enumerate(rows)], "id bigint, t string, template_id string, message string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r["template_id"]: r for r in retrieval.causes(df, "the event", "1h").collect()}
    assert got["storm"]["confident"] and got["storm"]["p_bound"] < 1e-6 and not got["calm"]["confident"]
    shown = retrieval.evidence(df, "the event", "1h", 2).collect()
    assert sorted((r["template_id"], r["rank"], r["message"]) for r in shown) == [("storm", 1, "storm 57"), ("storm", 2, "storm 56")]


def plain_events(lines):
    out, open_ = [], False
    for i, x in enumerate(lines):
        body = x[:-1].rstrip(" ") if x.endswith("\\") else x
        if i and (open_ or x[0] in " \t"):
            out[-1] += ("" if open_ else " ") + body.lstrip(" \t")
        else:
            out.append(body)
        open_ = x.endswith("\\")
    return out


@pytest.mark.parametrize("seed,limit,bits", [(1, "200b", 17), (2, "64b", 17), (3, "128m", 2), (4, "500b", 3), (5, "40b", 1)])
def test_events_over_many_splits(spark, tmp_path, seed, limit, bits, monkeypatch):
    """One file of many splits, with events that reach over several of them."""
    rng = random.Random(seed)
    lines = []
    for _ in range(60):
        lines.append(f"start {rng.randint(0, 99)}" + rng.choice(["", " \\"]))
        lines += [rng.choice(["  ", "\t", ""]) + "more" + rng.choice(["", "", "\\"]) for _ in range(rng.choice([0, 1, 30]))]
    (tmp_path / "a.log").write_text("\n".join(lines))
    (tmp_path / "b.log").write_text("  first line is indented\n\tand goes on\\\nto here")
    spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = reader.LogReader(spark, format="line").lines(str(tmp_path))
        got = [(r["file"][-5:], r["value"]) for r in reader.logical_lines(raw, bits).orderBy("file", "pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [v for f, v in got if f == "a.log"] == plain_events(lines)
    assert [v for f, v in got if f == "b.log"] == ["  first line is indented and goes onto here"]
