"""Kernels, cleaning, times and the dialect against plain Python."""

import itertools
import random
import re
from datetime import timedelta

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import clean, dialect, kernels, times
from cairn.functions.tables import new_path
from cairn.operators.folding import number_like

slow = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@given(st.lists(st.text(alphabet="ab, \t\n.éZ", max_size=12), min_size=1, max_size=20))
@slow
def test_kernels_match_python(spark, texts):
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.select("t", kernels.trim(t).alias("trim"), kernels.split(t, ".").alias("split"), kernels.find_char(t, "a").alias("find"), kernels.find_last(t, "a").alias("last"), kernels.count_char(t, "a").alias("count"), kernels.find_all_char(t, "a").alias("all"), kernels.to_lower(t).alias("lower"), kernels.replace_chars(t, "a,", "_").alias("rep")).collect()
    for r in got:
        x = r["t"]
        parts = x.split(".")
        assert r["trim"] == x.strip(" \t\n\v\f\r")
        assert r["split"] == (parts[:-1] if parts[-1] == "" else parts)
        assert r["find"] == (x.find("a") if "a" in x else None)
        assert r["last"] == (x.rfind("a") if "a" in x else None)
        assert r["count"] == x.count("a") and r["all"] == [i for i, c in enumerate(x) if c == "a"]
        assert r["lower"] == re.sub("[A-Z]", lambda m: m[0].lower(), x)
        assert r["rep"] == x.replace("a", "_").replace(",", "_")


def test_is_number_agrees_with_plain_rule(spark):
    tokens = ["".join(p) for n in range(1, 5) for p in itertools.product("01+-.a", repeat=n)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", kernels.is_number(F.col("t")).alias("n")).collect()
    assert [r["t"] for r in got if r["n"] != number_like(r["t"])] == []


def test_clean_modes(spark):
    df = spark.createDataFrame([("a,b;c|[d]  e",)], "value string")
    assert clean.clean_lines(df).first()["cleaned"] == "a b c d e"
    r = clean.clean_lines(df, mode="regex", delimiters=[r"\|"], replacements=[("[a-c]", "$X")]).first()
    assert r["cleaned"] == "$X,$X;$X [d]  e" and r["terms"] == {"$X": ["a", "b", "c"]}
    with pytest.raises(ValueError, match="bad pattern"):
        clean.clean_lines(df, mode="regex", delimiters=["("])


def test_timestamps(spark):
    df = spark.createDataFrame([("x 24/Mar/2024:10:15:30 y",), ("2024-03-24T10:15:30.5Z z",), ("none",), (None,)], "v string")
    got = [r[0] for r in df.select(times.format_time(clean.identify_timestamp(F.col("v")))).collect()]
    assert got == ["2024-03-24 10:15:30", "2024-03-24 10:15:30", None, None]
    assert times.interval("5m") == timedelta(minutes=5)
    with pytest.raises(ValueError):
        times.interval("5 parsecs")


def test_dialect_leaves_strings_alone():
    assert dialect.translate("SELECT 'arg_max(' AS x, arg_max(a, b) FROM t") == "SELECT 'arg_max(' AS x, max_by(a, b) FROM t"
    assert "INTERVAL 5 MINUTE" in dialect.translate("SELECT now() - INTERVAL '5m'")
    assert dialect.translate("SELECT 'a//b', 7 // 2") == "SELECT 'a//b', 7  div  2"


def test_json_path_and_fields(spark):
    df = spark.createDataFrame([('{"choices":[{"message":"hi"}]}',)], "j string")
    assert df.select(kernels.json_path(F.col("j"), "choices.0.message")).first()[0] == "hi"


def test_dialect_structure():
    assert dialect.java_format("%Y-W%m, %d o'clock") == "yyyy-'W'MM, dd 'o''clock'"
    with pytest.raises(ValueError):
        dialect.java_format("%Q")
    with pytest.raises(ValueError):
        dialect.translate("SELECT * FROM (SELECT 1 AS a UNION BY NAME SELECT 2 AS a) t")
    assert "UNION BY NAME" in dialect.translate("SELECT 'UNION BY NAME' AS a")
    assert dialect.translate("SELECT {'a': 1, b: x::INT}, '{c: 1}'") == "SELECT named_struct('a', 1, 'b', x::INT), '{c: 1}'"
    nested = dialect.translate("SELECT n FROM (SELECT a, count(*) AS n FROM t GROUP BY a QUALIFY n > 1) q")
    assert nested.count("__q") == 3 and nested.index("FROM (SELECT * EXCEPT (__q)") > 0


def test_union_by_name_keeps_order_and_fills(spark):
    spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").createOrReplaceTempView("ubn_l")
    spark.createDataFrame([("x", 1), ("z", 3)], "b string, a int").createOrReplaceTempView("ubn_r")
    every = dialect.execute(spark, "WITH l AS (SELECT * FROM ubn_l) SELECT * FROM l UNION ALL BY NAME SELECT *, 7 AS c FROM ubn_r ORDER BY a")
    got = [tuple(r) for r in every.collect()]
    assert [r[0] for r in got] == [1, 1, 2, 3] and set(got) == {(1, "x", None), (1, "x", 7), (2, "y", None), (3, "z", 7)}
    once = dialect.execute(spark, "SELECT * FROM ubn_l UNION BY NAME SELECT * FROM ubn_r")
    assert sorted(tuple(r) for r in once.collect()) == [(1, "x"), (2, "y"), (3, "z")]


def test_ties_of_arg_max(spark):
    """Ties go to the table's first row, as in DuckDB's scan by one thread; null values are left out."""
    rng = random.Random(8)
    rows = [(i % 5, rng.choice([None, *range(1000)]), rng.choice([None, 1.5, 2.5, float("nan")] if i % 5 else [None, 1.5, 2.5])) for i in rng.sample(range(2000), 2000)]
    spark.createDataFrame(rows, "g int, x int, y double").repartition(1).write.parquet(path := new_path(spark, "ties"))
    spark.read.parquet(path).createOrReplaceTempView("tied")
    one = duckdb.connect(config={"threads": 1})
    one.execute("CREATE TABLE tied (g INT, x INT, y DOUBLE)")
    one.executemany("INSERT INTO tied VALUES (?, ?, ?)", [tuple(r) for r in spark.read.parquet(path).collect()])
    for sql in (
        "SELECT g, arg_max(x, y) AS a, arg_min(x, y) AS b FROM tied GROUP BY g",
        "SELECT t.g, arg_max(t.x, t.y) FILTER (t.x > 500) AS a FROM tied AS t WHERE t.g > 0 GROUP BY t.g",
        "SELECT max(a) AS a, count(*) AS n FROM (SELECT g, arg_min(x + 1, coalesce(y, 0)) AS a FROM tied GROUP BY g) q",
        "SELECT arg_max(x, y) AS a, ') FROM arg_max(' AS s FROM tied",
    ):
        assert sorted(map(tuple, dialect.execute(spark, sql).collect())) == sorted(one.execute(sql).fetchall()), sql
