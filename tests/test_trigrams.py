"""Trigram postings against a scan of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import trigrams
from cairn.operators.search import like


def test_required_trigrams():
    assert trigrams.required("abcd") == ["abc", "bcd"]
    assert trigrams.required("ab%cd_ef") == [] and trigrams.required("a_bcd%xyz") == ["bcd", "xyz"]
    assert trigrams.required("a\\b%c") == ["a\\b"] and trigrams.required("") == []


@pytest.fixture(scope="module")
def logs(spark):
    rng = random.Random(7)
    words = ["disk", "full", "user", "in", "été", "100%", "a_b", "c:\\dir"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(4)) + f" part{i // 50}") for i in range(1000)] + [(1000, None), (1001, ""), (1002, "ab")]
    return spark.createDataFrame(rows, "id bigint, message string").withColumn("file", F.lit("clash"))


@pytest.mark.parametrize("hashes", [1 << 20, 7])
def test_same_rows_as_the_scan(logs, hashes):
    index = trigrams.TrigramIndex.build(logs, rows=40, hashes=hashes)
    for pattern in ["disk full", "part3", "part19", "d%sk", "d_sk f", "é", "été user", "100\\%", "c:\\d", "\\dir%part2", "zzz none", "", "%", "in", "ab", "part1_", "full%part7"]:
        want = sorted(tuple(r) for r in logs.where(like("message", pattern)).collect())
        assert sorted(tuple(r) for r in index.search(pattern).collect()) == want, pattern


def test_files_are_left_out(logs):
    index = trigrams.TrigramIndex.build(logs, rows=40)
    every = index.all_files()
    assert len(every) >= 1003 // 40
    assert 0 < len(index.files("part13")) <= 4 and index.files("zzz none") == [] and index.files("d_") == every
    plan = index.search("part13")._jdf.queryExecution().executedPlan().toString()
    assert "part-" in plan and len(index.search("part13").inputFiles()) <= 4


def test_empty_table(spark):
    index = trigrams.TrigramIndex.build(spark.createDataFrame([], "id bigint, message string"))
    assert index.search("abc").collect() == [] and index.search("").collect() == []
