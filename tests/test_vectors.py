"""Many-query search in blocks against plain numpy, and the offline embedder."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import vectors


@pytest.mark.parametrize("query_block,store_block", [(8192, 65536), (3, 7), (1, 100)])
def test_search_many_matches_numpy(spark, query_block, store_block):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (60, 4)).astype(float)  # few values, so that many scores tie
    x[7] = 0
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    got = vectors.search_many(store.where("id % 5 = 0"), store, 4, query_block, store_block).collect()
    want = set()
    unit = x / np.where(np.linalg.norm(x, axis=1) == 0, 1, np.linalg.norm(x, axis=1))[:, None]
    for q in range(0, 60, 5):
        if not x[q].any():
            continue
        s = np.round(unit @ unit[q], 9)
        order = sorted((i for i in range(60) if x[i].any()), key=lambda i: (-s[i], i))[:4]
        want |= {(q, i, s[i]) for i in order}
    assert {(r["query_id"], round(r["score"], 6)) for r in got} == {(q, round(v, 6)) for q, _, v in want}
    assert len(got) == len(want)


def test_embed_hash_counts_tokens_in_places(spark):
    texts = ["error user <*> a a a", "", "!!"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(vectors.embed_hash(F.col("t"), 8)).collect()]
    for t, row in zip(texts, got):
        want = [0.0] * 8
        for token in re.findall("[a-z0-9<*>]+", t):
            want[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 8] += 1
        assert row == want
