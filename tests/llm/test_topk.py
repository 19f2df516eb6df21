"""Top-k against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import topk


def brute(rows, every, k=5):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in vectors:
        if i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("size", [0, 1, 4, 300])
def test_equals_all_products(spark, size):
    rng = np.random.default_rng(size)
    base = rng.normal(size=(7, 40))
    rows = [(int(i), [float(x) for x in base[i % 7] + rng.normal(size=40) * rng.choice([0, 0.01, 1])]) for i in range(size)]
    rows += [(1000, None), (1010, [1.0, None]), (1020, [float("nan")] * 40), (1030, [float("inf")]), (None, [1.0]), (1040, []), (1050, [0.5, -0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(4)
    got = topk.top_k(topk.integers(df), F.col("vec_id") % 10 == 0, candidates_per_block=32, queries_per_block=8).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)


def test_large_components_keep_their_values(spark):
    """Components beyond 2^18, and products whose sums pass 2^63 on the way only."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 20), 1 << 20, 20)]) for i in range(40)]
    big = float(1 << 23)
    rows += [(100 + i, [big / 8 * (1 - 2 * (j % 4 // 2)) for j in range(19)] + [float(i)]) for i in range(8)]
    mixed = [(200, [big] * 4), (201, [big, big, -big, -big]), (202, [big, big, -big, 1 - big])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(topk.integers(df), F.col("vec_id") % 10 == 0, candidates_per_block=32, queries_per_block=8).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)
    got = topk.top_k(topk.integers(spark.createDataFrame(mixed, "vec_id long, embedding array<double>")), F.col("vec_id") == 200).collect()
    assert sorted(map(tuple, got)) == brute(mixed, 200)


def test_sums_beyond_64_bits_on_the_way():
    big = 1 << 31
    query = np.array([big] * 4)
    columns = np.array([[big, big], [big, big], [-big, -big], [-big, 1 - big]])
    at, scores = topk.search_exact(query, columns, np.zeros(2, bool), np.arange(2), 2)
    assert list(at) == [1, 0] and list(scores) == [big, 0]


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [0.25, 0.5]) for i in range(40)]
    got = topk.top_k(topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(0, i) for i in (1, 2, 3, 4, 5)] + [(20, i) for i in range(5)]


def test_prunes_columns():
    rng = np.random.default_rng(1)
    far = rng.integers(-5, 5, (64, 5000))
    near = rng.integers(80, 90, (64, 8))
    columns = np.hstack([far, near])
    at, scores = topk.search_block(near[:, 0], columns, topk._rest(columns, 16), np.zeros(5008, bool), np.arange(5008), 5)
    assert set(at) <= set(range(5000, 5008)) and list(scores) == sorted(near[:, 0] @ near, reverse=True)[:5]


def test_blocks_are_not_copied(spark):
    """Blocks of queries are neither copied for each block of candidates nor broadcast."""
    rows = [(i, [float(i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(topk.integers(df), F.col("vec_id") % 10 == 0, candidates_per_block=4, queries_per_block=2)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in text and "Broadcast" not in text and "Generate" not in text
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)
