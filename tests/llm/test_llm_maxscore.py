import math
import random

import pytest
from llm_cases import collected
from pyspark.sql import functions as F

from trailmarts.llm import maxscore


def brute(rows, is_query, k=5):
    use = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            t = [math.floor(256 * x) for x in v]
            use[i] = min(use.get(i, t), t)
    out = []
    for q in use:
        if is_query(q):
            scores = sorted(((-sum(a * b for a, b in zip(use[q], t)), c) for c, t in use.items() if c != q))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("dims,sparse", [(1, 0), (8, 0), (30, 0.8)])
@pytest.mark.parametrize("shard,block", [(8192, 2048), (7, 3)])
def test_top_k_is_exact(spark, dims, sparse, shard, block):
    rng = random.Random(dims)
    rows = [(i, [0.0 if rng.random() < sparse else rng.gauss(0, 0.4) for _ in range(dims)]) for i in range(120)]
    rows += [(i, list(rows[5][1])) for i in range(120, 150)]  # ties
    rows += [(200, None), (201, [None] * dims), (202, [float("nan")] * dims), (203, [float("inf")] * dims), (None, [0.1] * dims), (204, []), (205, [1.0]), rows[7], (300, [0.0] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "shard": F.lit(None).cast("int"), "terms": F.lit("t")}).repartition(4)
    exact = [(r.vec_id, r.embedding) for r in df.collect()]  # as stored in 32 bits
    found = maxscore.top_k(maxscore.integer_vectors(df), F.col("vec_id") % 3 == 0, 5, shard, block)
    assert collected(found) == brute(exact, lambda q: q % 3 == 0)


def test_large_components_and_few_candidates(spark):
    df = spark.createDataFrame([(0, [1e9, -2e6]), (50, [3.5e9, 1.0]), (7, [-1.0, 5e8])], "vec_id long, embedding array<double>")
    found = maxscore.top_k(maxscore.integer_vectors(df.withColumn("embedding", F.transform("embedding", lambda x: x / 1e4))), F.col("vec_id") % 50 == 0)
    assert collected(found) == brute([(0, [1e5, -2e2]), (50, [3.5e5, 1e-4]), (7, [-1e-4, 5e4])], lambda q: q % 50 == 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.top_k(maxscore.integer_vectors(df), F.col("vec_id") % 50 == 0).collect() == []
