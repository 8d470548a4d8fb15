"""Top-k: exact on clustered vectors, of which few annuli are visited, and on odd tables."""

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import topk


def brute(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = []
    for i in sorted({i for i in ids if i % 50 == 0}):
        score = x @ x[np.flatnonzero(ids == i)[0]]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out += [(int(i), n + 1, int(ids[j]), int(score[j])) for n, j in enumerate(order)]
    return out


def test_clustered_vectors_are_pruned(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 400
    rows = [(i, np.floor(centres[i % 20] + rng.normal(size=16) * 10).tolist()) for i in range(3000)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumn("query_id", F.lit(1))
    monkeypatch.setattr(topk, "BLOCK", 100)  # several blocks and groups
    asked = v.where("vec_id % 50 = 0")
    assert sorted(map(tuple, topk.top_k(v, asked).collect())) == brute(rows, 5)
    assert 0 < topk.visited_share(v, asked) < 0.3
    assert topk.visited_share(v, asked.limit(0)) == 0


def test_independent_vectors_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 64))
    rows = [(i, np.floor(256 * r / np.linalg.norm(r)).tolist()) for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    assert sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0")).collect())) == brute(rows, 5)
    assert topk.visited_share(v, v.where("vec_id % 50 = 0")) > 0.9


def test_extra_and_clashing_columns(spark):
    rows = [(i, [float(i % 7), 1.0 - i], 9, 9, 9) for i in range(120)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank int, v int")
    got = topk.digest(e)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 15
