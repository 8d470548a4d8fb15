"""Mixing: the splitting tree decides which shards draw which documents."""

from collections import Counter, defaultdict

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from wardline.llm import mixing


def test_trees_are_hypergeometric():
    """Splits are exact; over many trees, a shard's share has the mean and variance of a multivariate hypergeometric draw."""
    quotas, shards = np.array([40, 0, 10, 150]), 4
    drawn = []
    for seed in range(2000):
        out = mixing.split_quotas(quotas, shards, seed)
        assert (out.sum(0) == quotas).all() and (out.sum(1) == 50).all()
        drawn.append(out[2])
    p, n, total = quotas / 200, 50, 200
    assert np.allclose(np.mean(drawn, 0), n * p, atol=0.25)
    assert np.allclose(np.var(drawn, 0), n * p * (1 - p) * (total - n) / (total - 1), rtol=0.15)


def test_trees_of_any_size():
    source, shard, n = mixing.split(np.array([3, 0, 5]), np.array([0, 7, 1]))
    assert Counter(dict(zip(shard.tolist(), [0] * len(shard)))).keys() <= {1, 2} and n.sum() == 8 and (n > 0).all()
    assert [x.tolist() for x in mixing.split(np.zeros(3, int), np.zeros(2, int))] == [[], [], []]
    assert mixing.split_quotas(np.array([1]), 1).tolist() == [[1]]
    huge = np.array([3 * 10**9, 10**9, 7])
    out = mixing.split_quotas(huge, 3)
    assert (out.sum(0) == huge).all() and np.abs(out[:, 0] - 10**9).max() < 10**6


def _rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return d.unionByName(spark.createDataFrame([(9001, None, None), (9002, "a b", None)], "doc_id long, text string, source string"), allowMissingColumns=True)


def test_shards_draw_disjoint_blocks(spark, monkeypatch):
    """Each shard has as many blocks of a source as its tree says, and no draw is in two shards; bundles of sources change nothing of that."""
    d = _rows(spark).select("doc_id", "text", F.concat_ws("-", "source", F.col("doc_id") % 3).alias("source"))
    for bundle in (4096, 2):
        monkeypatch.setattr(mixing, "BUNDLE", bundle)
        out, n = mixing.allocate(d, shards=6)
        rows = out.withColumn("block", F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id"), F.lit(mixing.BLOCKS))).collect()
        assert n == 6 and len(rows) == d.count()
        blocks = defaultdict(set)
        for r in rows:
            blocks[r.source, r.block].add(tuple(r.shards))
        assert all(len(x) == 1 for x in blocks.values())  # a block is drawn whole
        per_shard, quota = Counter(), Counter()
        for (source, _), x in blocks.items():
            for k in next(iter(x)):
                assert 0 <= k < 6
                per_shard[k] += 1
                quota[source] += 1
        assert max(per_shard.values()) - min(per_shard.values()) <= 1
        mixed = mixing.mix(d, 6)
        assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: len(r.shards) for r in rows if r.shards})
        if bundle == 4096:
            again = {r.doc_id: r.shards for r in mixing.allocate(d.repartition(5), shards=6)[0].collect()}
            assert again == {r.doc_id: r.shards for r in rows}
            assert {r.doc_id: len(r.shards) for r in mixing.allocate(d, shards=3)[0].collect()} == {r.doc_id: len(r.shards) for r in rows}


def test_extra_columns_keep_their_names(spark):
    d = _rows(spark).select("doc_id", "text", "source", *[F.lit(k).alias(c) for k, c in enumerate(("size", "shards", "_copy", "_shard", "_order", "_block", "_source", "doc", "copy"))])
    got = mixing.mix(d, 2)
    assert got.columns == d.columns and {tuple(r[3:]) for r in got.collect()} == {tuple(range(9))}
    assert [c for c in mixing.allocate(d)[0].columns if c in d.columns] == [c for c in d.columns if c not in ("size", "shards")] + ["size", "shards"]
