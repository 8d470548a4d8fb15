"""Codebooks by filtering trees against Lloyd rounds without trees."""

import hashlib

import numpy as np
import pytest

from wardline.llm import codebooks


def brute(rows):
    kept = [(i, np.floor(np.array(x, np.float64) * 1024).astype(np.int64), l) for i, x, l in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    x = np.array([k[1] for k in kept])
    at = codebooks.cuts(x.shape[1])
    first = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], x[k].tolist()))[:256]
    codes, error, entries = np.zeros((len(x), 4), int), np.zeros(len(x), np.int64), []
    for p in range(4):
        part = x[:, at[p] : at[p + 1]]
        book = part[first].copy()
        for r in range(5):
            far = ((part[:, None] - book[None]) ** 2).sum(2)
            mine = far.argmin(1)
            if r < 4:
                for e in set(mine.tolist()):
                    book[e] = part[mine == e].sum(0) // (mine == e).sum()
        codes[:, p] = mine
        error += far.min(1)
        entries += book.ravel().tolist()
    said = hashlib.sha256(",".join(map(str, entries)).encode()).hexdigest()
    by = {}
    for (_, _, l), e in zip(kept, error, strict=True):
        by[l] = by.get(l, 0) + int(e)
    return sorted(((k[0], "".join(f"{c:02x}" for c in row), int(e), by[k[2]], said) for k, row, e in zip(kept, codes, error, strict=True)), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, width=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * 0.05).astype(np.float32)
    return [(k, r.tolist(), [None, 1, 2][k % 3]) for k, r in enumerate(x)]


def test_codes_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK", 500)
    rows = vectors(1500) + [(9001, None, 1), (9002, [1.0] * 15 + [None], 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] * 16, 2)]
    rows += [(5, [0.25] * 16, 1), (5, [0.25] * 16, 1), (None, [0.5] * 16, None)] + [(3000 + k, [0.125] * 16, 3) for k in range(700)]  # repeated ids and one common vector
    got = codebooks.digest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_ties_and_wide_labels(spark, monkeypatch):
    """Vectors of a small grid: many equal distances and equal entries. Labels are joined by shuffling."""
    monkeypatch.setattr(codebooks, "FEW", 0)
    rng = np.random.default_rng(1)
    rows = [(k, (rng.integers(-2, 3, 8) / 1024).tolist(), k % 2) for k in range(2000)]
    got = codebooks.digest(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_few_vectors(spark):
    rows = [(k, [k / 10, 0.0, -k / 7, 1.0, 2.0], 1) for k in range(20)]  # fewer than entries, parts of unequal width
    assert sorted(map(tuple, codebooks.digest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    for none in ([], [(1, None, 1)], [(1, [], 1)]):
        assert codebooks.digest(spark.createDataFrame(none, SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, [0.5] * 8, None, 1, 2)], SCHEMA + ", error int, trees int")
    assert [r[:4] for r in codebooks.digest(clash).collect()] == [(1, "00000000", 0, 0)]
    with pytest.raises(Exception, match="beyond"):
        codebooks.digest(spark.createDataFrame([(1, [1e9] * 8, 1)], SCHEMA)).count()
    with pytest.raises(Exception, match="beyond"):
        codebooks.digest(spark.createDataFrame([(1, [0.5] * 8, 1), (2, [1e9] * 8, 1)], SCHEMA)).count()


def test_trees_assign_whole_nodes():
    rng = np.random.default_rng(2)
    centres = rng.integers(-5000, 5000, (10, 8))
    x = centres[rng.integers(0, 10, 8000)] + rng.integers(-20, 20, (8000, 8))
    t = codebooks.tree(x)
    book = np.vstack([centres, centres + 3000])
    codes, sums, counts, alone = codebooks.assign(t, book)
    want = ((t["points"][:, None].astype(int) - book[None]) ** 2).sum(2).argmin(1)
    assert (codes == want).all() and alone < 800
    assert (counts == np.bincount(want, minlength=20)).all() and (sums == [t["points"][want == e].sum(0) for e in range(20)]).all()
    far = t["points"].astype(np.int64) * 10_000  # beyond doubles: whole numbers of 64 bits
    big = codebooks.tree(far)
    assert (codebooks.assign(big, book * 10_000)[0] == ((big["points"][:, None].astype(int) - book[None] * 10_000) ** 2).sum(2).argmin(1)).all()
