"""Exact dedup by sorting against a dictionary, with groups over many ranges."""

import hashlib
import random
import re

from wardline.llm import content_sort

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t in rows]
    groups = {}
    for k, (x, row) in enumerate(zip(norm, rows, strict=True)):
        groups.setdefault(x, []).append((-len(row[1] or ""), row[0] is None, row[0] or 0, k))
    out = []
    for x, mine in groups.items():
        first = min(mine)
        out += [(rows[m[3]][0], rows[first[3]][0], len(mine), m == first, hashlib.sha256(x.encode()).hexdigest()) for m in mine]
    return sorted(out, key=str)


def test_groups_as_brute_force(spark):
    rng = random.Random(0)
    pool = ["", " ", "a", "a ", " a\t", "\x0b\x0ca", "a ", "日本 語", "日本語", "x" * 40, "x" * 40 + "y", "x" * 40 + " y", "x" * 40 + "z"]
    rows = [(k, rng.choice(pool)) for k in range(900)] + [(k, None) for k in range(900, 910)] + [(None, "a"), (None, "alone"), (None, "alone"), (5, "twice"), (5, "twice")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = content_sort.groups(docs)
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_a_group_over_all_ranges(spark, monkeypatch):
    monkeypatch.setattr(content_sort, "partitions", lambda s: 16)
    rows = [(k, "the same text") for k in range(3000)] + [(k, f"own {k}") for k in range(3000, 3300)] + [(7000, "the  same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, content_sort.groups(docs).collect()), key=str)
    assert got == brute(rows) and sum(r[3] for r in got) == 301


def test_texts_of_one_hash_are_compared(spark, monkeypatch):
    """Where prefix and hash say nothing, texts still do: in a range and over ranges."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(content_sort, "PREFIX", 0)
    monkeypatch.setattr(content_sort.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    rows = [(k, "abcde"[k % 5] * (1 + k % 2)) for k in range(400)]
    got = content_sort.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_odd_tables(spark):
    assert content_sort.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([("b", "x", 1, 2, 3), ("a", "x ", 1, 2, 3)], "doc_id string, text string, n int, part int, norm int")
    assert [r[:4] for r in sorted(map(tuple, content_sort.groups(clash).collect()))] == [("a", "a", 2, True), ("b", "a", 2, False)]
    long = spark.createDataFrame([(1, "w " * 300_000), (2, "w" * 300_000)], "doc_id long, text string")
    assert [r[:4] for r in sorted(map(tuple, content_sort.groups(long).collect()))] == [(1, 1, 2, True), (2, 1, 2, False)]
