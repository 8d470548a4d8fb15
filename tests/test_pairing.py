"""Pairing by state with timers: as the batch has it, over restarts, and from what a batch left."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import correlate
from wardline.streaming import pairing

SSN = "ssn 123-45-6789"
EVENT = "session_id string, id string, seq long, tool string, text string, error string"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(pairing.STORE[0])
    pairing.enable(spark)
    yield spark
    spark.conf.set(pairing.STORE[0], before)


def events(spark, rows):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))
    return spark.createDataFrame(rows, EVENT).withColumn("ts", at)


def run(spark, path, name, **options):
    source = spark.readStream.schema(events(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    out = pairing.paired(source, **options).writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(240)
    return spark.read.schema(pairing.OUT).parquet(str(path / "out"))


def put(spark, path, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(str(path / "in"))


def test_stream_is_batch_over_restarts(rocks, tmp_path):
    rng, rows = random.Random(2), []
    for seq in range(240):
        key = (rng.choice("st"), rng.choice(["1", '"1"', "2"]))
        rows.append((*key, seq, f"t{seq}", None, None) if rng.random() < 0.5 else (*key, seq, None, SSN, "failed" if rng.random() < 0.2 else None))
    put(rocks, tmp_path, rows[:80])
    put(rocks, tmp_path, rows[80:160])
    run(rocks, tmp_path, "one", timeout_s=10_000)
    put(rocks, tmp_path, rows[160:])
    got = run(rocks, tmp_path, "two", timeout_s=10_000)
    all_ = events(rocks, rows)
    asked = all_.where("tool is not null").select("session_id", "id", "seq", "tool")
    want = correlate.correlated(asked, all_.where("tool is null").select("session_id", "id", "seq", "text", "error"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.where("code is not null").isEmpty() and got.where("tool is not null").count() > 40


def test_timers_and_a_batch_before(rocks, tmp_path):
    waiting = events(rocks, [("s", "7", 1, "before", None, None), ("s", "8", 2, "lost", None, None)])
    put(rocks, tmp_path, [("s", "7", 5, None, SSN, None), ("s", '"7"', 6, None, SSN, None), ("s", "9", 7, "asked", None, None), ("s", "9", 8, "again", None, None)])
    put(rocks, tmp_path, [("x", "1", 9_000, None, "late", None)])
    put(rocks, tmp_path, [("x", "2", 9_001, None, "later", None)])
    got = run(rocks, tmp_path, "three", delay="1 second", waiting=waiting)
    found = sorted((r.session_id, r.id, r.seq, r.tool or "", r.text or "", r.code or 0) for r in got.collect())
    assert found == sorted([("s", "7", 5, "before", "ssn [REDACTED-SSN]", 0), ("s", '"7"', 6, "", SSN, 0), ("s", "8", 2, "lost", "", -32000), ("s", "9", 8, "again", "", -32000), ("x", "1", 9_000, "", "late", 0), ("x", "2", 9_001, "", "later", 0)])
