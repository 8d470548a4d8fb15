"""The data source of frames: ranges of any size see the same frames, bad ones are set aside, streams equal batches."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from wardline.sources import framed, messages


def frame(body: bytes, header: bytes = b"Content-Length: %d\r\n\r\n") -> bytes:
    return header % len(body) + body


def cut(data: bytes, size: int):
    out = []
    for a in range(0, len(data), size):
        out += framed.frames(framed._Window(io.BytesIO(data), len(data)), a, min(a + size, len(data)))
    return out


def test_bad_frames_end_nothing():
    data = frame(b'{"a":1}') + b"X: y\r\n\r\n{}" + frame(b'{"b":2}', b"A: b\r\ncontent-LENGTH:%d\nC: d\n\n") + b"Content-Length: x\r\n\r\n{}" + b"Content-Length: 99999\r\n\r\n{}\n" + frame(b"{bad") + frame("{\"é\":[\n1]}".encode()) + b"Content-Length: 9\r\n\r\n{"
    got = cut(data, len(data))
    assert [(b.strip(), e) for _, b, e in got] == [
        ('{"a":1}', None), ("X: y\r\n\r\n{}", "no frame"), ('{"b":2}', None), ("Content-Length: x\r\n\r\n{}", "no frame"), ("{}", "wrong length"), ("{bad", "no JSON"), ('{"é":[\n1]}', None), ("{", "cut short"),
    ]
    assert cut(b"", 5) == [] and [e for *_, e in cut(b"\r\n \n", 9)] == [] and [e for *_, e in cut(b"junk", 9)] == ["no frame"]


def test_ranges_of_any_size_see_the_same_frames(monkeypatch):
    monkeypatch.setattr(framed, "STEP", 64)
    monkeypatch.setattr(framed, "LONGEST", 64)
    rng, data, want = random.Random(1), b"", []
    for k in range(300):
        body = json.dumps({"k": k, "t": "Content-Length: 5\r\n\r\n" * rng.randrange(3) + "é" * rng.randrange(80)}, ensure_ascii=k % 2 == 0, indent=k % 3 or None).encode()
        want.append(body.decode())
        data += frame(body, rng.choice([b"Content-Length: %d\r\n\r\n", b"content-length:%d\n\n", b"Content-Type: a/b\r\nContent-Length: %d\r\n\r\n"]))
    whole = cut(data, len(data))
    assert [b for _, b, _ in whole] == want and not any(e for *_, e in whole)
    for size in (1, 7, 50, 333, 4096):
        assert [b for _, b, _ in cut(data, size)] == want
    broken = b"junk one " + data[:2000] + b"  junk two X: y\r\n\r\n" + data[2000:4000] + b"Content-Length: 77777\r\n\r\n{" + data
    whole = cut(broken, len(broken))
    assert sum(e is not None for *_, e in whole) >= 3
    for size in (1, 7, 50, 333, 4096):
        assert cut(broken, size) == whole


def test_a_log_is_read_by_many_tasks(spark, tmp_path):
    framed.register(spark)
    docs = spark.range(5000).select(F.to_json(F.struct(F.col("id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("t"))).alias("body"))
    messages.write_framed(docs.coalesce(1), str(tmp_path / "log"))
    got = spark.read.format("frames").option("splitBytes", 20_000).load(str(tmp_path / "log"))
    assert got.rdd.getNumPartitions() > 10 and got.where("error is not null").isEmpty()
    assert got.select(F.trim("body", F.lit("\r\n")).alias("body")).exceptAll(docs).isEmpty() and got.count() == 5000
    assert messages.framed(spark, str(tmp_path / "log")).where("error is null").count() == 5000
    (tmp_path / "none").mkdir()
    assert spark.read.format("frames").load(str(tmp_path / "none")).isEmpty()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("frames").load(str(tmp_path / "nowhere")).collect()


def test_stream_is_batch(spark, tmp_path):
    """A log that grows between runs, in the middle of a frame too, and a second file: each frame once, after a restart as well."""
    framed.register(spark)
    logs, n = tmp_path / "logs", 0
    logs.mkdir()
    (logs / "_hidden").write_bytes(b"junk")

    def run():
        s = spark.readStream.format("frames").option("splitBytes", 100).load(str(logs)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        s.awaitTermination(120)
        return sorted(json.loads(r.body)["n"] for r in spark.read.schema(framed.SCHEMA).parquet(str(tmp_path / "out")).where("error is null").collect())

    def some(k):
        nonlocal n
        out = b""
        for _ in range(k):
            out += frame(json.dumps({"n": n, "t": "y" * (n % 40)}).encode())
            n += 1
        return out

    with open(logs / "a", "ab") as f:
        f.write(some(20))
        last = some(1)
        f.write(last[:-5])
    assert run() == list(range(20))
    with open(logs / "a", "ab") as f:
        f.write(last[-5:] + some(10))
    (logs / "b").write_bytes(some(15))
    assert run() == list(range(n)) and n == 46
    assert run() == list(range(n))


def test_reading_is_in_proportion():
    """Each byte is read about once, however many frames there are."""
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.taken += len(out)
            return out

    data = b"".join(b"Content-Length: %d\r\n\r\n%s\r\n" % (len(x) + 2, x) for k in range(60_000) for x in [b'{"id":%d,"method":"m"}' % k])
    w = framed._Window(Counted(data), len(data))
    assert sum(e is None for _, _, e in framed.frames(w, 0, len(data))) == 60_000 and Counted.taken < 2 * len(data)


def test_headers_far_apart():
    """A header is found wherever it stands, also across the borders of what is looked through."""
    frame = b"X-Y: z\r\nContent-Length: 2\r\n\r\n{}"
    for gap in (0, 1, framed.FIRST - 20, framed.FIRST, framed.FIRST + framed.LONGEST - 12, framed.STEP + framed.LONGEST - 7, framed.AHEAD - 9, framed.AHEAD + framed.STEP + 3):
        data = frame + b"\n" * gap + frame
        w = framed._Window(io.BytesIO(data), len(data))
        assert [x[0] for x in framed.frames(w, 0, len(data))] == [8, len(frame) + gap + 8], gap
