"""The writer's choices: each makes its pictures shorter, and the readers undo it."""

import heapq
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import media, webp

rng = np.random.default_rng(5)
TEXT = np.frombuffer(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"], 3000)).encode(), np.uint8)
WORDS = rng.integers(97, 123, 3000).astype(np.uint8)
REPEATED = np.concatenate([WORDS[:1500], WORDS[200:1200], WORDS[1500:2500], WORDS[:1600]])[: 64 * 70].reshape(-1, 64)


def plain(samples):
    bits = webp.begun(samples.shape[1], len(samples))
    bits.put(0, 1)
    return webp.put_image(bits, samples.ravel(), samples.shape[1], 255, [])


@pytest.mark.parametrize(("samples", "transforms"), [
    (REPEATED, 0),
    (np.tile(np.arange(0, 250, 2, dtype=np.uint8), 64 * 4)[: 64 * 100].reshape(-1, 64), 0),
    ((rng.random((128, 64)) < 0.05).astype(np.uint8) * 200 + 7, 7),
    (rng.choice(4, (50, 64), p=[0.85, 0.05, 0.05, 0.05]).astype(np.uint8) * 3, 7),
    ((np.cumsum(rng.random((128, 64)) < 0.05, 0) * 7 + rng.integers(0, 256, 64)).astype(np.uint8), 1),
])
def test_special_pictures_are_shorter(samples, transforms):
    file = webp.write_gray(samples)
    data = webp.body(file)[0]
    assert len(file) < len(webp.riff(plain(samples))) and webp.special(data) and data[5] & 7 == transforms
    assert (webp.read_gray([data, plain(samples)])[0] == samples).all() and (webp.read_pixels(plain(samples))[..., 2] == samples).all()
    image = webp.read_pixels(data)
    assert (image[..., 0] == 255).all() and not image[..., [1, 3]].any()
    with pytest.raises(webp.Bad):
        webp.read_pixels(data[: len(data) // 2])


def test_plain_pictures_stay_plain():
    samples = rng.integers(0, 256, (64, 64)).astype(np.uint8)
    assert not webp.special(webp.body(webp.write_gray(samples))[0])


def test_repeats_are_repeats():
    for flat in (TEXT[:8192], REPEATED.ravel(), np.zeros(9000, np.uint8), np.zeros(3, np.uint8)):
        end = 0
        for at, back, n in webp.repeats(flat):
            assert at >= end and 0 < back <= at and 0 < n <= webp.COPY
            assert all(flat[at + k] == flat[at + k - back] for k in range(n))
            end = at + n


def test_both_readers_of_one_channel(monkeypatch):
    """The reader for one channel and the general one give the same."""
    datas = [webp.body(webp.write_gray(x))[0] for x in (REPEATED, TEXT[:8192].reshape(-1, 64), np.zeros((128, 64), np.uint8))]
    quick = [webp.read_pixels(d) for d in datas]
    monkeypatch.setattr(webp, "one_channel", lambda *_: None)
    assert all((webp.read_pixels(d) == q).all() for d, q in zip(datas, quick, strict=True))


def test_prefixed_numbers():
    x = np.arange(1, 9000)
    prefix, bits, n = webp.prefixed(x)
    for v, p, b, k in zip(x.tolist(), prefix.tolist(), bits.tolist(), n.tolist(), strict=True):
        reader = webp.Reader(b.to_bytes(4, "little"))
        assert webp.take_number(reader, p) == v and reader.at == k


def test_counts_and_clashing_names(spark):
    rows = [(1, "ab cd " * 4000), (2, None), (3, bytes(rng.integers(97, 123, 9000).astype(np.uint8)).decode()), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_pictures, r.n_special) for r in media.digest(d).collect())
    assert [g[:3] for g in got] == [(1, 24000, 3), (2, 0, 1), (3, 0, 1), (3, 9000, 2)] and got[0][3] == 3
    odd = d.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"), *[F.lit("x").alias(c) for c in ("media", "feature", "n_pictures", "n_special")])
    back = media.read(media.store(odd))
    assert back.columns == ["doc_id", "media", "payload", "feature", "n_pictures", "n_special"]
    assert {r.doc_id: hashlib.md5(r.payload).hexdigest() for r in back.where("doc_id < 3").collect()} == {i: hashlib.md5(media.padded((t or "").encode())).hexdigest() for i, t in rows[:2]}
    assert media.read(d.select(F.lit(None).cast("binary").alias("media"))).select("payload", "n_special").distinct().collect() == [(None, None)]


def test_codes_by_two_queues():
    """The code lengths of a heap, whose ties go to what was there first; codes as they are counted up; one parse of a plain picture tells that it is plain."""
    rng = np.random.default_rng(3)
    for n in (2, 3, 17, 280):
        counts = rng.integers(0, 5, n) * rng.integers(1, 50, n)
        counts[:2] += 1
        heap = [(int(w), k, [k]) for k, w in enumerate(counts) if w]
        want, new = np.zeros(n, int), n
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            want[a[2] + b[2]] += 1
            heapq.heappush(heap, (a[0] + b[0], new, a[2] + b[2]))
            new += 1
        got = webp.code_lengths(counts, webp.LEFT)
        assert want.max() <= webp.LEFT and got.tolist() == want.tolist()
        code, codes = 0, np.zeros(n, int)
        for size in range(1, webp.LEFT + 1):
            code <<= 1
            for s in np.flatnonzero(got == size):
                codes[s], code = int(f"{code:0{size}b}"[::-1], 2), code + 1
        assert webp.reversed_codes(got).tolist() == codes.tolist()
    plain, told = [], [rng.integers(0, 256, 640, np.uint8).tobytes(), b"ab" * 320, b"0" * 64]
    files = [x for t in told for x in webp.pictures(webp.write_payload(t))]
    assert b"".join(x.tobytes() for x in webp.read_gray(files, plain)) == b"".join(told)
    assert [not p for p in plain] == [webp.special(f) for f in files] and len(set(plain)) == 2
