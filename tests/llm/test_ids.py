"""Token ids: pre-tokens as the tokenizers library has them, and the coder's round trips."""

import random
import zlib

import numpy as np
import pytest

from wardline.llm import id_coder, id_files, queries

BYTE_BPE = queries.tokenizer("byte_bpe_50k.json")


def test_byte_encoder_as_the_library():
    bpe, rng = id_files.ByteEncoder(BYTE_BPE), random.Random(1)
    texts = ["", "'s", "'s's", "  's", "\n's", "'sa 'rea'lla 'r", "don't  won't\t\tI've\n\nyou'll", "  ", " \n a", "é1²½x", "x" * 100 + " y", "!" * 90, "中文 字 ١٢٣", "áb", "\x00\x1f\x85z\xa0q", "a<|endoftext|>b", "''s'd'm\"'s", "e f g 😀😀 😀"]
    texts += ["".join(rng.choice("'''  sstrevml dab1!\n\té中 ²") for _ in range(rng.randrange(60))) for _ in range(2000)]
    want = [[*bpe.library.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    for _ in range(2):  # the second time, ids are looked up
        ids, sizes = bpe.encode(texts, 7)
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_byte_encoder_in_windows(monkeypatch):
    monkeypatch.setattr(id_files, "SLICE", 50)
    bpe, rng = id_files.ByteEncoder(BYTE_BPE), random.Random(2)
    texts = ["".join(rng.choice("ab  c'1\n") for _ in range(rng.randrange(300))) for _ in range(100)] + ["y" * 500, ""]
    want = [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [bpe.encode([t])[0].tolist() for t in texts] == want
    parts = list(id_files.slices(texts))
    assert sum(parts, []) == texts and max(len("".join(p[:-1])) for p in parts) < 50
    bpe._clear()
    assert bpe.encode([])[0].tolist() == [] and bpe.encode(["", "a"])[1].tolist() == [0, 1]


def test_coder_round_trips():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 1 << 20, 30_000), np.full(9999, (1 << 20) - 1), rng.integers(0, 9, 50_000), np.arange(3, 400_000, 1023), rng.integers(0, 50_000, 2_100_000)):
        assert (id_coder.decode(id_coder.encode(ids)) == ids).all()
    for bad in (1 << 20, -1):
        with pytest.raises(ValueError):
            id_coder.encode(np.array([bad]))


def test_coder_predicts():
    """Frequent ids (order 0) and repeated pairs and triples (orders 1 and 2) cost less than an even code's 16 bits."""
    rng = np.random.default_rng(1)
    frequent = rng.choice(50_000, 300)[rng.integers(0, 300, 20_000) % rng.integers(1, 300, 20_000)]
    assert len(id_coder.encode(frequent)) < len(frequent) * 1.4
    assert len(id_coder.encode(np.tile(rng.integers(0, 50_000, 50), 400))) < 20_000 / 3


def test_blocks_are_independent(monkeypatch):
    rng = np.random.default_rng(2)
    rows = np.resize(rng.integers(0, 500, 3000), (9, 1000)).astype(np.int32)
    words = id_coder.encode_blocks(rows, 16)
    assert (id_coder.decode_blocks(words[4:5], 1000, 16) == rows[4:5]).all()
    monkeypatch.setattr(id_coder, "LANES", 2)
    ids = rng.integers(0, 99, id_coder.BLOCK * 5 + 1)
    assert (id_coder.decode(id_coder.encode(ids)) == ids).all()


def test_files_are_read_as_checked(spark):
    docs = spark.createDataFrame([(2, "b c"), (1, None), (1, None), (None, "x"), (3, "")], "doc_id long, text string")
    written = id_files.write(docs, BYTE_BPE)
    rows = [(r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in id_files.read(written).collect()]
    assert sorted(rows, key=str) == sorted(map(tuple, id_files.checked(written).collect()), key=str) and len(rows) == 5
    assert sorted(r[1] for r in rows) == np.cumsum([0, *(r[2] for r in sorted(rows, key=lambda r: (r[1], r[2])))])[:-1].tolist()
    assert id_files.read(id_files.write(docs.where("doc_id > 9"), BYTE_BPE)).count() == 0
