"""Cross-tokenizer alignment against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from wardline.llm import align, queries
from wardline.llm.bpe import byte_symbols

A, B = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a", "a  b\n c ", "x▁y", "▁", "<s> <0x41> <|endoftext|> </s>", "ﬁ Å Ⅳ é", "中文 字 ١٢٣", "😀😀 a\u0000b", "don't  won't\t\tI've\n\nyou'll", "z" * 3000, " lead", "trail  ", "a<|endoftext|>b", "é", "‍ 　x"]


def brute(rows):
    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    shown = {c: k for k, c in enumerate(byte_symbols())}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
        raw_a = [bytes(shown[c] for c in t.id_to_token(i)) for i in a]
        raw_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode()
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            docs.append((doc_id, [], [], [], ""))
            continue

        def ranges(raw):
            out, at = [], 0
            for r in raw:
                out.append((at, at + len(r)))
                at += len(r)
            return out

        ra, rb = ranges(raw_a), ranges(raw_b)
        links, j = [], 0
        for i, (x, y) in enumerate(ra):
            j = max(j - 3, 0)
            while j < len(rb) and rb[j][1] <= x:
                j += 1
            k = j
            while k < len(rb) and rb[k][0] < y:
                links.append((a[i], b[k]))
                k += 1
        counts.update(links)
        common, said, pa, pb = sorted({y for _, y in ra} & {y for _, y in rb}), [], 0, 0
        for end in common:
            ga, gb = [], []
            while pa < len(a) and ra[pa][1] <= end:
                ga.append(str(a[pa]))
                pa += 1
            while pb < len(b) and rb[pb][1] <= end:
                gb.append(str(b[pb]))
                pb += 1
            said.append(",".join(ga) + "|" + ",".join(gb))
        docs.append((doc_id, a, b, links, ";".join(said)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        ((d, len(a), len(b), s.count(";") + 1 if s else 0, len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l), hashlib.sha256(s.encode()).hexdigest() if s else "") for d, a, b, l, s in docs), key=str
    )


def texts(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "of", "tokenizer", "Überraschung", "naïve", "x=1;", "\n\n", "  ", "\t", "1234567", "日本語", "don't", "é", "🙂", "<s>", "▁", "aaaaaaaaaaaa", "<0x0A>"]
    return ODD + ["".join(rng.choice(words) + rng.choice([" ", "", " ", "  "]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pieces_by_segments_are_the_librarys():
    p, mine = align.PieceEncoder(B), [t for t in texts(2000) if t]
    assert not p.whole
    for _ in range(2):
        ids, sizes = p.encode(mine)
        want = p.library.encode(mine)
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_alignment_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK", 5000)  # several chunks
    rows = list(enumerate(texts(400))) + [(3, "again"), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = align.alignment(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment(none, A, B).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert sorted(map(tuple, align.alignment(blank, A, B).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    clash = spark.createDataFrame([(1, "a b", 9, "x", 7, 8)], "doc_id long, text string, chunk int, pair string, count int, place int")
    assert align.alignment(clash, A, B).drop("groups_sha256").first()[:5] == (1, 2, 2, 2, 2)


def test_special_strings_elsewhere_stay_special():
    """The aligner's encoder is its own: that of the id files still knows special tokens."""
    from wardline.llm.id_files import encoder

    align.aligner(A, B)
    assert encoder(A).encode(["<|endoftext|>"])[0].tolist() == [50256]
