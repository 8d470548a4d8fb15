"""The operators against brute force, other libraries or exact round trips, and on empty, null, repeated and odd input."""

import datetime
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from wardline.llm import bpe, html_template, id_coder, id_files, katz, media, mixing, near_dup, queries, resample, topk, url_lists, webp

DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, size string, key string"
WORD_BPE, BYTE_BPE = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], DOC)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, an id twice with other texts, columns named as results."""
    rows = [(1, "a b c d e f", "en", "s", 3), (1, "a b c d e f", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "a b c d e f", "en", None, 1), (4, " \t\n", "", "", 0), (5, "x y " * 20_000, "en", "t", 9), (6, "x y " * 20_000, "en", "t", 9), (7, "İΣς é <|endoftext|> 中文 \x00\x1f  z", "de", "s", 1), (7, "other", "de", "s", 1)]
    return docs(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return docs(spark, [])


def sf(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# 1
def test_extraction_of_pages(spark):
    noise = "<header>H</header><nav><a href=x>m</a></nav><div class='cookie-notice'>c</div><aside>s</aside>{}<form>f<input></form><div id=comments><p>nice</p></div><footer>F</footer><script>if(a<b)'</p>'</script>"
    rows = [(k, f"http://h.example/{k}", f"<html><body>{noise.format(f'<div class=content><p>Text {k} of<b>page</b> &amp; more</p><p>second  {k}')}") for k in range(5)]
    rows += [(9, None, None), (10, "x", ""), (11, "http://o.example/", "<article>a<p>b&nbsp;c<foot")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_template.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert got[k][0] == f"Text {k} ofpage & more second {k}"
    assert got[9] == got[10] == ("", 0) and got[11][0] == "a b c"
    assert html_template.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_recurring_blocks_are_template(spark):
    rows = [(k, "http://h.example/", f"<body><div class=a><p>Read our terms.</p><p>Story {k} of its own</p></div>") for k in range(6)]
    got = html_template.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Story {k} of its own" for k in range(6)}


def test_copies_are_no_template(spark):
    def page(x):
        return f"<body><div class=a><p>Read our terms of use.</p><p>Story {x} begins</p><p>and story {x} goes on</p></div>"

    rows = [(k, "http://h.example/", page(max(k, 4))) for k in range(15)]  # five copies among fifteen pages
    rows += [(20 + k, "http://copies.example/", page("x")) for k in range(3)] + [(30 + k, "http://same.example/", f"<body><p>All alike</p><aside>{k}</aside>") for k in range(3)]
    got = {r.page_id: r.text for r in html_template.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Story {max(k, 4)} begins and story {max(k, 4)} goes on" for k in range(15))
    assert all(got[20 + k] == "Read our terms of use. Story x begins and story x goes on" and got[30 + k] == "All alike" for k in range(3))


def test_template_blocks_inside_article(spark):
    rows = [(k, "http://h.example/", f"<body><article><h1>Title {k}</h1><p>Story {k} of its own</p><p>To be continued</p><div class=x1>Pass it on to your friends</div></article><div class=y>Other {k}</div>") for k in range(6)]
    got = html_template.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Title {k} Story {k} of its own To be continued" for k in range(6)}


# 2
def brute_classes(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and (n := len(sets[a] & sets[b])) * 100 >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in sf(spark, "documents").collect()]
    base = [str(rng.randrange(500)) for _ in range(120)]
    for k in range(60):  # a crowd of near copies, with and without links
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(120)] = str(rng.random())
        rows.append((10_000 + k, " ".join(w)))
    rows += [(20_000, "one two"), (20_001, "ONE two"), (20_002, ""), (20_003, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(docs(spark, rows), 4).collect()}
    assert got == brute_classes(rows, 4, 80)


def test_crowds_branch_and_tile(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LEAF", 4)
    monkeypatch.setattr(near_dup, "DEPTH", 2)
    rng = random.Random(2)
    base = [str(k) for k in range(80)]
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(80)] = str(rng.random())
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(docs(spark, rows), 4).collect()}
    assert got == brute_classes(rows, 4, 80)


@pytest.mark.parametrize("root", [0, len(near_dup.ROOTS) - 1])
def test_large_nodes_of_every_tree_are_compared(spark, monkeypatch, root):
    monkeypatch.setattr(near_dup, "LEAF", 8)
    rng = random.Random(3)
    alike = [[rng.randrange(3) for _ in range(near_dup.COORDINATES)] for _ in range(60)]
    rows = [(2 * k + j, x) for k, x in enumerate(alike) for j in range(2)]  # pairs of equal sketches in one crowd
    own = spark.createDataFrame(rows, "rep long, sketch array<int>")
    nodes = own.selectExpr("1L AS node", f"{root} AS root", "rep", "rep AS comp")
    met = {}
    for r in near_dup._blocks(nodes, own).collect():
        met.setdefault(r.rep, set()).add(r.block)
    assert all(met.get(2 * k, set()) & met.get(2 * k + 1, set()) for k in range(60))


def test_near_duplicates_odd(spark, odd, none):
    got = near_dup.classes(odd).collect()
    assert len(got) == odd.count() and all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2, 3, 4, 5, 6)} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert near_dup.classes(none).count() == 0


def test_texts_of_null_and_repeated_ids_stay(spark, none):
    import corpus_pipeline as p

    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(None, a), (None, b), (None, b), (3, a), (7, a), (7, b), (7, b), (7, c), (8, None), (8, "")]
    got = Counter((r.doc_id, r.text) for r in p.near_duplicates(spark, docs(spark, rows), SF).collect())
    assert got == Counter([(None, a), (None, b), (None, b), (3, a), (7, b), (7, c), (8, None), (8, "")])
    assert p.near_duplicates(spark, none, SF).count() == 0


# 3
def test_bpe_is_the_librarys(spark, odd, none):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORD_BPE), bpe.WordEncoder(WORD_BPE)
    rng = random.Random(0)
    pool = "aAbB 'İΣσςéÉ́e ß1²Ⅷ٣\t\n\x1c\x85\xa0😀 the 'LL x<|endoftext|><|startoftext|><| .,!?-_中文ǅﬁ\x00"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(3000)] + [r.text for r in sf(spark, "documents").collect()]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids and own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False)
    got = bpe.digest(odd, WORD_BPE).collect()
    for r, x in zip(got, odd.collect(), strict=True):
        ids = library.encode(x.text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (x.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.digest(none, WORD_BPE).count() == 0
    assert bpe.encode_column(odd, WORD_BPE).columns == [c for c in odd.columns if c != "ids"] + ["ids", "decoded"]


# 4
def test_media_round_trip(spark, odd, none):
    got = media.digest(odd).collect()
    for r, x in zip(got, odd.collect(), strict=True):
        pay = media.padded((x.text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((x.text or "").encode()), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert media.digest(none).count() == 0


def test_plain_pictures_and_the_general_reader_agree():
    rng = np.random.default_rng(0)
    for samples in (np.zeros((1, 64)), rng.integers(0, 2, (3, 64)), rng.integers(0, 256, (9, 64)), np.minimum(rng.geometric(0.4, (128, 64)), 255)):
        data = webp.body(webp.write_gray(samples.astype(np.uint8)))[0]
        assert (webp.read_gray([data])[0] == samples).all() and (webp.read_pixels(data)[..., 2] == samples).all()


def simple(bits, symbols):
    bits.put(1, 1), bits.put(len(symbols) - 1, 1), bits.put(1, 1)
    for s in symbols:
        bits.put(s, 8)


def flat_image(bits, pixels, main=False):
    """ARGB pixels under 8-bit codes, without cache or groups."""
    bits.put(0, 1)
    if main:
        bits.put(0, 1)
    lengths = np.zeros(280, np.int64)
    lengths[:256] = 8
    for n in (280, 256, 256, 256):
        webp.put_code(bits, lengths[:n])
    simple(bits, [0])
    codes = webp.reversed_codes(lengths)
    for a, r, g, b in pixels:
        for v in (g, r, b, a):
            bits.put(int(codes[v]), 8)


def start(width, height):
    bits = webp.Bits()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        bits.put(v, n)
    return bits


def finish(bits):
    return bits.value.to_bytes((bits.size + 7) // 8 + 1, "little")


def test_every_transform_is_undone():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (8, 9, 4))
    for mode in range(14):  # predictor, by the definition applied forwards
        modes = np.full((2, 3), mode)
        rest = image.copy()
        for y in range(8):
            for x in range(9):
                rest[y, x] = (image[y, x] - webp.predict(webp.mode_at(modes, 2, y, x), *webp.neighbours(image, y, x))) & 255
        bits = start(9, 8)
        bits.put(1, 1), bits.put(0, 2), bits.put(0, 3)
        flat_image(bits, [(255, 0, mode, 0)] * 6)
        bits.put(0, 1)
        flat_image(bits, rest.reshape(-1, 4), True)
        assert (webp.read_pixels(finish(bits)) == image).all(), mode
    table = rng.integers(0, 256, (2, 3, 4))  # cross-colour, then subtract green
    to_red, to_blue, red_blue = webp.colour_deltas(table, 2, (8, 9))
    first = image.copy()
    first[..., 1], first[..., 3] = (image[..., 1] - image[..., 2]) & 255, (image[..., 3] - image[..., 2]) & 255
    rest, green = first.copy(), webp.signed(first[..., 2])
    rest[..., 1] = (first[..., 1] - (to_red * green >> 5)) & 255
    rest[..., 3] = (first[..., 3] - (to_blue * green >> 5) - (red_blue * webp.signed(first[..., 1]) >> 5)) & 255
    bits = start(9, 8)
    bits.put(1, 1), bits.put(2, 2)
    bits.put(1, 1), bits.put(1, 2), bits.put(0, 3)
    flat_image(bits, table.reshape(-1, 4))
    bits.put(0, 1)
    flat_image(bits, rest.reshape(-1, 4), True)
    assert (webp.read_pixels(finish(bits)) == image).all()
    palette = rng.integers(0, 256, (3, 4))  # palette: four pixels in one
    index = rng.integers(0, 3, (2, 9))
    packed = np.zeros((2, 3), np.int64)
    for x in range(9):
        packed[:, x // 4] |= index[:, x] << x % 4 * 2
    bits = start(9, 2)
    bits.put(1, 1), bits.put(3, 2), bits.put(2, 8)
    flat_image(bits, np.diff(palette, axis=0, prepend=0) & 255)
    bits.put(0, 1)
    flat_image(bits, [(255, 0, int(g), 0) for g in packed.ravel()], True)
    assert (webp.read_pixels(finish(bits)) == palette[index]).all()


def test_back_references_and_cache():
    bits = start(4, 4)
    bits.put(0, 1), bits.put(1, 1), bits.put(1, 4), bits.put(0, 1)  # no transform; a cache of 2; no groups
    lengths = np.zeros(282, np.int64)
    slot = (webp.CACHE_MULTIPLIER * 0xFF000700 & 0xFFFFFFFF) >> 31
    used = [7, 256 + 3, 280 + slot]
    lengths[used] = [1, 2, 2]
    webp.put_code(bits, lengths)
    for s in (0, 0, 255):
        simple(bits, [s])
    simple(bits, [1])  # distance code 2: one pixel to the left
    codes = webp.reversed_codes(lengths)
    bits.put(int(codes[7]), 1)
    bits.put(int(codes[280 + slot]), 2)
    for _ in range(3):
        bits.put(int(codes[259]), 2)  # four pixels
    bits.put(int(codes[7]), 1), bits.put(int(codes[7]), 1)
    data = finish(bits)
    assert (webp.read_pixels(data)[..., 2] == 7).all() and (webp.read_gray([data])[0] == 7).all()
    with pytest.raises(webp.Bad):
        webp.read_pixels(data[:12])
    with pytest.raises(webp.Bad):
        webp.body(b"RIFF")


# 5
def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = [rng.normal(size=8).tolist() for _ in range(400)] + [[0.5] * 8] * 200 + [None, [float("nan")] * 8, [None] * 8, [], [1.0] * 3]
    rows = [(k, v) for k, v in enumerate(x)] + [(7, x[7])]
    got = topk.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    whole = [(k, np.array([math.floor(256 * c) for c in v] + [0] * (8 - len(v)))) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for k in sorted({k for k, _ in whole if k % 50 == 0}):
        vec = next(v for i, v in whole if i == k)
        best = sorted(((-int(vec @ v), i) for i, v in whole if i != k))[:5]
        want += [(k, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)
    assert topk.digest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert topk.digest(spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<double>")).count() == 2


# 6
def water_fill(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        part = {s: left * w[s] / sum(w[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in part if part[s] > 2 * sizes[s]}
        if not over:
            return part | {s: 2.0 * sizes[s] for s in full}
        full |= over


def test_mixing(spark, odd, none):
    d = sf(spark, "documents").unionByName(docs(spark, [(9001, None, None, None), (9002, "a b", None, None)]), allowMissingColumns=True)
    got = mixing.digest(d).collect()
    of = {r.doc_id: r.source for r in d.collect()}
    sizes = Counter()
    for r in got:
        sizes[of[r.doc_id]] += r.size
    want, taken, largest = water_fill(sizes), Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[of[r.doc_id]] and abs(r.target - want[of[r.doc_id]]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[of[r.doc_id]] += r.taken
        largest[of[r.doc_id]] = max(largest[of[r.doc_id]], r.size)
    assert all(0 <= want[s] - taken[s] <= largest[s] + 1e-6 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.digest(d.repartition(7)).collect()))
    mixed = mixing.mix(d.select("doc_id", "text", "source"), 5)
    counted = Counter(r.doc_id for r in mixed.collect())
    assert all(counted[r.doc_id] == r.taken // r.size for r in got if r.size)
    assert mixing.digest(none).count() == 0 and mixing.digest(odd).count() == odd.count() and mixing.mix(odd).columns == odd.columns


def test_quotas_are_split_exactly():
    q = np.array([5, 0, 1000, 37])
    out = mixing.split_quotas(q, 7)
    assert (out.sum(0) == q).all() and out.sum(1).max() - out.sum(1).min() <= 3


# 7
@pytest.mark.parametrize("small", [False, True])
def test_katz(spark, small):
    rows = [(r.doc_id, r.text) for r in sf(spark, "documents").collect()] + [(5001, None), (5002, ""), (5001, None)]
    args = (100_000, 10_000) if small else ()
    got = katz.score(docs(spark, rows), *args).collect()
    uni, bi, of = Counter(), Counter(), Counter()
    token = {}
    for i, t in rows:
        token[i] = [*(t or "").encode().lower().split(), "end"]
        if zlib.crc32(str(i).encode()) % 10:
            pairs = list(zip(["begin", *token[i][:-1]], token[i], strict=True))
            uni.update(token[i]), bi.update(pairs), of.update(a for a, _ in pairs)
    n_of = lambda c: [Counter(c.values())[r] for r in range(1, katz.K + 2)]
    n, v, du, db = sum(uni.values()), len(uni), katz.discounts(n_of(uni)), katz.discounts(n_of(bi))
    unknown = sum((1 - du[r]) * r * n_of(uni)[r - 1] for r in range(1, katz.K + 1)) / n
    single = {w: (du[k] if k <= katz.K else 1) * k / n for w, k in uni.items()}
    free, share = defaultdict(float), defaultdict(float)
    for (a, w), k in bi.items():
        free[a] += (1 - db[k]) * k if k <= katz.K else 0
        share[a] += single[w]

    def p(a, w):
        k, by = bi[a, w], of[a] + (free[a] <= 0)
        if k:
            return (db[k] if k <= katz.K else 1) * k / by
        return single.get(w, unknown) * ((free[a] or 1) / by / (1 - share[a]) if of[a] else 1)

    assert abs(sum(p("begin", w) for w in [*uni, "unknown"]) - 1) < 1e-9
    for r in got:
        t = token[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in uni for w in t), n, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, w)) for a, w in zip(["begin", *t[:-1]], t, strict=True)), rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_odd(odd, none):
    assert katz.score(none).count() == 0 and all(math.isfinite(r.score) for r in katz.score(odd).collect())


# 8
def test_id_files(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    d = sf(spark, "documents").select("doc_id", "text").unionByName(odd.where("doc_id is not null").select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text").where("doc_id <> 100007"))
    got = sorted(map(tuple, id_files.digest(d, BYTE_BPE).collect()))
    at, want = 0, []
    for i, t in sorted((r.doc_id, r.text or "") for r in d.collect()):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert id_files.digest(none, BYTE_BPE).count() == 0 and id_files.digest(odd, BYTE_BPE).count() == odd.count()


def test_id_coder():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 2047, 2048, 2049, 5000):
        for top in (1, 3, 60_000):
            ids = rng.integers(0, top, n)
            assert (id_coder.decode(id_coder.encode(ids)) == ids).all()
    ids = np.tile(rng.integers(0, 50_000, 100), 40)
    data = bytearray(id_coder.encode(ids))
    assert len(data) < 3000
    data[-5] ^= 1
    with pytest.raises(ValueError):
        id_coder.decode(bytes(data))


# 9
def test_resampling_tells_good_from_bad(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality == 1 for r in labels.collect()}
    seen = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r.kept for r in resample.result(d, seen).collect()}
    test = [i for i in known if i % 2]
    good, bad = [got[i] for i in test if known[i]], [got[i] for i in test if not known[i]]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_resampling_as_brute_force(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    grams = {r.doc_id: Counter(resample.buckets(r.text).tolist()) for r in d.collect()}
    raw, target = (sum((c for i, c in grams.items() if i in ids), Counter()) for ids in (grams, good))
    for r in resample.select(d, labels).collect():
        c, own = grams[r.doc_id], r.doc_id in good
        rest = (target.total() - own * c.total()) / (raw.total() - c.total())
        want = sum(n * math.log((target[b] - own * n + resample.PRIOR) / ((raw[b] - n) * rest + resample.PRIOR)) for b, n in c.items())
        assert math.isclose(r.log_weight, want, rel_tol=1e-9, abs_tol=1e-6) and (r.good, r.n_grams) == (own, c.total())


def test_shapes():
    assert list(map(resample.shape, ["word", "Word", "WORD!!", "a1-b22", "é", "Ä", "don't", "中文"])) == ["a", "Aa", "A!", "a0-a0", "a", "A", "a'a", "a"]


def test_resampling_odd(spark, odd, none):
    label = "doc_id long, quality int, toxic int"
    no, some = spark.createDataFrame([], label), spark.createDataFrame([(1, 1, 0), (1, 1, None), (5, 0, 0), (None, 1, 0), (3, None, 1)], label)
    assert all(r.kept for r in resample.select(odd, no).collect()) and resample.select(none, some).count() == 0
    got = resample.select(odd, some).collect()
    assert len(got) == odd.count() and 0 < sum(r.kept for r in got) < len(got)
    assert len({r.kept for r in got if r.doc_id == 1}) == 1
    same = lambda rows: Counter((r.doc_id, r.n_grams, r.log_weight, r.kept) for r in rows)
    assert same(resample.result(odd, some).collect()) == same(got)


def test_kth_highest(spark):
    rng = random.Random(4)
    keys = [rng.choice([rng.random(), 0.25, 1e9 * rng.random(), -3.0]) for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "key double").cache()
    for k in (1, 2, 700, 1500, 3000):
        assert resample.kth_highest(df, k) == sorted(keys, reverse=True)[k - 1]


# 10
def test_url_lists_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    found = con.execute(queries.OP10_SQL)
    names = [x[0] for x in found.description]
    df = queries.op10_url_lists(spark, SF)
    assert sorted(map(repr, (tuple(r) for r in df.select(names).collect()))) == sorted(map(repr, found.fetchall()))


def test_url_lists_odd(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(n)
    captures = spark.createDataFrame([(1, "http://a.b.example/x/y", day(5), "q"), (1, "http://a.b.example/x/y", day(5), "q"), (2, None, day(5), "q"), (3, "no url", day(5), None), (4, "http://A.b.EXAMPLE", None, None), (5, "https://u@a.b.example:80/", day(10), ""), (6, "http://b.example/", day(500), "")], "page_id long, url string, fetched_at timestamp, verdict string")
    event = "list string, verdict string, key string, at timestamp, event string"
    events = spark.createDataFrame([("l", "block", "B.example", day(1), "add"), ("l", "block", "b.example", day(10), "remove"), ("l", "block", "b.example", day(400), "add"), ("m", "allow", "a.b.example/x", day(5), "add"), ("l", "block", None, day(1), "add"), ("l", "block", "z", None, "add")], event)
    got = Counter((r.page_id, r.verdict, r.n_entries, r.entry) for r in url_lists.judge(captures, events).collect())
    assert got == Counter({(1, "allow", 2, "a.b.example/x"): 2, (2, "none", 0, None): 1, (3, "none", 0, None): 1, (4, "none", 0, None): 1, (5, "none", 0, None): 1, (6, "block", 1, "b.example"): 1})
    assert url_lists.judge(captures, spark.createDataFrame([], event)).where("verdict <> 'none'").count() == 0
    assert url_lists.judge(captures.limit(0), events).count() == 0


# the pipeline
def test_pipeline(spark):
    import corpus_pipeline as p

    docs_, rows = sf(spark, "documents"), {}
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id for r in docs_.collect()}
        docs_ = stage(spark, docs_, SF).cache()
        rows[name] = docs_.collect()
        assert docs_.columns == sf(spark, "documents").columns and {r.doc_id for r in rows[name]} <= before
    assert max(Counter(r.doc_id for r in rows["near_duplicates"]).values()) == 1
    kept = {r.doc_id for r in rows["near_duplicates"]}
    assert kept == {i for i, (_, c) in brute_classes([(r.doc_id, r.text) for r in rows["quality"]], 5, 80).items() if i == c}
    assert Counter(r.doc_id for r in p.run(spark, SF).collect()) == Counter(r.doc_id for r in rows["mixture"])


def test_discounts():
    even = katz.discounts([1000, 400, 220, 140, 100, 75])  # regular: Good-Turing by its formula
    a = 6 * 75 / 1000
    assert even[1] == pytest.approx((2 * 400 / 1000 - a) / (1 - a)) and (0 < even[1:]).all() and (even[1:] < 1).all() and (np.diff(even[1:]) > 0).all()
    rough = katz.discounts([1000, 400, 220, 100, 140, 75])  # more fives than fours: from the line
    assert (0 < rough[1:]).all() and (rough[1:] < 1).all() and rough[4] != 3.5 / 4
    assert katz.discounts([5, 50, 80, 90, 95, 99]).tolist()[1:] == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9]
    assert katz.discounts([0] * 6).tolist()[1:] == katz.discounts([3, 0, 0, 0, 0, 0]).tolist()[1:] == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9]
