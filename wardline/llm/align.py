"""Alignment of two tokenizers over the same texts: groups of tokens between common ends, links of overlapping tokens, and how often ids are linked.

The tokens' byte ranges are intervals. Those of tokenizer B lie in a static index, sorted arrays of starts and ends, since they don't overlap
each other; each token of A asks it by bisection for the run of B tokens that it overlaps. Gaps between B tokens that no A token spans are
the groups' boundaries. Many documents are worked on at once, one behind the other, in arrays.

A task puts about ``CHUNK`` code points of documents into a chunk and counts each pair of ids once a chunk: what is shuffled is (chunk, pair),
not links. Counts of pairs come together by pair; each chunk then gets the counts of its own pairs back, and its documents their sums.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import cut, setting
from .id_files import ByteEncoder, slices

CHUNK = 2_000_000
#: Segments that a worker keeps with their ids, and code points of them; then it starts anew. Longer segments are not kept.
KEPT, KEPT_CHARS, LONGEST = 250_000, 5_000_000, 64
#: Pre-tokens of A that a worker keeps; then it starts anew.
KEPT_A = 800_000
#: Rows that go to a worker at a time.
ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
#: A pair of ids as one number.
SHIFT = 32
BLANK = "▁"


class PieceEncoder:
    """The sentencepiece library's ids, asked once for each distinct segment: a run of spaces and what follows it.

    That is exact where no piece has a space behind anything else (checked), since merges then never cross a segment's end. Texts
    with the character that pieces write for a space go to the library whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.whole = any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.cut = re.compile(" *[^ ]+| +")
        self.blank = self.library.piece_to_id(BLANK)
        self._clear()

    def _clear(self) -> None:
        """Segments by number, and for each number where its ids start in the pool, and how many they are."""
        self.known, self.chars, self.pool, self.ends = {}, 0, array("i"), array("i", [0])

    def _learn(self, segments: list[str]) -> None:
        """The library's ids of new segments, each asked for without the space that the library adds; a single space is that space alone."""
        got = self.library.encode([s[1:] for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            if s == " ":
                got[k] = [self.blank]
        n = len(self.ends) - 1
        self.known.update(zip(segments, range(n, n + len(segments)), strict=True))
        self.ends.extend((np.cumsum(np.fromiter(map(len, got), np.int64, len(got))) + len(self.pool)).tolist())
        self.pool.extend(chain.from_iterable(got))
        self.chars += sum(map(len, segments))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none is empty) one after the other, and how many are each text's."""
        if len(self.ends) > KEPT or self.chars > KEPT_CHARS:
            self._clear()
        odd = {k for k, t in enumerate(texts) if self.whole or BLANK in t}
        parts = [[] if k in odd else self.cut.findall(" " + t) for k, t in enumerate(texts)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = list(chain.from_iterable(parts))
        new = list(set(flat).difference(self.known))
        self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        for s in new:
            if len(s) > LONGEST:
                del self.known[s]
        ends = np.array(self.ends, np.int64)
        each = (ends[1:] - ends[:-1])[at]
        sums = np.cumsum(each)
        ids = np.array(self.pool, np.int64)[np.repeat(ends[at] - (sums - each), each) + np.arange(sums[-1] if len(sums) else 0)]
        sizes = np.diff(np.concatenate([[0], sums])[np.concatenate([[0], np.cumsum(sizes)])])
        if odd:
            each = np.split(ids, np.cumsum(sizes)[:-1])
            for k in odd:
                each[k] = np.array(self.library.encode(texts[k]), np.int64)
                sizes[k] = len(each[k])
            ids = np.concatenate(each)
        return ids, sizes


class SmallEncoder(ByteEncoder):
    """With a table for ``KEPT_A`` pre-tokens, since a worker holds another vocabulary besides."""

    BITS = 21

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        if self.known > KEPT_A:
            self._clear()
        return super().encode(texts, end)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SmallEncoder(path_a), PieceEncoder(path_b)
        plain = {c: bytes([k]) for k, c in enumerate(byte_symbols())}
        vocab = self.a.library.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.bytes_a[i] = b"".join(plain.get(c, c.encode()) for c in s)
        self.a.library.encode_special_tokens = True
        self.a.special = []  # their strings are ordinary text
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.b.bytes))
        n, m = len(self.size_a), len(self.size_b)
        self.said = [b"%d%s" % (i, end) for k, ends in ((n, (b",", b"|")), (m, (b",", b";"))) for end in ends for i in range(k)]
        self.at = (0, n, 2 * n, 2 * n + m)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of A, how many a text, and B's; texts that are empty, or that either's tokens don't give back, have none."""
        wanted = [k for k, t in enumerate(texts) if t]
        mine = [texts[k] for k in wanted]
        spaced = [" " + t for t in mine]
        ids_a, n_a = self.a.encode(spaced)
        ids_a = ids_a.astype(np.int64)
        ids_b, n_b = self.b.encode(mine)
        raw = [t.encode("utf-8", "surrogatepass") for t in spaced]

        def same(ids, n, table):
            got, out = map(table.__getitem__, ids.tolist()), []
            for text, size in zip(raw, n.tolist(), strict=True):
                out.append(b"".join(islice(got, size)) == text)
            return np.array(out, bool)

        fine = same(ids_a, n_a, self.bytes_a) & same(ids_b, n_b, self.b.bytes)
        sizes = np.zeros((2, len(texts)), np.int64)
        place = np.array(wanted, np.int64)[fine]
        sizes[0, place], sizes[1, place] = n_a[fine], n_b[fine]
        return ids_a[np.repeat(fine, n_a)], sizes[0], ids_b[np.repeat(fine, n_b)], sizes[1]

    def align(self, texts: list[str]):
        """n_a, n_b, n_groups, n_links and the groups' hash of each text, and the pairs of all links, text by text."""
        a, n_a, b, n_b = self.tokens(texts)
        docs_a, docs_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        starts_a, starts_b = ends_a - self.size_a[a], ends_b - self.size_b[b]
        first = np.searchsorted(ends_b, starts_a, "right")
        last = np.searchsorted(starts_b, ends_a, "left")
        each = last - first
        linked_a = np.repeat(np.arange(len(a)), each)
        linked_b = np.arange(len(linked_a)) + np.repeat(first - (np.cumsum(each) - each), each)
        spanned = np.zeros(len(b) + 1, np.int64)  # at each B token the gap behind it
        several = each > 1
        np.add.at(spanned, first[several], 1)
        np.add.at(spanned, last[several] - 1, -1)
        closes_b = np.cumsum(spanned)[: len(b)] == 0
        group_b = np.cumsum(closes_b) - closes_b
        group_a = group_b[first]
        closes_a = np.ones(len(a), bool)
        closes_a[:-1] = group_a[1:] != group_a[:-1]
        before = np.concatenate([[0], np.flatnonzero(closes_b) + 1])  # B tokens before each group
        through = np.flatnonzero(closes_a) + 1  # A tokens up to each group's end
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + before[group_a]] = np.where(closes_a, self.at[1], self.at[0]) + a
        codes[np.arange(len(b)) + through[group_b]] = np.where(closes_b, self.at[3], self.at[2]) + b
        said = list(map(self.said.__getitem__, codes.tolist()))
        ends = (docs_a + docs_b).tolist()
        hashes = [hashlib.sha256(b"".join(said[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:], strict=False)]
        groups = np.diff(np.concatenate([[0], np.cumsum(closes_b)])[docs_b])
        links = np.diff(np.concatenate([[0], np.cumsum(each)])[docs_a])
        return n_a, n_b, groups, links, hashes, a[linked_a] << SHIFT | b[linked_b]


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The written chunks of ``docs``: chunk, of each document its id, numbers and groups' hash, the distinct pairs with how many links of the
    chunk have them, and for each link the place of its pair among these (data)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        both, part, n, size, held = aligner(path_a, path_b), TaskContext.get().partitionId(), 0, 0, []

        def row():
            pairs, place, counts = np.unique(np.concatenate([h[-1] for h in held]), return_inverse=True, return_counts=True)
            data = pa.Codec("zstd").compress(place.astype("<i4").tobytes(), asbytes=True)
            lists = [pa.concat_arrays([h[0] for h in held]), *(pa.array(np.concatenate([h[1 + k] for h in held])) for k in range(4)), pa.array(list(chain.from_iterable(h[5] for h in held)), pa.string())]
            found = [*lists, pa.array(pairs), pa.array(counts.astype(np.int64))]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in found), pa.array([data], pa.binary())],
                names=["chunk", "doc_ids", *NUMBERS, "hashes", "pairs", "counts", "data"],
            )

        for batch in batches:
            at = 0
            for texts in slices([t or "" for t in batch.column(1).to_pylist()]):
                held.append((batch.column(0).slice(at, len(texts)), *both.align(texts)))
                at += len(texts)
                size += sum(map(len, texts))
                if size >= CHUNK:
                    yield row()
                    n, size = n + 1, 0
        if held:
            yield row()

    schema = f"chunk long, doc_ids array<{id_type}>, {', '.join(f'{n} array<long>' for n in NUMBERS)}, hashes array<string>, pairs array<long>, counts array<long>, data binary"
    with setting(docs.sparkSession, *ROWS):
        return cut(docs.select("doc_id", "text").mapInArrow(run, schema))


def counted(made: DataFrame) -> DataFrame:
    """pair, count (links of all chunks that have it) and best: whether no pair with the same B id has more. By B id there is one number, so that
    these numbers are as small as B's vocabulary."""
    pairs = cut(made.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count")))
    b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = pairs.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return pairs.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text).

    ``path_a``: a byte-level vocabulary of the tokenizers library, which reads space and text; ``path_b``: a sentencepiece model, which adds the
    space. Null and empty texts, and those that either's tokens don't give back, have no tokens: zeros, and an empty hash. Rows of one
    id are documents each, and all count; an empty table has no rows. Other columns are left out.
    """
    made = chunks(docs, path_a, path_b)
    own = made.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    known = own.join(counted(made), "pair").select(F.col("chunk").alias("of"), F.col("place").cast("int").alias("place"), "count", "best")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def sums(chunk: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        at = pairs.column("place").to_numpy()
        count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
        one = {c: chunk.column(c)[0] for c in chunk.column_names}
        ends = np.concatenate([[0], np.cumsum(one["n_links"].values.to_numpy())])
        place = np.frombuffer(pa.Codec("zstd").decompress(one["data"].as_py(), int(ends[-1]) * 4), "<i4")

        def by_document(x):
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(x[place])])[ends]))

        return pa.table({"doc_id": one["doc_ids"].values, **{n: one[n].values for n in NUMBERS}, "n_best": by_document(best), "count_sum": by_document(count), "groups_sha256": one["hashes"].values})

    schema = f"doc_id {id_type}, {', '.join(f'{n} long' for n in NUMBERS)}, n_best long, count_sum long, groups_sha256 string"
    return made.drop("pairs", "counts").groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(sums, schema)
