"""Token-id files: documents' ids in ascending order of doc_id, compressed in segments, and reading them back.

Documents are dealt out by ranges of doc_id, sorted, encoded with the tokenizers library and written as segments of whole documents with
about ``SEGMENT`` ids: a row each of a table in the shared folder, named by its shard (the range) and number. Readers take any segment
by itself. A document's place among all ids is its place in the segment, the segment's in its shard, and the shard's: only
the sums by shard, a number for each written partition, come together in one place.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import id_coder
from .common import cut, partitions

SEGMENT = id_coder.BLOCK * id_coder.LANES - 200_000
END = 2
#: Pre-tokens that a worker keeps with their ids, and ids kept for them; then it starts anew. Longer ones (in code points) are not kept.
CACHE = 2_400_000
POOL = 12_000_000
LONGEST = 32
#: Code points that are worked on at a time.
SLICE = 400_000
#: What follows an apostrophe to make a pre-token with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, OTHER, SPACE, EDGE, UNKNOWN = range(6)
_ODD, _BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_32, _FIELD = np.uint64(32), np.uint64(0xFFFFFFFF)


class ByteEncoder:
    """The tokenizers library's ids for a byte-level vocabulary, asked once for each distinct pre-token.

    Many texts are split at once, by array operations over their code points, into runs of letters, of numbers, of others and of white
    space; a space before a run is part of it. Of which kind a code point is, is asked of the library too. Pre-tokens are known by
    64-bit hashes. Texts that name a special token go to the library whole, and so do long pre-tokens.
    """

    BITS = 22

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.mixed = np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_ODD)
        self.mixed ^= self.mixed >> np.uint64(29)
        each = np.ones(SLICE + LONGEST + 1, np.uint64)
        each[1:] = _BASE
        self.powers = np.cumprod(each)
        each[1:] = pow(_BASE, -1, 1 << 64)
        self.inverse = np.cumprod(each)
        self._clear()

    def _clear(self) -> None:
        """The table by hash: a key, and where its ids start in the pool and how many they are, of 32 bits each."""
        self.keys, self.found = np.zeros((2, 1 << self.BITS), np.uint64)
        self.pool, self.used, self.known = np.zeros(1 << 16, np.int32), 0, 0

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds.take(points)
        if kinds.max() == UNKNOWN:
            split = self.library.pre_tokenizer.pre_tokenize_str
            for c in set(points[kinds == UNKNOWN].tolist()):
                self.kinds[c] = next((kind for kind, x in enumerate("a1!") if len(split(x + chr(c))) == 1), SPACE)
            kinds = self.kinds.take(points)
        return kinds

    def _starts(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pre-tokens start. Texts end with a point of ``edges``, which is a pre-token itself."""
        kinds = self._kinds(points)
        kinds[edges] = EDGE
        starts = np.ones(len(points), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
        starts[edges] = True
        last_space = (kinds == SPACE)[:-1] & (kinds[1:] < SPACE)
        starts[:-1] |= last_space
        starts[1:] &= ~(last_space & (points[:-1] == 32))
        ticks = ((points == 39) & starts).nonzero()[0]
        ticks = ticks[kinds[ticks + 1] == LETTER]
        if len(ticks):
            first = points[ticks + 1]
            second = np.where(kinds[ticks + 2] == LETTER, points[ticks + 2], 0)
            for c in CONTRACTIONS:
                at = ticks[(first == ord(c[0])) & (second == ord(c[1]) if len(c) > 1 else True)] + 1
                starts[at] = False
                at += len(c)
                starts[at[kinds[at] == LETTER]] = True
        return starts.nonzero()[0]

    def _hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each pre-token, of which long ones have any number."""
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(points), SLICE):
            lo, hi = np.searchsorted(starts, (a, a + SLICE))
            part = points[a : a + SLICE + LONGEST]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.mixed.take(part) * self.powers[: len(part)], out=sums[1:])
            at = starts[lo:hi] - a
            out[lo:hi] = (sums.take(ends[lo:hi] - a, mode="clip") - sums.take(at)) * self.inverse.take(at)
        out ^= out >> np.uint64(31)
        out *= np.uint64(_ODD)
        out ^= out >> _32
        out *= np.uint64(_BASE)
        return out | np.uint64(1)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids put into the pool: where each one's are, and how many."""
        ends = self.used + np.cumsum(sizes)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(ids) + len(self.pool), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return (ends - sizes << 32 | sizes).astype(np.uint64)

    def _ask_each(self, texts: list[str], after: tuple = ()) -> np.ndarray:
        got = [[*e.ids, *after] for e in self.library.encode_batch(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return self._keep(np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())), sizes)

    def _ask(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The library's ids of pre-tokens. Those that start with a space and go on are asked for as one text: they don't run together."""
        out = np.empty(len(starts), np.uint64)
        spaced = (points[starts] == 32) & (ends - starts > 1) & (self.kinds[points[np.minimum(starts + 1, len(points) - 1)]] != SPACE)
        k = spaced.nonzero()[0]
        if len(k):
            sizes = ends[k] - starts[k]
            at = np.repeat(starts[k] - (np.cumsum(sizes) - sizes), sizes)
            at += np.arange(len(at))
            got = self.library.encode(points[at].tobytes().decode("utf-32-le"), add_special_tokens=False)
            out[k] = self._keep(np.array(got.ids, np.int32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(k)))
        k = (~spaced).nonzero()[0]
        if len(k):
            out[k] = self._ask_each([points[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)])
        return out

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is found for each key, and which are not there."""
        place = (keys >> np.uint64(64 - self.BITS)).view(np.int64)
        there = self.keys.take(place)
        found = self.found.take(place)
        other = (there != keys).nonzero()[0]
        missing = [other[:0]]
        while len(other):
            free = there.take(other) == 0 if len(missing) == 1 else there == 0
            missing.append(other[free])
            other = other[~free]
            place = place[other] + 1 & (1 << self.BITS) - 1 if len(missing) == 2 else place[~free] + 1 & (1 << self.BITS) - 1
            there = self.keys.take(place)
            same = there == keys[other]
            found[other[same]] = self.found.take(place[same])
            other, place, there = other[~same], place[~same], there[~same]
        return found, np.concatenate(missing)

    def _insert(self, keys: np.ndarray, found: np.ndarray) -> None:
        """New and distinct keys: each goes to the first free place from its own on."""
        place = (keys >> np.uint64(64 - self.BITS)).view(np.int64)
        self.known += len(keys)
        while len(keys):
            free = self.keys.take(place) == 0
            self.keys[place[free]], self.found[place[free]] = keys[free], found[free]
            rest = self.keys.take(place) != keys
            keys, found, place = keys[rest], found[rest], place[rest] + 1 & (1 << self.BITS) - 1

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, with ``end`` after each if there is one; and how many are each text's."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.known > CACHE or self.used > POOL:
            self._clear()
        whole = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        after = () if end is None else (end,)
        edge = np.repeat(self._keep(np.array(after, np.int32), np.array([len(after)])), len(texts))
        if whole:
            edge[whole] = self._ask_each([texts[k] for k in whole], after)
            texts = list(texts)
            for k in whole:
                texts[k] = ""
        points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
        edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts = self._starts(points, edges)
        ends = np.append(starts[1:], len(points))
        keys = self._hashes(points, starts, ends)
        last = np.searchsorted(starts, edges)
        keys[last] = 0
        short = ends - starts <= LONGEST
        short[last] = True
        long = (~short).nonzero()[0]
        keys[long] = 0
        found, missing = self._look_up(keys)
        missing = missing[keys[missing] != 0]
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            known = self._ask(points, starts[missing[first]], ends[missing[first]])
            self._insert(new, known)
            found[missing] = known[back]
        if len(long):
            found[long] = self._ask(points, starts[long], ends[long])
        found[last] = edge
        sizes = (found & _FIELD).view(np.int64)
        sums = np.cumsum(sizes)
        at = np.repeat((found >> _32).view(np.int64) - (sums - sizes), sizes)
        at += np.arange(len(at))
        return self.pool.take(at), np.diff(sums[last], prepend=0)


def slices(texts: list[str]):
    """Runs of texts of about ``SLICE`` code points."""
    a = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield texts[a : k + 1]
            a, size = k + 1, 0
    if a < len(texts):
        yield texts[a:]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def write(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """The written segments: shard, segment, doc_ids, sizes (ids of each document, with its end) and data.

    Null texts are empty: the end alone. A null doc_id comes first; rows of one doc_id follow each other by their text's hash.
    """
    order = F.xxhash64("text")

    def run(batches):
        shard, n, ids, sizes, found, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        bpe = encoder(path)

        def row():
            data = id_coder.encode(np.concatenate(found))
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([n]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["shard", "segment", "doc_ids", "sizes", "data"])

        for batch in batches:
            at, doc_ids = 0, batch.column(0).to_pylist()
            for texts in slices([t or "" for t in batch.column(1).to_pylist()]):
                got, each = bpe.encode(texts, end)
                ids += doc_ids[at : at + len(texts)]
                at += len(texts)
                found.append(got)
                sizes.append(each)
                size += len(got)
                if size >= SEGMENT:
                    yield row()
                    n, ids, sizes, found, size = n + 1, [], [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order.alias("h")).repartitionByRange(partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return cut(rows.select("doc_id", "text").mapInArrow(run, "shard long, segment long, doc_ids array<long>, sizes array<long>, data binary"))


def _placed(segments: DataFrame) -> DataFrame:
    """``segments`` with ``offset``, the ids before them: of each segment in its shard, of each shard a number."""
    totals = segments.select("shard", "segment", F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    shards = sorted(totals.groupBy("shard").agg(F.sum("n")).collect())
    sums = np.cumsum([0, *(n for _, n in shards)]).tolist()
    bases = segments.sparkSession.createDataFrame([(s, b) for (s, _), b in zip(shards, sums, strict=False)], "shard long, base long")
    w = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(bases, "shard").select("shard", "segment", (F.col("base") + F.col("before")).alias("offset"))
    return segments.join(offsets, ["shard", "segment"]).select("doc_ids", "sizes", "data", "offset")


def _documents(batches):
    """Of some documents at a time: doc_ids, where each one's ids start among all, where they start and the last ends in the ids at hand, and these."""
    for batch in batches:
        for k in range(batch.num_rows):
            doc_ids, sizes, offset = batch.column(0)[k].values, batch.column(1)[k].values.to_numpy(), batch.column(3)[k].as_py()
            ids = id_coder.decode(batch.column(2)[k].as_py())
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for a in range(0, len(doc_ids), 1000):
                at = ends[a : a + 1001]
                yield doc_ids[a : a + 1000], at[:-1] + offset, at - at[0], ids[at[0] : at[-1]]


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start, ids of every document in ``segments``. A row for each written row, repeated ones too; none if there are none."""

    def run(batches):
        for doc_ids, starts, at, ids in _documents(batches):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "start", "ids"])

    return _placed(segments).mapInArrow(run, "doc_id long, start long, ids array<int>")


def checked(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids of every document in ``segments``: as ``read``, where the ids stay in the task."""

    def run(batches):
        for doc_ids, starts, at, ids in _documents(batches):
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[a:b]) for a, b in itertools.pairwise((at * 4).tolist())]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(segments).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of each document's ids, as read back. Empty texts have the end alone."""
    return checked(write(docs, path))
