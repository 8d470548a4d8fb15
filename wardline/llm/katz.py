"""Katz backoff language model, learned from a corpus and evaluated over it.

Words and an end token form bigrams. Counts up to ``K`` are discounted by Good-Turing; what that frees, and nothing else, is
shared among the words not seen after a context, by a backoff weight that normalises each context exactly. Unigrams are
discounted likewise; what that frees is the probability of an unknown word. The probability of a token is looked up
recursively: bigram, else backoff weight times unigram, else unknown.

The corpus is read once into chunks of about ``CHUNK_BYTES`` of text, each a row of a written table: words as numbers of the chunk's
own vocabulary. Chunks ask for what they hold and nothing else: for each (chunk, bucket of words or of contexts) one packed
row goes to the bucket, which adds up all chunks' counts and answers each chunk. So the model's tables stay partitioned, no task
holds more than a bucket or a chunk, and the number of buckets grows with the tokens. Contexts with more than 1 of ``HOT`` tokens
(at most as many as that) are spread over all buckets, by the word that follows; their sums are gathered apart.

What is shuffled is a packed row per pair of words that a chunk holds, not per token; texts are never shuffled.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions

#: Counts up to this are discounted.
K = 5
CHUNK_BYTES = 12_000_000
#: Distinct words or pairs that a bucket is meant to get from all chunks together.
BUCKET = 1_000_000
HOT = 2048
#: Passes over the buckets of contexts: of all chunks' requests, no more than a pass's are on disk at a time.
PASSES = 2
#: Words whose hash a worker keeps; then it starts anew.
CACHE = 400_000
END, BEGIN = np.uint64(1), np.uint64(2)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = _Hashes()


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), kind)


def small(x: np.ndarray) -> np.ndarray:
    """Numbers byte by byte, low bytes first: small ones pack well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unsmall(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def pack_words(words: np.ndarray, starts: np.ndarray) -> bytes:
    """Hashes that rise from each of ``starts``: as differences, byte by byte."""
    steps = np.diff(words, prepend=np.uint64(0))
    steps[starts] = words[starts]
    return pack(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def unpack_words(data: bytes, starts: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(unpack(data, np.uint8).reshape(8, -1).T).view("<u8")[:, 0]
    sums = np.cumsum(steps, dtype=np.uint64)
    before = sums[starts] - steps[starts]
    return sums - np.repeat(before, np.diff(np.append(starts, len(steps))))


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` dealt out by ``key``, which has ``n`` values: the more there are, the more partitions."""
    return df.repartition(max(n, partitions(df.sparkSession)), key)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Chunk:
    """Documents in a row: ids, their tokens (each document's words and the end) as places in ``vocab``, sorted hashes.

    A row has the vocabulary by falling frequency, so that its tokens are small numbers.
    """

    SCHEMA = "chunk long, ids array<long>, sizes array<long>, n_words long, tokens binary, vocab binary"

    def __init__(self, row: dict):
        self.ids, self.sizes = row["ids"], np.array(row["sizes"], np.int64)
        by_rank = unpack(row["vocab"], np.uint64)
        order = np.argsort(by_rank)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.vocab, self.tokens = by_rank[order], place[unsmall(row["tokens"])]
        self.held = np.array([held_out(i) for i in self.ids], bool)
        self.train = ~np.repeat(self.held, self.sizes)

    def unigrams(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.vocab))

    def pairs(self) -> None:
        """context, word (places in ``contexts`` and ``vocab``), training count of each distinct pair, and each token's pair."""
        ends = np.cumsum(self.sizes)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[ends - self.sizes] = len(self.vocab)
        self.contexts = np.append(self.vocab, BEGIN)
        key, self.pair = np.unique(before.astype(np.int64) << 32 | self.tokens, return_inverse=True)
        self.context, self.word = key >> 32, key & 0xFFFFFFFF
        self.count = np.bincount(self.pair[self.train], minlength=len(key))

    def dealt(self, buckets: int, hot: np.ndarray) -> list[np.ndarray]:
        """The pairs of each bucket, in order of context and word."""
        ctx = self.contexts[self.context]
        spread = np.isin(self.contexts, hot)[self.context]
        at = np.where(spread, ctx * np.uint64(0x9E3779B97F4A7C15) ^ self.vocab[self.word] >> np.uint64(7), ctx >> np.uint64(9)) % np.uint64(buckets)
        order = np.argsort(at, kind="stable")
        return np.split(order, np.searchsorted(at[order], np.arange(1, buckets)))


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) as rows of ``Chunk.SCHEMA``."""

    def rows(batches):
        place, n = TaskContext.get().partitionId(), 0
        ids, found, size = [], [], 0

        def row():
            sizes = [len(x) for x in found]
            vocab, tokens, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return pa.RecordBatch.from_arrays(
                [pa.array([place << 32 | n]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([len(vocab)]), pa.array([pack(small(rank[tokens]))], pa.binary()), pa.array([pack(vocab[order])], pa.binary())],
                names=["chunk", "ids", "sizes", "n_words", "tokens", "vocab"],
            )

        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                for i, text in zip(batch.column(0).slice(a, 200).to_pylist(), batch.column(1).slice(a, 200).to_pylist(), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    ids.append(i)
                    found.append(np.append(np.fromiter(map(_hashes.__getitem__, data.lower().split()), np.uint64), END))
                    size += len(data) + 8
                    if size >= chunk_bytes:
                        yield row()
                        ids, found, size, n = [], [], 0, n + 1
                if len(_hashes) > CACHE:
                    _hashes.clear()
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, Chunk.SCHEMA)


ANSWER = "chunk long, bucket int, data binary, second binary, hot long, n array<long>, seen double"


def _answers(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.float64())
    return pa.table({name: pa.array(c, k) for name, c, k in zip(("chunk", "bucket", "data", "second", "hot", "n", "seen"), columns, kinds, strict=True)})


def _n(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1 to K + 1."""
    return np.bincount(counts[(counts > 0) & (counts <= K + 1)], minlength=K + 2)[1:]


def word_counts(made: DataFrame, buckets: int) -> DataFrame:
    """An ``ANSWER`` for each chunk and bucket of words: their counts. Rows without a chunk: sums, and hot words."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                counts, at = c.unigrams(), c.vocab % np.uint64(buckets)
                for b in np.unique(at).tolist():
                    here = at == b
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([b], pa.int32()), pa.array([pack(c.vocab[here])], pa.binary()), pa.array([pack(small(counts[here]))], pa.binary())], names=["chunk", "bucket", "words", "counts"])

    def add(asked: pa.Table) -> pa.Table:
        words = [unpack(x, np.uint64) for x in asked.column("words").to_pylist()]
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, np.concatenate([unsmall(x) for x in asked.column("counts").to_pylist()])).astype(np.int64)
        b, ends = asked.column("bucket")[0].as_py(), np.cumsum([0, *map(len, words)])
        rows = [(chunk, b, pack(small(total[at[ends[k] : ends[k + 1]]])), None, None, None, None) for k, chunk in enumerate(asked.column("chunk").to_pylist())]
        rows.append((None, b, None, None, None, [*_n(total).tolist(), int(total.sum()), int((total > 0).sum())], None))
        most = np.argsort(-total)[: HOT + 1]  # those of more than 1 in HOT of all tokens are among them
        rows += [(None, b, None, None, int(known[k].astype(np.int64)), [int(total[k])], None) for k in most]
        return _answers(rows)

    return dealt(made.mapInArrow(ask, "chunk long, bucket int, words binary, counts binary"), "bucket", buckets).groupBy("bucket").applyInArrow(add, ANSWER)


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0 to K: Good-Turing's, from the counts of counts ``n`` (of 1 to K + 1).

    Where a count of counts is too irregular for a factor between 0 and 1, from those on the line through their logarithms; where the line
    falls too little for that, half a count off.
    """
    out = np.ones(K + 1)
    r = np.arange(1, K + 2)
    n = np.array(n[: K + 1], np.float64)
    line = n
    if (n > 0).sum() > 1:
        slope, start = np.polyfit(np.log(r[n > 0]), np.log(n[n > 0]), 1)
        line = np.exp(start + slope * np.log(r))
    for k in range(1, K + 1):
        for m in (n, line):
            a = (K + 1) * m[K] / m[0] if m[0] else 1
            d = ((k + 1) * m[k] / (k * m[k - 1]) - a) / (1 - a) if m[k - 1] and a < 1 else 0
            if 0 < d < 1:
                out[k] = d
                break
        else:
            out[k] = (k - 0.5) / k
    return out


class Unigrams:
    """Probabilities of words by count, in log10 and plain; all that are unknown share what is discounted."""

    def __init__(self, n: list[int], tokens: int, words: int):
        self.tokens, self.words = tokens, words
        self.discount = discounts(n[: K + 1])
        free = sum((1 - self.discount[r]) * r * n[r - 1] for r in range(1, K + 1))
        self.total = tokens if free else tokens + 1  # nothing is discounted: one more token is the unknown one
        self.unknown = (free or 1) / self.total if tokens else 1.0

    def of(self, counts: np.ndarray) -> np.ndarray:
        factor = self.discount[np.minimum(counts, K)] * (counts <= K) + (counts > K)
        return np.where(counts > 0, factor * counts / self.total if self.total else 0, self.unknown)


def _met(buckets: int, parts: list[dict], c: Chunk) -> np.ndarray:
    """The counts of a chunk's words from the answers to it."""
    counts, at = np.zeros(len(c.vocab), np.int64), c.vocab % np.uint64(buckets)
    for x in parts:
        counts[at == x["bucket"]] = unsmall(x["data"])
    return counts


def pair_counts(made: DataFrame, words: DataFrame, word_buckets: int, buckets: int, hot: np.ndarray, model: Unigrams, n_chunks: int, turn: int) -> DataFrame:
    """An ``ANSWER`` for each chunk and bucket of contexts: the counts of its pairs; for each context how many words were seen
    1 to K times after it, and what share of the unigrams all words seen after it have. Buckets of pass ``turn`` only.
    """

    def ask(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = [[] for _ in range(7)]
        for row in rows.to_pylist():
            c = Chunk(row)
            counts = _met(word_buckets, answers.to_pylist(), c)
            c.pairs()
            for b, here in enumerate(c.dealt(buckets, hot)):
                if len(here) and b % PASSES == turn:
                    ctx, first, each = np.unique(c.context[here], return_index=True, return_counts=True)
                    order = np.argsort(first)
                    for k, x in enumerate((row["chunk"], b, pack(c.contexts[ctx[order]]), pack(small(each[order])), pack_words(c.vocab[c.word[here]], np.sort(first)), pack(small(c.count[here])), pack(small(counts[c.word[here]])))):
                        out[k].append(x)
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
        return pa.table({name: pa.array(x, k) for name, x, k in zip(("chunk", "bucket", "contexts", "each", "words", "counts", "of_word"), out, kinds, strict=True)})

    def add(asked: pa.Table) -> pa.Table:
        asked_rows = asked.to_pylist()
        ctxs = [unpack(x["contexts"], np.uint64) for x in asked_rows]
        each = [unsmall(x["each"]) for x in asked_rows]
        known, at = np.unique(np.concatenate(ctxs), return_inverse=True)
        at_pair = np.repeat(at, np.concatenate(each))
        after = np.concatenate([unpack_words(x["words"], np.cumsum(e) - e) for x, e in zip(asked_rows, each, strict=True)])
        key = known[at_pair] * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xC2B2AE3D27D4EB4F)
        _, first, pair = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(pair, np.concatenate([unsmall(x["counts"]) for x in asked_rows])).astype(np.int64)
        seen = total > 0
        of = at_pair[first]
        share = np.bincount(of[seen], model.of(np.concatenate([unsmall(x["of_word"]) for x in asked_rows])[first[seen]]), len(known))
        n = np.stack([np.bincount(of[total == r], minlength=len(known)) for r in range(1, K + 1)], 1)
        b, pair_ends, ctx_ends = asked_rows[0]["bucket"], np.cumsum([0, *map(np.sum, each)]), np.cumsum([0, *map(len, ctxs)])
        rows = []
        for k, x in enumerate(asked_rows):
            mine = at[ctx_ends[k] : ctx_ends[k + 1]]
            second = pack(small(n[mine].ravel())), pack(share[mine])
            rows.append((x["chunk"], b, pack(small(total[pair[pair_ends[k] : pair_ends[k + 1]]])), len(second[0]).to_bytes(4, "little") + second[0] + second[1], None, None, None))
        rows.append((None, b, None, None, None, _n(total).tolist(), None))
        for k in np.flatnonzero(np.isin(known, hot)).tolist():
            rows.append((None, b, None, None, int(known[k].astype(np.int64)), n[k].tolist(), float(share[k])))
        return _answers(rows)

    asked = dealt(made, "chunk", n_chunks).groupBy("chunk").cogroup(dealt(words, "chunk", n_chunks).groupBy("chunk")).applyInArrow(ask, "chunk long, bucket int, contexts binary, each binary, words binary, counts binary, of_word binary")
    return dealt(asked, "bucket", buckets).groupBy("bucket").applyInArrow(add, ANSWER)


def backoff(n: np.ndarray, share: np.ndarray, total: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts: what their counts are divided by, and the weight of the unigrams of words not seen after them.

    ``n`` are the numbers of words seen 1 to K times, ``share`` the unigram probability of all that were seen, ``total`` the
    context's count. A context without a count to discount gives one more count to what was not seen.
    """
    free = n @ ((1 - discount[1:]) * np.arange(1, K + 1))
    by = np.where(free > 0, total, total + 1)
    return np.maximum(by, 1), np.where(free > 0, free, 1) / np.maximum(by, 1) / np.maximum(1 - share, 1e-12)


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    Null and empty texts have the end token only. Repeated rows are counted and scored each. A null doc_id counts as the empty text:
    it is held out. Without training tokens, every token is unknown and has probability 1. Other columns are not read.
    """
    made = cut(chunks(docs, chunk_bytes))
    size = made.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)), F.count("*")).first()
    word_buckets, buckets = max(1, -(-size[0] // bucket)), max(1, -(-size[1] * 2 // (3 * bucket)))
    counted = cut(word_counts(made, word_buckets))
    sums = counted.where("chunk is null and hot is null").select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    *n, tokens, words = [r.n for r in sorted(sums)] if sums else [0] * (K + 3)
    model = Unigrams(n, tokens, words)
    rows = counted.where(F.col("hot").isNotNull() & (F.col("n")[0] * HOT > tokens)).select("hot").collect()  # fewer than HOT
    # Sentences begin with a context of their own.
    hot = np.array([*[r.hot for r in rows], int(BEGIN)], np.int64).astype(np.uint64)
    asked = counted.where("chunk is not null").drop("hot", "n", "seen")
    found = functools.reduce(DataFrame.unionByName, [cut(pair_counts(made, asked, word_buckets, buckets, hot, model, size[2], turn)) for turn in range(PASSES)])
    pair_n = found.where("chunk is null and hot is null").select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    discount = discounts([r.n for r in sorted(pair_n)] if pair_n else [0] * (K + 1))
    spread = found.where("hot is not null").groupBy("hot").agg(*[F.sum(F.col("n")[r]).alias(f"n{r}") for r in range(K)], F.sum("seen").alias("seen")).collect()
    hot_n = {r.hot: ([r[f"n{k}"] for k in range(K)], r.seen) for r in spread}
    n_documents = made.select(F.explode("ids").alias("doc_id")).where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0).count()

    def evaluate(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = [[] for _ in range(7)]
        parts = answers.to_pylist()
        for row in rows.to_pylist():
            c = Chunk(row)
            counts = _met(word_buckets, [x for x in parts if x["second"] is None], c)
            c.pairs()
            total = np.zeros(len(c.context), np.int64)
            n, share = np.zeros((len(c.contexts), K), np.int64), np.zeros(len(c.contexts))
            dealt = c.dealt(buckets, hot)
            for x in (x for x in parts if x["second"] is not None):
                here = dealt[x["bucket"]]
                total[here] = unsmall(x["data"])
                ctx, first = np.unique(c.context[here], return_index=True)
                ctx = ctx[np.argsort(first)]
                cut_at = 4 + int.from_bytes(x["second"][:4], "little")
                n[ctx] = unsmall(x["second"][4:cut_at]).reshape(-1, K)
                share[ctx] = unpack(x["second"][cut_at:], np.float64)
            for k in np.flatnonzero(np.isin(c.contexts, hot)).tolist():
                n[k], share[k] = hot_n.get(int(c.contexts[k].astype(np.int64)), ([0] * K, 0.0))
            single = model.of(counts)
            of_context = np.append(counts, n_documents)
            by, weight = backoff(n, share, of_context, discount)
            factor = discount[np.minimum(total, K)] * (total <= K) + (total > K)
            below = np.where(of_context[c.context] > 0, weight[c.context], 1.0) * single[c.word]
            p = np.log10(np.where(total > 0, factor * total / by[c.context], below))[c.pair]
            base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1)))[c.tokens]
            at = np.cumsum(c.sizes) - c.sizes
            for k, x in enumerate((c.ids, c.held.tolist(), c.sizes.tolist(), np.add.reduceat((counts > 0)[c.tokens].astype(np.int64), at).tolist(), [model.tokens] * len(c.ids), np.add.reduceat(base, at).tolist(), np.add.reduceat(p, at).tolist())):
                out[k] += x
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({name: pa.array(x, k) for name, x, k in zip(names, out, kinds, strict=True)})

    answers = asked.unionByName(found.where("chunk is not null").drop("hot", "n", "seen"))
    return dealt(made, "chunk", size[2]).groupBy("chunk").cogroup(dealt(answers, "chunk", size[2]).groupBy("chunk")).applyInArrow(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
