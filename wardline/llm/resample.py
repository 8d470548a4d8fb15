"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A document's n-grams (words, pairs of neighbouring words, and the same of words' shapes) are hashed into ``BUCKETS`` buckets. The
raw model counts the buckets over all documents, the target model over documents labelled good. A document's log weight is the
sum over its n-grams of log(target / raw), each model without that document's own n-grams, so that labelled and other documents
are weighed alike; with Gumbel noise added, the k documents of the highest keys are a sample without replacement in proportion to
the weights. k is such that the sample holds all but the share ``LOSE`` of the documents labelled good.

At scale: the models are ``BUCKETS`` numbers each, pre-aggregated by task before they are shuffled; the k-th highest key
is found exactly by histograms of ``BINS`` bins, each over what the last one left open. Texts are never shuffled.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

BUCKETS = 1 << 15
#: Labelled documents that the target model is fitted to at most: those of the lowest hash. All documents are scored.
LABELLED = 50_000
#: Share of the documents labelled good that the sample may leave out.
LOSE = 0.005
#: Counts that both models start with in each bucket.
PRIOR = 8.0
BINS = 1 << 14
SEED = 7
#: Words whose hash a worker keeps; then it starts anew.
CACHE = 500_000


def shape(word: str) -> str:
    """Runs of upper case, other letters and digits, each as one sign; runs of any other character as that character."""
    if word.isalpha() and word[1:].islower():
        return "Aa" if word[0].isupper() else "a"
    return "".join(k for k, _ in itertools.groupby("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


class _Hashes(dict):
    """Of a word: the hash of its shape, then 32 bits of its own."""

    def __missing__(self, word: str) -> int:
        own, form = (zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (word, "\0" + shape(word)))
        self[word] = out = form << 32 | own
        return out


_hashes = _Hashes()


def buckets(text: str | None) -> np.ndarray:
    """The buckets of a text's n-grams: its words and their shapes, and pairs of neighbours of both."""
    if len(_hashes) > CACHE:
        _hashes.clear()
    both = np.fromiter(map(_hashes.__getitem__, (text or "").split()), np.uint64)
    singles = [both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)]
    pairs = [(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40) for h in singles]
    return np.concatenate([*singles, *pairs]).astype(np.int64) & (BUCKETS - 1)


def labelled(labels: DataFrame, seed: int = SEED) -> np.ndarray:
    """Ids, in order, of the good ones among at most ``LABELLED`` labelled documents.

    Good is quality 1 and not toxic. A document with several labels is good if all are; null labels don't count.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    rows = known.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(LABELLED).collect()
    return np.array(sorted(r.doc_id for r in rows if r.good), np.int64)


def models(docs: DataFrame, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in all documents and in the good ones."""
    known = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches):
        raw, target, seen = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), False
        for batch in batches:
            wanted = _within(batch.column(0), known.value)
            for a in range(0, batch.num_rows, 500):
                for text, hit in zip(batch.column(1).slice(a, 500).to_pylist(), wanted[a : a + 500], strict=True):
                    seen = True
                    found = buckets(text)
                    np.add.at(raw, found, 1) if len(found) < 2000 else raw.__iadd__(np.bincount(found, minlength=BUCKETS))
                    if hit:
                        target += np.bincount(found, minlength=BUCKETS)
        if seen:
            at = np.flatnonzero(raw)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["bucket"].to_numpy(np.int64)
    raw[at], target[at] = counts["raw"], counts["target"]
    return raw, target


def _within(ids: pa.Array, good: np.ndarray) -> np.ndarray:
    return np.isin(pc.fill_null(ids, -1).to_numpy(zero_copy_only=False), good) & pc.is_valid(ids).to_numpy(zero_copy_only=False)


def log_weight(found: np.ndarray, hit: bool, raw: np.ndarray, target: np.ndarray, sums: tuple[float, float]) -> float:
    """Of a document with the buckets ``found``, good or not, by models that it isn't in.

    Of each bucket, the target's count by the count that the raw model lets expect there, both with ``PRIOR`` added.
    """
    at, n = np.unique(found, return_counts=True)
    all_raw, all_target = sums[0] - len(found), sums[1] - len(found) * hit
    if all_raw <= 0 or all_target <= 0:
        return 0.0
    expected = np.maximum(raw[at] - n, 0) * (all_target / all_raw)
    return float((n * np.log((target[at] - n * hit + PRIOR) / (expected + PRIOR))).sum())


def weigh(docs: DataFrame, good: np.ndarray, seed: int = SEED) -> DataFrame:
    """``docs`` with ``log_weight``, ``n_grams``, ``good`` (labelled so) and ``key`` (the weight with its document's Gumbel noise)."""
    kept = docs.drop("log_weight", "n_grams", "good", "key")
    raw, target = models(docs, good) if len(good) else (np.zeros(BUCKETS), np.zeros(BUCKETS))
    known, model, sums = docs.sparkSession.sparkContext.broadcast(good), docs.sparkSession.sparkContext.broadcast((raw, target)), (raw.sum(), target.sum())
    number, place = kept.columns.index("doc_id"), kept.columns.index("text")

    def run(batches):
        for batch in batches:
            wanted = _within(pc.cast(batch.column(number), pa.int64()), known.value)
            for a in range(0, batch.num_rows, 500):
                part, hits = batch.slice(a, 500), wanted[a : a + 500]
                found = [buckets(t) for t in part.column(place).to_pylist()]
                weights = [log_weight(x, bool(hit), *model.value, sums) for x, hit in zip(found, hits, strict=True)]
                added = [pa.array(weights, pa.float64()), pa.array(map(len, found), pa.int64()), pa.array(hits, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "log_weight", "n_grams", "good"])

    added = [T.StructField("log_weight", T.DoubleType()), T.StructField("n_grams", T.LongType()), T.StructField("good", T.BooleanType())]
    weighed = kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))
    even = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), 11) + 0.5) / F.lit(float(1 << 53))
    return weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(even)))


def kth_highest(keys: DataFrame, k: int) -> float:
    """The k-th highest of the column ``key``, exactly, through histograms of a fixed number of bins."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    left = k
    while True:
        if lo is None or lo == hi:
            return float("-inf") if lo is None else lo
        at = F.least(F.floor((F.col("key") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        bins = keys.where(F.col("key").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).toPandas().sort_values("bin", ascending=False)
        place = int(np.searchsorted(bins["n"].cumsum().to_numpy(), left))
        if place >= len(bins):
            return lo
        left -= int(bins["n"].iloc[:place].sum())
        found = bins.iloc[place]
        if left == found["n"]:
            return float(found["lo"])
        if left == 1:
            return float(found["hi"])
        if (lo, hi) == (found["lo"], found["hi"]):  # one bin holds all, of different keys: halve what is left
            mid = lo + (hi - lo) / 2
            above = keys.where((F.col("key") > mid) & (F.col("key") <= hi)).count()
            lo, hi, left = (np.nextafter(mid, hi), hi, left) if above >= left else (lo, mid, left - above)
        else:
            lo, hi = float(found["lo"]), float(found["hi"])


def select(docs: DataFrame, labels: DataFrame, share: float | None = None, lose: float = LOSE, seed: int = SEED) -> DataFrame:
    """``docs`` with ``log_weight``, ``n_grams``, ``good``, ``key`` and ``kept``: whether it is in the sample.

    ``share`` of all documents are kept; by default, as many as it takes to hold all but the share ``lose`` of those labelled
    good. Without a good document all are kept. Null and empty texts have weight 0. Equal keys (repeated rows) are kept or
    rejected together. Columns of these five names are replaced; all others are kept.
    """
    good = labelled(labels, seed)
    out = weigh(docs.drop("kept"), good, seed)
    if not len(good) or (share is not None and share >= 1):
        return out.withColumn("kept", F.lit(True))
    return out.withColumn("kept", F.col("key") >= F.lit(_least(cut(out.select("key", "good")), share, lose)))


def _least(keys: DataFrame, share: float | None, lose: float) -> float:
    """The lowest key in the sample."""
    among = keys if share is not None else keys.where("good")
    n = among.count()
    k = round(n * share) if share is not None else n - int(n * lose)
    return kth_highest(among, k) if k else float("-inf") if share is None else float("inf")


def result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_grams, log_weight and kept of each document: ``select`` without the texts, so that they are weighed once."""
    good = labelled(labels)
    out = cut(weigh(docs.select("doc_id", "text"), good).drop("text"))
    kept = F.col("key") >= F.lit(_least(out, None, LOSE)) if len(good) else F.lit(True)
    return out.select("doc_id", "n_grams", "log_weight", kept.alias("kept"))
