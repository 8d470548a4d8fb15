"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a hash, so that a block is a random part of its source. A source's target
in words gives its quota: how many of its blocks, in a permuted order, the mix takes (a second pass repeats them). The
tree then splits the quotas of all sources exactly among the output shards: a node draws, from a multivariate
hypergeometric distribution, what its left half gets; its right half gets the rest. With what the tree gives it, a shard draws
its blocks: shards take disjoint runs of each source's permuted blocks, and order their documents by a hash of their own.

At scale: the only work over documents is a count by (source, block), pre-aggregated where it is read, and a join of the
same key, which cuts a hot source into ``BLOCKS`` parts. Everything else is over at most sources * ``BLOCKS`` rows. Sources are
bundled: a first tree, of a number for each bundle of ``BUNDLE`` sources, is drawn in the driver and says how many blocks of a bundle
each shard gets; each bundle's own tree, drawn in a task, splits its sources' quotas into shards of those sizes. A node keeps only
sources that have blocks left. Nothing depends on the order of rows, so reruns and lost executors give the same mix.

Null sources are one source, the last; null texts have size 0 and are never missed: they are listed with 0 taken words.
Equal rows are mixed each, alike. An empty table gives an empty mix. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Parts of a source. A source's words come within a fraction of a part of its target.
BLOCKS = 4096
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2
#: Passes over a source's blocks in which gaps are filled.
ROUNDS = 4
#: Words of an output shard, and the fewest and most shards.
SHARD_WORDS = 500_000
SHARDS = (16, 8192)
SEED = 20_240_607
#: Sources whose quotas are split in a task.
BUNDLE = 4096
#: Pools from which numpy draws exactly; from larger ones a rounded normal of the same mean and variance is drawn.
EXACT_POOL = 10**9


def targets(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``sources`` (_source, source_size) with ``target`` and _rank: weights by code point order, no target over ``most`` sizes.

    In the order of size by weight, sources stop at their limit as long as their share of what is left exceeds it; the
    others share the rest by weight.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    limit = (F.col("source_size") * F.lit(float(most))).alias("_limit")
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    return (
        ranked.select("*", weight.alias("_weight"), limit, (F.sum("source_size").over(everything) * F.lit(total)).alias("_total"))
        .withColumn("_share", (F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_weight").over(after))
        .withColumn("_full", F.col("_limit") <= F.col("_share") * F.col("_weight"))
        .withColumn("_rest", F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_limit")).otherwise(0.0)).over(everything))
        .withColumn("_by", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(everything))
        .select("_source", "_rank", "source_size", F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("_rest") / F.col("_by") * F.col("_weight")).alias("target"))
    )


def _left(here: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's blocks are among ``n`` that are drawn from all."""
    pool = int(here.sum())
    if pool < EXACT_POOL:
        return rng.multivariate_hypergeometric(here, n, method="marginals")
    out = np.zeros_like(here)
    for k, own in enumerate(here.tolist()):  # one source after the other: a marginal given those before
        rest = pool - own
        if pool < EXACT_POOL:
            drawn = int(rng.hypergeometric(own, rest, n)) if n else 0
        else:
            spread = (n * (own / pool) * (rest / pool) * ((pool - n) / (pool - 1))) ** 0.5
            drawn = min(max(round(n * own / pool + spread * rng.standard_normal()), n - rest, 0), own, n)
        out[k], pool, n = drawn, rest, n - drawn
    return out


def equal_shards(total: int, shards: int) -> np.ndarray:
    """Sizes of shards that differ by one block at most."""
    return np.diff(np.arange(shards + 1) * total // shards)


def split(quotas: np.ndarray, sizes: np.ndarray, seed: int = SEED, tree: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """quotas (one a source) split exactly among shards of ``sizes`` (which have the same sum): source, shard, blocks, without zeros."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    source, out = np.flatnonzero(quotas), []
    nodes = [(0, len(sizes), source, np.asarray(quotas, np.int64)[source])]
    while nodes:
        lo, hi, source, here = nodes.pop()
        if not len(source):
            continue
        if hi - lo == 1:
            out.append((source, np.full(len(source), lo), here))
            continue
        mid = (lo + hi) // 2
        left = _left(here, int(ends[mid] - ends[lo]), np.random.default_rng([seed, tree, lo, hi]))
        for a, b, part in ((lo, mid, left), (mid, hi, here - left)):
            some = part > 0
            nodes.append((a, b, source[some], part[some]))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else tuple(np.zeros((3, 0), np.int64))


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """quotas (one a source) split exactly among shards of equal size: an array of shards by sources."""
    out = np.zeros((shards, len(quotas)), np.int64)
    source, shard, n = split(quotas, equal_shards(int(quotas.sum()), shards), seed)
    out[shard, source] = n
    return out


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _shares(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """_rank, _shard, _n: what the trees give each shard of ``quotas`` (_rank, _q)."""
    bundled = quotas.withColumn("_bundle", F.floor((F.col("_rank") - 1) / BUNDLE))
    totals = sorted(map(tuple, bundled.groupBy("_bundle").agg(F.sum("_q")).collect()))
    each = split_quotas(np.array([n for _, n in totals], np.int64), shards, seed).T
    sizes = quotas.sparkSession.createDataFrame([(b, x.tolist()) for (b, _), x in zip(totals, each, strict=True)], "_bundle long, _sizes array<long>")

    def of_bundle(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_rank")
        k, shard, n = split(rows.column("_q").to_numpy(), np.array(rows.column("_sizes")[0].as_py()), seed, rows.column("_bundle")[0].as_py() + 1)
        return pa.table({"_rank": rows.column("_rank").to_numpy()[k], "_shard": shard, "_n": n})

    return bundled.join(sizes, "_bundle").groupBy("_bundle").applyInArrow(of_bundle, "_rank long, _shard long, _n long")


def _dealt(docs: DataFrame, columns: list[str], shards: int | None, seed: int) -> tuple[DataFrame, int]:
    """``doc`` (a struct of ``columns``), size, source_size, target and shards of every document. Also, how many shards there are."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.struct(*columns).alias("doc"), F.col("source").alias("_source"), size.alias("_size"), F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(BLOCKS)).alias("_block"))
    blocks = cut(sized.groupBy("_source", "_block").agg(F.sum("_size").alias("words")))
    plan = targets(blocks.groupBy("_source").agg(F.sum("words").alias("source_size")))
    b = blocks.alias("b").join(plan.alias("p"), _same(F.col("b._source"), F.col("p._source"))).select("b.*", F.col("_rank").cast("long").alias("_rank"), "source_size", "target")
    of = Window.partitionBy("_rank").orderBy(F.xxhash64(F.lit(seed + 1), F.col("_source"), F.col("_block")), "_block")
    passes = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("int")
    whole = Window.partitionBy("_rank")
    picked = b.withColumn("_passes", passes).withColumns({"_rest": F.col("target") - F.col("_passes") * F.col("source_size"), "_more": F.lit(False), "_place": F.row_number().over(of)})
    for _ in range(ROUNDS):  # what fits, in permuted order; then, of the blocks left, what fits into the gap that a large one left
        gap = F.col("_rest") - F.sum(F.when(F.col("_more"), F.col("words")).otherwise(0)).over(whole)
        fits = ~F.col("_more") & (F.col("words") > 0) & (F.col("words") <= F.col("_gap")) & (F.col("_passes") < MOST)
        so_far = F.sum(F.when(F.col("_fits"), F.col("words")).otherwise(0)).over(whole.orderBy("_place"))
        picked = picked.withColumn("_gap", gap).withColumn("_fits", fits).withColumn("_more", F.col("_more") | (F.col("_fits") & (so_far <= F.col("_gap"))))
    drawn = cut(picked.withColumn("_copies", F.col("_passes") + F.col("_more").cast("int")).drop("_rest", "_more", "_gap", "_fits", "_passes"))
    if shards is None:
        words = drawn.agg(F.sum(F.col("_copies") * F.col("words"))).first()[0] or 0
        shards = int(min(max(SHARDS[0], words // SHARD_WORDS), SHARDS[1]))
    quotas = cut(drawn.groupBy("_rank").agg(F.sum("_copies").cast("long").alias("_q")).where("_q > 0"))
    # A shard's draws of a source are a run of its permuted blocks: those of the first pass, then those of the second.
    before = Window.partitionBy("_rank").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = _shares(quotas, shards, seed).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    draws = runs.select("_rank", "_shard", F.explode(F.sequence("_from", F.col("_from") + F.col("_n") - 1)).alias("_draw"))
    order = whole.orderBy("_place")
    taken = [(F.col("_copies") > k).cast("long") for k in range(MOST)]
    earlier = [sum((F.sum(x).over(whole) for x in taken[:k]), F.lit(0)) for k in range(MOST)]
    numbered = drawn.where("_copies > 0").withColumn("_draws", F.array(*[earlier[k] + F.sum(taken[k]).over(order) - 1 for k in range(MOST)]))
    of_block = (
        numbered.select("_rank", "_block", F.explode(F.slice("_draws", F.lit(1), F.col("_copies"))).alias("_draw")).join(draws, ["_rank", "_draw"])
        .groupBy("_rank", "_block").agg(F.sort_array(F.collect_list("_shard")).alias("shards"))
    )
    dealt = drawn.join(of_block, ["_rank", "_block"], "left").select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "source_size", "target", F.coalesce("shards", F.array().cast("array<long>")).alias("shards"))
    return sized.join(dealt, _same(F.col("_source"), F.col("_s")) & (F.col("_block") == F.col("_b"))).select("doc", F.col("_size").alias("size"), "source_size", "target", "shards"), shards


def allocate(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, int]:
    """``docs`` with size, source_size, target and ``shards``: the output shards that draw it, one for each copy that the mix takes.
    Also, how many shards there are: by default one for each ``SHARD_WORDS`` of the mix, within ``SHARDS``.

    The columns of these names are replaced; all others are kept.
    """
    made = ("size", "source_size", "target", "shards")
    out, n = _dealt(docs, [c for c in docs.columns if c.lower() not in made], shards, seed)
    return out.select("doc.*", *made), n


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix: the columns of ``docs``, once for each copy taken, each output shard whole in a partition and shuffled there."""
    dealt, n = _dealt(docs, docs.columns, shards, seed)
    rows = dealt.select("doc", F.posexplode("shards").alias("copy", "shard"))
    return rows.withColumn("order", F.xxhash64(F.lit(seed + 2), F.col("doc.doc_id"), F.col("copy"))).repartition(n, "shard").sortWithinPartitions("shard", "order").select("doc.*")


def digest(docs: DataFrame) -> DataFrame:
    """Of every document its size, its source's size and target, the words that the mix takes of it, and the shards that draw it."""
    out, _ = _dealt(docs, ["doc_id"], None, SEED)
    return out.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")
