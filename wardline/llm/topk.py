"""Exact top-k inner products with a pivot-distance index.

Every vector is extended by one component so that all have the same norm: then the largest inner products are the nearest
vectors. A vector's key is its nearest pivot and its distance from it; the index deals vectors out by pivot and annulus of
distance, and large annuli by a hash into blocks of about ``BLOCK``. A query first visits the annuli whose bounds are
nearest until they hold k candidates; by the triangle inequality, it then visits only those annuli that can still hold a score
as high as its k-th. A visit is a matrix product of a block of vectors and a block of queries: a block goes, once for each group
of about ``BLOCK`` queries, to those groups only that visit it.

How much is visited depends on the vectors (``visited_share``): of clustered ones little, of independent directions in many dimensions,
whose distances are nearly equal, all; the search is then the exhaustive one that exact results need.

The pivots, a quarter of the root of the number of vectors, are means fitted to the ``SAMPLE`` vectors of the lowest hash; all vectors are
indexed. The driver holds the pivots and, of each annulus, count and bounds: at most ``PIVOTS[1] * RINGS`` numbers each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Pivots at least and at most.
PIVOTS = (16, 256)
RINGS = 8
SAMPLE = 4096
#: Rounds in which pivots move to the means of their vectors.
MOVES = 5
BLOCK = 8192
SEED = 3


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


def _extended(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]])


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Means of ``n`` parts of the sample, at first of vectors that are far from each other."""
    chosen = [0]
    far = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen]
    for _ in range(MOVES):
        part = _distances(sample, pivots).argmin(1)
        size = np.bincount(part, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, part, sample)
        pivots = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], pivots)
    return pivots


def whole_numbers(vectors: DataFrame, scale: int = 256, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v: each component x as floor(scale * x), without vectors that are null, empty or hold null, NaN or infinity.

    Shorter vectors are filled up with 0.
    """
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(F.col(vector).isNotNull() & F.col(ids).isNotNull()).where((F.size(vector) > 0) & fine).select(F.col(ids).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 1
    return kept.withColumn("v", F.when(F.size("v") < longest, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))).otherwise(F.col("v")))


class Index:
    """The annuli of ``vectors`` (vec_id, v)."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors
        most, count = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)), F.count("*")).first()
        self.most = float(most or 0)
        rows = vectors.orderBy(F.xxhash64(F.lit(SEED), F.col("vec_id")), "vec_id").limit(SAMPLE).select("v").collect()
        self.empty = not rows
        if self.empty:
            return
        sample = _extended(np.array([r.v for r in rows]), self.most)
        self.pivots = _pivots(sample, int(min(max(PIVOTS[0], count**0.5 / 4), PIVOTS[1])))
        near = _distances(sample, self.pivots).min(1)
        self.edges = np.unique(np.quantile(near, np.arange(1, RINGS) / RINGS))
        pivots, edges, most = self.pivots, self.edges, self.most

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    d = _distances(_extended(_matrix(batch.column(1)), most), pivots)
                    p = d.argmin(1)
                    near = d[np.arange(len(p)), p]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p * RINGS + np.searchsorted(edges, near)), pa.array(near)], names=["vec_id", "v", "ring", "far"])

        self.rows = cut(vectors.mapInArrow(place, "vec_id long, v array<double>, ring long, far double"))
        stats = sorted(self.rows.groupBy("ring").agg(F.count("*"), F.min("far"), F.max("far")).collect())
        self.rings = np.array([s[0] for s in stats])
        self.counts = np.array([s[1] for s in stats])
        self.low, self.high = np.array([s[2] for s in stats]), np.array([s[3] for s in stats])
        self.parts = np.maximum(1, -(-self.counts // BLOCK))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The highest score that each query can have in each annulus."""
        d = _distances(np.hstack([q, np.zeros((len(q), 1))]), self.pivots)[:, self.rings // RINGS]
        least = np.maximum(np.maximum(d - self.high, self.low - d), 0) * (1 - 1e-9)
        norm = (q * q).sum(1)[:, None] + self.most
        return (norm - least * least) / 2 + 1 + 1e-9 * norm

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Which annuli a query visits first: the best by bound, until they hold k candidates and the query itself."""
        order = np.argsort(-bounds, 1, kind="stable")
        before = np.cumsum(self.counts[order], 1) - self.counts[order]
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, before < k + 1, 1)
        return out

    def visits(self, queries: DataFrame, k: int, second: bool) -> DataFrame:
        """(query_id, v, floor, ring, part) of each block that a query visits in the first or second round."""

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    bounds = self.bounds(_matrix(part.column(1)))
                    wanted = self.first(bounds, k)
                    if second:
                        wanted = ~wanted & (bounds >= part.column(2).to_numpy(zero_copy_only=False)[:, None])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([self.rings[w].tolist() for w in wanted], pa.list_(pa.int64())), pa.array([self.parts[w].tolist() for w in wanted], pa.list_(pa.int64()))], names=["query_id", "v", "floor", "rings", "parts"])

        out = queries.mapInArrow(_without_frames(run, self), "query_id long, v array<double>, floor double, rings array<long>, parts array<long>")
        each = out.select("query_id", "v", "floor", F.explode(F.arrays_zip("rings", "parts")).alias("x"))
        return each.select("query_id", "v", "floor", F.col("x.rings").alias("ring"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("x.parts") - 1)).alias("part"))

    def search(self, queries: DataFrame, k: int, second: bool, groups: int) -> DataFrame:
        """query_id, vec_id and score of the k best of each block that a query visits, if not below its floor."""
        asked = self.visits(queries, k, second).withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        met = asked.select("ring", "part", "group").distinct().toDF("ring", "part", "group")
        parts = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(self.rings, self.parts, strict=True) for x in pair]), F.col("ring").cast("int"))
        rows = self.rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts)).join(met, ["ring", "part"]).select("ring", "part", "group", "vec_id", "v")
        key = ("ring", "part", "group")
        return asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_best(k), "query_id long, vec_id long, score long")


def _without_frames(run, index: Index):
    """``run`` with an index that holds numbers only, as DataFrames don't go to tasks."""
    import types

    light = object.__new__(Index)
    light.__dict__ = {k: v for k, v in index.__dict__.items() if not isinstance(v, DataFrame)}
    cells = tuple(types.CellType(light) if c.cell_contents is index else c for c in run.__closure__)
    return types.FunctionType(run.__code__, run.__globals__, run.__name__, run.__defaults__, cells)


def _best(k: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        if asked.num_rows and rows.num_rows:
            ids = rows.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(rows.column("v"))[order]
            q, q_ids, floor = _matrix(asked.column("v")), asked.column("query_id").to_numpy(), asked.column("floor").to_numpy()
            for a in range(0, len(q), 256):
                score = q[a : a + 256] @ x.T
                own = q_ids[a : a + 256, None] == ids
                score[own] = -np.inf
                n = min(k, len(ids))
                least = np.maximum(np.partition(score, len(ids) - n, 1)[:, len(ids) - n], floor[a : a + 256])
                for i in range(len(score)):
                    hit = np.flatnonzero((score[i] >= least[i]) & ~own[i])
                    hit = hit[np.argsort(-score[i, hit], kind="stable")[:k]]  # ties: smaller ids come first
                    out[0].append(np.full(len(hit), q_ids[a + i]))
                    out[1].append(ids[hit])
                    out[2].append(score[i, hit].astype(np.int64))
        return pa.table({c: pa.array(np.concatenate(x), pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floors(asked: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The queries with the score of their k-th candidate; those that have fewer look everywhere."""
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).cast("double").alias("floor"))
    return asked.drop("floor").join(floors, "query_id", "left").select("query_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "v", F.lit(float("-inf")).alias("floor"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of each of ``queries`` among ``vectors`` (both vec_id, v).

    All, if there are fewer; ties go to the smaller vec_id. A query is never its own result: rows of its vec_id are left out.
    Repeated rows of another id are results each; repeated queries are answered once. Empty tables give no rows.
    Scores are exact below 2 ** 53. All v have the same length (``whole_numbers`` sees to it). Extra columns are left out.
    """
    vectors = vectors.select("vec_id", "v")
    index = Index(vectors)
    asked = _asked(queries)
    if index.empty:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    asked = cut(asked)
    groups = max(1, -(-asked.count() // BLOCK))
    first = cut(_ranked(index.search(asked, k, False, groups), k))
    again = index.search(_floors(asked, first, k), k, True, groups)
    return _ranked(first.select("query_id", "vec_id", "score").unionByName(again), k)


def visited_share(vectors: DataFrame, queries: DataFrame, k: int = 5) -> float:
    """Of all pairs of a query and a vector, the share of those in annuli that ``top_k`` visits."""
    index = Index(vectors.select("vec_id", "v"))
    if index.empty or queries.isEmpty():
        return 0.0
    asked = cut(_asked(queries))
    n = asked.count()
    first = cut(_ranked(index.search(asked, k, False, max(1, -(-n // BLOCK))), k))
    visits = index.visits(asked, k, False).select("query_id", "ring").unionByName(index.visits(_floors(asked, first, k), k, True).select("query_id", "ring")).distinct()
    each = visits.groupBy("ring").count().collect()
    size = dict(zip(index.rings.tolist(), index.counts.tolist(), strict=True))
    return sum(r["count"] * size[r.ring] for r in each) / (n * int(index.counts.sum()))


def digest(embeddings: DataFrame) -> DataFrame:
    vectors = cut(whole_numbers(embeddings))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))
