"""Vector codes: a codebook for each part of the vectors, moved to the means of its parts by filtering Lloyd rounds.

Vectors are put into blocks of at most ``BLOCK``, and each block has a kd-tree over each part position, with the box, sum and count of every
node: a table in the shared folder that all rounds read. A round goes down the trees level by level with the entries that may be
nearest to a point of a node's box. Of these, one is nearest to the box's middle; another goes when even the corner of the box that lies
farthest in its direction is not nearer to it. A node with one entry left is assigned whole, by its cached sum and count. Components are
integers and all comparisons exact, so that ties go to the lower index as without trees.

A round's sums come together by (part, entry, place) and the driver holds the codebooks: 4 * 256 entries, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, setting

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
BLOCK, LEAF = 16_384, 32
#: Nodes that are compared with all entries at a time.
NODES = 256
#: Components beyond this are an error: their squared distances could leave 64 bits.
LARGEST = 1 << 26
#: Sums of labels up to this many are broadcast; more are joined by shuffling.
FEW = 100_000
SALTS = 32
#: Blocks that go to a worker at a time.
ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2")


def cuts(width: int) -> list[int]:
    """Where the parts of a vector start, and the end: equal parts, or as equal as the width allows."""
    return [k * width // PARTS for k in range(PARTS + 1)]


def tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """A kd-tree: points in its order, whose place was ``order``; of each node its range of points (a, b), box, sum and children (0: none)."""
    order = np.arange(len(points))
    a, b, below = [0], [len(points)], []
    k = 0
    while k < len(a):
        mine = order[a[k] : b[k]]
        part = points[mine]
        spread = part.max(0) - part.min(0) if part.shape[1] else np.zeros(1)
        if len(mine) <= LEAF or not spread.any():
            below.append(0)
        else:
            half = len(mine) // 2
            order[a[k] : b[k]] = mine[np.argpartition(part[:, spread.argmax()], half)]
            below.append(len(a))
            a += [a[k], a[k] + half]
            b += [a[k] + half, b[k]]
        k += 1
    x = points[order]
    sums = np.vstack([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, 0, dtype=np.int64)])
    return {
        "order": order.astype(np.int32), "points": x.astype(np.int32), "a": np.array(a, np.int32), "b": np.array(b, np.int32), "below": np.array(below, np.int32), "sums": sums[b] - sums[a],
        "lo": np.array([x[i:j].min(0) for i, j in zip(a, b, strict=True)], np.int32), "hi": np.array([x[i:j].max(0) for i, j in zip(a, b, strict=True)], np.int32),
    }


def _numbers(width: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """As doubles where all sums of squares of differences of doubled numbers are exact in them, else as integers of 64 bits."""
    most = max((int(np.abs(x.astype(np.int64)).max(initial=0)) for x in arrays), default=0)
    return [x.astype(np.float64 if 16 * max(width, 1) * most * most < 1 << 52 else np.int64) for x in arrays]


def assign(t: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each point (in the tree's order), the sums and counts of the entries' points, and how many points were compared one by one."""
    points, lo, hi, z = _numbers(book.shape[1], t["points"], t["lo"], t["hi"], book)
    codes = np.zeros(len(points), np.int64)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    square, index = (z * z).sum(1), np.arange(len(book))
    level = [(np.zeros(1, np.int64), np.ones((1, len(book)), bool))]
    alone = []
    while level:
        after = []
        for nodes, may in level:
            middle = lo[nodes] + hi[nodes]
            far = 4 * square - 4 * middle @ z.T
            best = np.where(may, far, np.inf if far.dtype == np.float64 else np.iinfo(np.int64).max).argmin(1)
            apart = z[None] - z[best][:, None]
            corner = np.where(apart > 0, hi[nodes][:, None], lo[nodes][:, None])
            nearer = (apart * (z[None] + z[best][:, None] - 2 * corner)).sum(2)
            may &= (nearer < 0) | ((nearer == 0) & (index < best[:, None]))
            may[np.arange(len(nodes)), best] = True
            single = may.sum(1) == 1
            for n, e in zip(nodes[single].tolist(), best[single].tolist(), strict=True):
                codes[t["a"][n] : t["b"][n]] = e
            np.add.at(sums, best[single], t["sums"][nodes[single]])
            np.add.at(counts, best[single], (t["b"] - t["a"])[nodes[single]])
            child = t["below"][nodes]
            for k in np.flatnonzero(~single & (child == 0)):
                a, b = t["a"][nodes[k]], t["b"][nodes[k]]
                left = np.flatnonzero(may[k])
                codes[a:b] = left[(square[left] - 2 * points[a:b] @ z[left].T).argmin(1)]
                alone.append(np.arange(a, b))
            on = np.flatnonzero(~single & (child > 0))
            if len(on):
                after.append((np.concatenate([child[on], child[on] + 1]).astype(np.int64), np.concatenate([may[on], may[on]])))
        joined = [(np.concatenate([n for n, _ in after]), np.concatenate([m for _, m in after]))] if after else []
        level = [(n[k : k + NODES], m[k : k + NODES]) for n, m in joined for k in range(0, len(n), NODES)]
    each = np.concatenate(alone) if alone else np.zeros(0, np.int64)
    np.add.at(sums, codes[each], t["points"][each].astype(np.int64))
    np.add.at(counts, codes[each], 1)
    return codes, sums, counts, len(each)


def _packed(trees: list[dict[str, np.ndarray]]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{name}{k}": x for k, t in enumerate(trees) for name, x in t.items()})
    return out.getvalue()


def _unpacked(data: bytes) -> list[dict[str, np.ndarray]]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return [{name: z[f"{name}{k}"] for name in ("order", "points", "a", "b", "below", "sums", "lo", "hi")} for k in range(PARTS)]


def blocks(vectors: DataFrame, width: int) -> DataFrame:
    """The written blocks of ``vectors`` (vec_id, label, v: array of long, all of one width): vec_ids, labels and trees."""
    at = cuts(width)
    label = vectors.schema["label"].dataType

    def run(batches):
        ids, labels, found, size = [], [], [], 0

        def row(n):
            nonlocal ids, labels, found, size
            i, l, x = pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(found)
            trees = [tree(x[:n, a:b]) for a, b in zip(at, at[1:], strict=False)]
            ids, labels, found, size = [i[n:]], [l[n:]], [x[n:]], size - n
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c[:n]) for c in (i, l)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([_packed(trees)], pa.binary())], names=["vec_ids", "labels", "trees"])

        for batch in batches:
            ids.append(batch.column(0))
            labels.append(batch.column(1))
            found.append(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            size += batch.num_rows
            while size >= BLOCK:
                yield row(BLOCK)
        if size:
            yield row(size)

    rows = vectors.select(F.col("vec_id").cast("long"), "label", "v")
    return cut(rows.mapInArrow(run, f"vec_ids array<long>, labels array<{label.simpleString()}>, trees binary"))


def moved(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: entries at the floored means of their parts; those that have none stay."""

    def run(batches):
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for data in batch.column(0):
                for k, t in enumerate(_unpacked(data.as_py())):
                    _, s, n, _ = assign(t, books[k])
                    sums[k] += s
                    counts[k] += n
        for k, n in enumerate(counts):
            used = np.flatnonzero(n)
            if len(used):
                values = np.hstack([n[used, None], sums[k][used]])
                entry, place = np.repeat(used, values.shape[1]), np.tile(np.arange(values.shape[1]), len(used))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), k)), pa.array(entry), pa.array(place), pa.array(values.ravel())], names=["part", "entry", "place", "x"])

    totals = trees.select("trees").mapInArrow(run, "part long, entry long, place long, x long").groupBy("part", "entry", "place").agg(F.sum("x").alias("x"))
    values = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    with setting(trees.sparkSession, *ROWS):
        found = totals.collect()
    for part, entry, place, x in found:
        values[part][entry, place] = x
    return [np.where(v[:, :1] > 0, v[:, 1:] // np.maximum(v[:, :1], 1), b) for v, b in zip(values, books, strict=True)]


def coded(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    label = trees.schema["labels"].dataType.elementType

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = batch.column(0)[k].values, batch.column(1)[k].values
                codes, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for p, t in enumerate(_unpacked(batch.column(2)[k].as_py())):
                    mine = assign(t, books[p])[0]
                    codes[t["order"], p] = mine
                    error[t["order"]] += ((t["points"] - books[p][mine]) ** 2).sum(1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return trees.select("vec_ids", "labels", "trees").mapInArrow(run, f"vec_id long, label {label.simpleString()}, code string, error long")


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and v, floor(1024 * x) of each component, of the rows whose vectors are not null and hold finite numbers only."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    each = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    large = F.exists("embedding", lambda x: F.abs(x) > LARGEST / SCALE)
    v = F.when(large, F.raise_error(F.lit(f"a component is beyond {LARGEST // SCALE}"))).otherwise(each)
    return embeddings.where(F.coalesce(fine, F.lit(False))).select("vec_id", "label", v.alias("v"))


def train(vectors: DataFrame) -> tuple[DataFrame | None, list[np.ndarray]]:
    """The blocks of ``vectors`` (vec_id, label, v) and the codebooks after all rounds; none where there are no vectors.

    All vectors have the width of the one with the smallest vec_id; others take no part. Null ids are coded and start no entry. Repeated
    ids are vectors each; of them, the smaller ones (by component) come first. With fewer than 256 vectors there are fewer entries.
    """
    named = vectors.where("vec_id is not null")
    first = named.orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    if first is None or not first.n:
        return None, []
    vectors = vectors.where(F.size("v") == first.n)
    seeds = np.array([r.v for r in vectors.where("vec_id is not null").orderBy("vec_id", "v").limit(ENTRIES).select("v").collect()], np.int64)
    at = cuts(first.n)
    books = [seeds[:, a:b] for a, b in zip(at, at[1:], strict=False)]
    trees = blocks(vectors, first.n)
    for _ in range(ROUNDS):
        books = moved(trees, books)
    return trees, books


def digest(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that takes part: see ``integers`` and ``train``.

    Empty tables, and those without a vector that has an id and components, have no rows. Columns besides vec_id, embedding and label are left out.
    """
    spark = embeddings.sparkSession
    trees, books = train(integers(embeddings.select("vec_id", "embedding", "label")))
    if trees is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    said = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    with setting(spark, *ROWS):
        rows = cut(coded(trees, books))
    sums = cut(rows.groupBy("label").agg(F.sum("error").alias("label_error")))
    key = [F.col("label").isNull().alias("_none"), F.col("label").alias("_label")]
    if sums.count() <= FEW:
        rows, sums = rows.withColumn("_salt", F.lit(0)), F.broadcast(sums.select(*key, "label_error", F.lit(0).alias("_salt")))
    else:  # a frequent label's rows are spread over all salts
        rows = rows.withColumn("_salt", (F.xxhash64("vec_id") % SALTS + SALTS) % SALTS)
        sums = sums.select(*key, "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    met = (F.col("label").eqNullSafe(F.col("_label"))) & (rows["_salt"] == sums["_salt"])
    return rows.join(sums, met).select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
