"""Exact duplicates by sorting: equal texts lie side by side, and neighbours are compared in full.

Texts are equal when they are the same without their ASCII white space. The order is: the first ``PREFIX`` characters of the normalised
text, its 64-bit hash, the text itself, more code points of the original first, smaller doc_id first (nulls last). Spark samples splitters
of this order, deals rows out by range and sorts each range, on disk if need be. The id is part of the splitters, so that a text that
a third of all rows has is spread over many ranges.

In a range, each row is compared with the one before it, and runs of equal texts are told by their first row, which is the one that stays.
Only runs that have the same prefix and hash as the range's first or last row can go on in another range: of them, at most a few a
range, the first rows carry their text, and equal ones are put together by it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, partitions, setting

PREFIX = 32
#: Rows that go to a worker at a time.
ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
SPACE = r"[\x20\x09-\x0D]+"


def _runs(batches):
    """Rows in order as runs: id, part, run, head (the run's first row), n and keep_id of the run, its text's hash, and the text itself
    in the first row of runs that may go on in another range."""
    part, run, first = TaskContext.get().partitionId(), -1, None
    key = norm = head = None
    ids, waiting, done = [], [], []

    def close():
        if ids:
            waiting.append((run, list(ids), head, norm))
            ids.clear()

    def flush(border):
        for n, mine, kept, text in waiting:
            sha = hashlib.sha256(text).hexdigest()
            done.extend((i, part, n, k == 0, len(mine), kept, sha, text if border and k == 0 else None) for k, i in enumerate(mine))
        waiting.clear()

    def frame(schema):
        columns = list(zip(*done, strict=True)) or [()] * len(schema)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], names=schema.names)

    schema = None
    for batch in batches:
        schema = schema or pa.schema([("doc_id", batch.schema.types[0]), ("part", pa.int64()), ("run", pa.int64()), ("head", pa.bool_()), ("n", pa.int64()), ("keep_id", batch.schema.types[0]), ("text_sha256", pa.string()), ("text", pa.binary())])
        for i, prefix, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (prefix, h) != key:
                close()
                flush(key is not None and key == first)
                key = prefix, h
                first = first or key
                norm = None
            if text != norm:
                close()
                run, norm, head = run + 1, text, i
            ids.append(i)
        if done:
            yield frame(schema)
    close()
    flush(True)
    if done:
        yield frame(schema)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id, text; other columns are left out).

    Of equal texts, the row with the most code points stays, then the one with the smallest doc_id, then (of rows alike) any one. Null
    texts are empty, and all empty texts are equal. Ids may be null; they come last. An empty table has no groups.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.length(text).alias("size"), F.regexp_replace(text, SPACE, "").alias("norm"))
    rows = rows.select("doc_id", "size", F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("h"), "norm")
    rest = [F.col("size").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "prefix", "h", *rest).sortWithinPartitions("prefix", "h", "norm", *rest)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.LongType()), T.StructField("run", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("keep_id", id_type), T.StructField("text_sha256", T.StringType()), T.StructField("text", T.BinaryType())])
    with setting(docs.sparkSession, *ROWS):
        runs = cut(dealt.select("doc_id", "prefix", "h", F.col("norm").cast("binary").alias("norm")).mapInArrow(_runs, schema))
    same = runs.where("text is not null").groupBy("text").agg(
        F.sum("n").alias("size"), F.min_by(F.struct("keep_id"), "part").alias("stays"), F.min("part").alias("at"), F.collect_list(F.struct("part", "run")).alias("of")
    )
    # a few runs a range, so that this is as small as the number of ranges
    over = same.where(F.size("of") > 1).select(F.explode("of").alias("r"), "size", "stays", "at").select("r.part", "r.run", "size", "stays", "at")
    found = runs.drop("text").join(F.broadcast(over), ["part", "run"], "left")
    return found.select(
        "doc_id", F.when(F.col("at").isNull(), F.col("keep_id")).otherwise(F.col("stays.keep_id")).alias("keep_id"), F.coalesce("size", "n").alias("group_size"),
        (F.col("head") & (F.col("at").isNull() | (F.col("at") == F.col("part")))).alias("kept"), "text_sha256",
    )
