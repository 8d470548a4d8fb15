"""Media columns: texts or bytes as series of lossless WebP pictures, and back to samples and features.

Everything happens row by row within a partition: no shuffle, no state. Pictures of ``webp.ROWS`` rows bound the memory
of a very long payload's reading; the payload itself is one value, as its column is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import webp

#: Bytes that are worked on at a time.
SLICE_BYTES = 3_000_000


def padded(data: bytes) -> bytes:
    return data + b"\0" * (64 * max(1, -(-len(data) // 64)) - len(data))


def _slices(column: pa.Array):
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield at, to
        at = to


def store(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """``df`` with the binary column ``media``: the bytes of ``payload``, padded with 0 to a positive multiple of 64.

    Null and empty payloads are stored as 64 bytes 0. A column of the name ``media`` is replaced; others are kept.
    """
    kept = df.drop(media)
    place = kept.columns.index(payload)

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch.column(place)):
                part = batch.slice(a, b - a)
                files = [webp.write_payload(padded(x or b"")) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(files, pa.binary())], names=[*part.schema.names, media])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(media, T.BinaryType())]))


def feature(samples: np.ndarray) -> str:
    """The mean sample of each four columns, as 16 two-digit hexadecimal numbers."""
    return samples.reshape(len(samples), 16, 4).sum((0, 2), dtype=np.int64).__floordiv__(len(samples) * 4).astype(np.uint8).tobytes().hex()


def read(df: DataFrame, media: str = "media", payload: str = "payload", features: str = "feature") -> DataFrame:
    """``df`` with the bytes that ``media`` holds, their feature, and how many pictures it has (``n_pictures``), and of them with
    transforms or back-references (``n_special``). Columns of these names are replaced. Null media give nulls; damaged ones raise ``Bad``."""
    kept = df.drop(payload, features, "n_pictures", "n_special")
    place = kept.columns.index(media)

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch.column(place)):
                part = batch.slice(a, b - a)
                series = [None if x is None else webp.pictures(x) for x in part.column(place).to_pylist()]
                plainly: list[bool] = []
                found = iter(webp.read_gray([x for s in series if s for x in s], plainly))
                plain = iter(plainly)
                rows = [None if s is None else np.concatenate([next(found) for _ in s]) for s in series]
                made = [
                    pa.array([None if r is None else r.tobytes() for r in rows], pa.binary()),
                    pa.array([None if r is None else feature(r) for r in rows], pa.string()),
                    pa.array([None if s is None else len(s) for s in series], pa.int64()),
                    pa.array([None if s is None else sum(not next(plain) and webp.special(x) for x in s) for s in series], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, payload, features, "n_pictures", "n_special"])

    types = ((payload, T.BinaryType()), (features, T.StringType()), ("n_pictures", T.LongType()), ("n_special", T.LongType()))
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(*t) for t in types]]))


def digest(docs: DataFrame) -> DataFrame:
    """Every text of ``docs`` stored and read back: sizes, hashes and feature of what was read."""
    text = F.coalesce("text", F.lit(""))
    stored = store(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.encode(text, "UTF-8").alias("payload")))
    out = read(stored.drop("payload"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "n_pictures",
        "n_special",
    )
