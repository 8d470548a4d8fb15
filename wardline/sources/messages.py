"""Message logs: JSON lines and Content-Length frames."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames that are held at a time, and rows of a file that is written: readers of whole files hold one.
FRAMES, PER_FILE = 5_000, 500_000


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """message (VARIANT) and line of a log of JSON lines; blank lines are passed over, what is no JSON has a null message."""
    return spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "").withColumn("message", F.try_parse_json("line"))


def framed(spark: SparkSession, path: str) -> DataFrame:
    """path, n, body and error of each frame (header lines with a Content-Length, a blank line, so many bytes) of whole files, which Spark reads.

    What is no frame comes with an ``error`` and does not end its file. For long logs, see ``sources.framed``.
    """
    def run(batches):
        import io
        from itertools import batched

        import pyarrow as pa

        from .framed import _Window, frames

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                for found in batched(frames(_Window(io.BytesIO(data), len(data)), 0, len(data)), FRAMES):
                    columns = [pa.array([name] * len(found), pa.string()), pa.array(range(n, n + len(found)), pa.int64()), *(pa.array([f[k] for f in found], pa.string()) for k in (1, 2))]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "n", "body", "error"])
                    n += len(found)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, n long, body string, error string")


def write_lines(messages: DataFrame, path: str) -> None:
    """``messages``, one JSON object a row, as JSON lines; columns that are null are left out."""
    messages.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_framed(bodies: DataFrame, path: str) -> None:
    """The column ``body`` (JSON) as frames, at most ``PER_FILE`` a file; the line end behind each body counts as its white space."""
    frame = F.concat(F.lit("Content-Length: "), (F.octet_length("body") + 2).cast("string"), F.lit("\r\n\r\n"), F.col("body"))
    bodies.select(frame.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", PER_FILE).text(path)


def policy(path: str) -> list[dict]:
    """The raw rules of a policy file, JSON or YAML; none if it is missing or no mapping."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            root = json.loads(text)
        except ValueError:
            import yaml

            root = yaml.safe_load(text)
    except Exception:  # noqa: BLE001 - an unreadable policy is an empty one
        return []
    rules = root.get("rules") if isinstance(root, dict) else None
    return rules if isinstance(rules, list) else []


def save_policy(rules: list[dict], path: str) -> None:
    """Raw rules as a policy file (JSON, which is YAML too); readers see the old or the new one, never a part."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump({"rules": rules, "settings": {}}, f, indent=2, ensure_ascii=False)
    os.replace(f"{path}.new", path)
