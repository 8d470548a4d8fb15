"""Attack corpora as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

CORPUS = "ord int, id string, name string, category string, tool string, arguments string, expected_behavior string, severity string, description string"


def read(spark: SparkSession, path: str | None) -> DataFrame:
    """The attacks of a YAML or JSON file (a mapping with ``payloads``), with arguments as JSON. Without a path there are none.

    A corpus is a control-plane file. A file that is missing, no YAML, or has an attack without id, name, category or tool raises.
    """
    if path is None:
        return spark.createDataFrame([], CORPUS)
    import yaml

    with open(path, encoding="utf-8") as f:
        root = yaml.safe_load(f)
    rows = []
    for k, x in enumerate((root or {}).get("payloads") or []):
        needed = [x[c] for c in ("id", "name", "category", "tool")]
        rows.append((k, *map(str, needed), json.dumps(x.get("arguments") or {}), str(x.get("expected_behavior") or ""), str(x.get("severity") or "low"), str(x.get("description") or "")))
    return spark.createDataFrame(rows, CORPUS)
