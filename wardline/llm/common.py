"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Words of the contracts: runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: With it, a finished query's shuffle files go at once and not when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or (unset, on one machine, as in tests) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        path = os.path.join(tempfile.gettempdir(), f"wardline-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder; later steps read those files, whichever executors are gone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with setting(spark, CLEAN_UP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shielded(df: DataFrame, names: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with other names for columns that are called as one of ``names``, whatever the case, and their own names by these."""
    taken, own = {c.lower() for c in df.columns} | names, {}
    for c in df.columns:
        if c.lower() in names:
            new = f"{c}_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            own[new] = c
            df = df.withColumnRenamed(c, new)
    return df, own
