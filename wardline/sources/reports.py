"""Reports of a scan as files: results as JSON rows, a summary, and a Markdown text. Spark writes all of them.

Results are rows with ord, id, name, category, tool, severity and status. A report is a folder: ``results`` and ``summary`` hold JSON
lines, ``report`` text whose files, read in the order of their names, are the Markdown.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cell
from ..operators import scan

RESULT = "ord int, id string, name string, category string, tool string, severity string, status string"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
METRICS = [("Total attacks", "total"), ("Blocked", "blocked"), ("Redacted", "redacted"), ("Passed (vulnerable)", "passed"), ("Allowed in safe mode, not executed", "safe"), ("Vulnerability score (%)", "score")]


def folder(path: str, at: datetime.datetime) -> str:
    """Where a scan that was made ``at`` some time goes."""
    return f"{path.rstrip('/')}/scan_{at:%Y-%m-%dT%H-%M-%S}"


def markdown(results: DataFrame, rules: DataFrame | None = None, target: str = "", safe: bool = False) -> DataFrame:
    """part, place, name and line of the report, which is in order by these columns.

    Findings come in the order vulnerable, then others, by name; ``rules`` (ord, name, tool, action, field, patterns) are recommended.
    """
    def lines(part, df, line, place=F.lit(0), name=F.lit("")):
        return df.select(F.lit(part).alias("part"), place.cast("int").alias("place"), name.alias("name"), line.alias("line"))

    def fixed(part, *texts):
        return lines(part, spark.createDataFrame(list(enumerate(texts)), "n int, text string"), F.col("text"), F.col("n"))

    spark = results.sparkSession
    total = scan.counts(results).select(F.posexplode(F.array(*[F.concat(F.lit(f"| {label} | "), F.col(c).cast("string"), F.lit(" |")) for label, c in METRICS])))
    status = F.when(F.col("status") == "passed", "VULNERABLE").when(F.col("status") == "safe", "SAFE_OK").otherwise(F.upper("status"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", status, *[cell(F.coalesce(c, F.lit(""))) for c in ("severity", "category", "name", "tool")]), F.lit(" |"))
    parts = [
        fixed(0, "# Scan report", "", f"- Target: `{target}`", f"- Safe mode: {'yes' if safe else 'no'}", "", "## Summary", "", "| Metric | Value |", "| --- | --- |"),
        lines(1, total, F.col("col"), F.col("pos")),
        fixed(2, "", "## Findings", "", "| Status | Severity | Category | Attack | Tool |", "| --- | --- | --- | --- | --- |"),
        lines(3, results, row, F.when(F.col("status") == "passed", 0).otherwise(1), F.coalesce("name", F.lit(""))),
        fixed(4, "", "## Recommended rules", ""),
    ]
    if rules is not None:
        parts.append(lines(5, rules, F.concat(F.lit("- `"), F.to_json(F.struct("name", "tool", "action", "field", "patterns")), F.lit("`")), F.col("ord")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save(results: DataFrame, path: str, rules: DataFrame | None = None, formats: tuple[str, ...] = ("json", "md"), **about) -> None:
    """Write the report into the folder ``path``; ``about`` is told in the Markdown."""
    if unknown := set(formats) - {"json", "md"}:
        raise ValueError(f"unknown formats {sorted(unknown)}")
    if "json" in formats:
        results.select(*COLUMNS).write.mode("overwrite").json(f"{path}/results")
        scan.counts(results).write.mode("overwrite").json(f"{path}/summary")
    if "md" in formats:
        markdown(results, rules, **about).orderBy("part", "place", "name", "line").select("line").write.mode("overwrite").text(f"{path}/report")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The results of a saved report."""
    return spark.read.schema(RESULT).json(f"{path}/results")
