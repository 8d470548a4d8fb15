"""The decision on a tool call, as one plan without a shuffle: findings, critical gate, policy, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import INJECTION
from ..functions.leaves import leaves_where
from ..functions.names import free
from ..functions.text import findings, matches
from ..operators.policy import compiled, rule_rows

FIELDS = ("to", "subject", "body", "command", "path")
FINDINGS = "array<struct<severity:string,pattern:string,field:string,description:string,matched_pattern:string>>"


def suspicious(json: Column, root: Column | str) -> Column:
    """The string leaves of a JSON object or array that any injection pattern is found in: array of path and value; null for other texts."""
    return leaves_where(json, root, lambda x: matches(x, [p for _, _, p in INJECTION]))


def inspected(calls: DataFrame) -> DataFrame:
    """``calls`` (args: map of text) with ``findings`` over all arguments and, where one is a JSON object or array, over its
    string leaves at any depth, and ``critical``. A pattern that a leaf has is not told of its whole argument again."""

    def of(entry):
        whole = findings(entry["value"], entry["key"], F.col("tool"))
        told = F.flatten(F.transform(suspicious(entry["value"], entry["key"]), lambda x: findings(x["value"], x["path"], F.col("tool"))))
        inner = F.coalesce(told, none)
        return F.concat(F.filter(whole, lambda f: ~F.exists(inner, lambda g: g["pattern"] == f["pattern"])), inner)

    none = F.array().cast(FINDINGS)
    found = F.coalesce(F.flatten(F.transform(F.map_entries("args"), of)), none)
    return calls.withColumn("findings", found).withColumn("critical", F.exists("findings", lambda x: x["severity"] == "critical"))


def decided(calls: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """``calls`` with findings, critical, action, rule_name and the rule's message; a critical finding blocks before any rule is asked."""
    x = inspected(calls)
    (d,) = free(x, "_decision")
    x = x.withColumn(d, compiled(rule_rows() if rules is None else rules))
    return x.withColumns({"action": F.when(F.col("critical"), "BLOCK").otherwise(F.col(f"{d}.action")), "rule_name": F.when(~F.col("critical"), F.col(f"{d}.rule_name")), "message": F.when(~F.col("critical"), F.col(f"{d}.message"))}).drop(d)


def stats(decisions: DataFrame, *by) -> DataFrame:
    """Counters of traffic: total, blocked, flagged and approved (flagged calls are approved), redacted responses."""
    return decisions.groupBy(*by).agg(
        F.count("*").alias("total_requests"), F.count_if(F.col("action") == "BLOCK").alias("blocked"), F.count_if(F.col("action") == "REQUIRE_APPROVAL").alias("flagged"),
        F.count_if(F.col("action") == "REQUIRE_APPROVAL").alias("approved"), F.count_if(F.coalesce("response", F.lit("")).contains("[REDACTED")).alias("redacted"),
    )
