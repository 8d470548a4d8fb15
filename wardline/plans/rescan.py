"""Scan, rules for what got through, and a second scan under them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import GENERATED
from ..operators import scan
from .pipeline import decided

#: New rules become literals of the second scan's plan; more failures than this are an error and no policy.
MOST_RULES = 1_000


def learned(results: DataFrame, rules: list[tuple]) -> list[tuple]:
    """``rules`` (rows of a policy) after rules for the ``results`` that passed; rules generated before go. An attack with several rows has one rule."""
    failed = scan.generated_rules(results.where("status = 'passed'")).dropDuplicates(["name"])
    new = failed.orderBy("ord", "name").limit(MOST_RULES + 1).collect()
    if len(new) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} failed attacks")
    rows = [(r.name, r.tool, r.action, r.message, [("pattern_match", r.field, r.patterns, [])]) for r in new]
    rows += [r[1:] for r in sorted(rules, key=lambda r: r[0]) if not r[1].startswith(GENERATED)]
    return [(k, *r) for k, r in enumerate(rows)]


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, was, now and the rule that decides now, for each attack of both scans."""
    now = after.select("id", F.col("status").alias("now"), "rule_name")
    return before.select("id", F.col("status").alias("was")).join(now, "id")


def rescan(payloads: DataFrame, rules: list[tuple]) -> tuple[list[tuple], DataFrame]:
    """The new policy, and the comparison of a scan of ``payloads`` (ord, id, category, tool, args) under the old and the new one."""
    before = scan.outcome(decided(payloads, rules))
    new = learned(before, rules)
    return new, compared(before, scan.outcome(decided(payloads, new)))
