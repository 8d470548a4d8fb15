"""Policies over time: a history of versions that never change, and calls decided under the version that held when they were made.

A history has a row for each rule of each version: version, valid_from and the columns of a policy. A version holds until the next one does. A version
without rules is a row whose name is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import policy, rule_index

RULE = [c.split()[0] for c in policy.RULE.split(", ")]
COLUMNS = ["version", "valid_from", *RULE]


def first(rules: DataFrame, at: Column) -> DataFrame:
    """A history whose version 1 is ``rules``, from ``at`` on."""
    return _version(rules, F.lit(1), at)


def _version(rules: DataFrame, number: Column, at: Column) -> DataFrame:
    one = rules.sparkSession.range(1).select(number.alias("version"), at.cast("timestamp").alias("valid_from"))
    return one.join(F.broadcast(rules.select(*RULE)), F.lit(True), "left").select(*COLUMNS)


def rules_at(history: DataFrame, version: Column | None = None) -> DataFrame:
    """The rules of a version, by default of the last one, as a policy."""
    last = history.agg(F.max("version")).first()[0] if version is None else version
    return history.where((F.col("version") == last) & F.col("name").isNotNull()).select(*RULE)


def published(history: DataFrame, rules: DataFrame, at: Column) -> DataFrame:
    """``history`` and, as its next version from ``at`` on, ``rules``. A version can't begin before the one that it follows."""
    last, since = history.agg(F.max("version"), F.max("valid_from")).first()
    at = at.cast("timestamp")
    checked = F.when(at > F.lit(since), at).otherwise(F.raise_error(F.lit("a version begins before the last one")))
    return history.select(*COLUMNS).unionByName(_version(rules, F.lit((last or 0) + 1), checked if since is not None else at))


def learned(history: DataFrame, generated: DataFrame, at: Column) -> DataFrame:
    """``history`` with a version that has ``generated`` (of ``scan.generated_rules``) before the last version's rules, of which generated ones go."""
    return published(history, policy.upserted(generated, rules_at(history)), at)


def intervals(history: DataFrame) -> DataFrame:
    """version, valid_from and valid_to (null: until now) of each version: as many as a policy ever had."""
    w = Window.orderBy("valid_from", "version")
    return history.select("version", "valid_from").distinct().withColumn("valid_to", F.lead("valid_from").over(w))


def held(calls: DataFrame, history: DataFrame, time: str = "ts") -> DataFrame:
    """``calls`` with the version that held at their ``time``; null before the first one, and without a time.

    An as-of join as an equi-join: versions are repeated for each day that they hold in, and calls meet those of their day.
    """
    lo, hi = calls.agg(F.min(F.to_date(time)), F.max(F.to_date(time))).first()
    if lo is None:
        return calls.withColumn("version", F.lit(None).cast("int"))
    each = intervals(history).where((F.to_date("valid_from") <= F.lit(hi)) & (F.col("valid_to").isNull() | (F.to_date("valid_to") >= F.lit(lo))))
    days = F.sequence(F.greatest(F.to_date("valid_from"), F.lit(lo)), F.least(F.coalesce(F.to_date("valid_to"), F.lit(hi)), F.lit(hi)))
    spread = each.select("version", F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.explode(days).alias("_day"))
    holds = (F.to_date(calls[time]) == F.col("_day")) & (calls[time] >= F.col("_from")) & (F.col("_to").isNull() | (calls[time] < F.col("_to")))
    return calls.drop("version").join(spread, holds, "left").drop("_from", "_to", "_day")


def replayed(calls: DataFrame, history: DataFrame, key: str = "call_id", time: str = "ts") -> DataFrame:
    """``key``, version, action, rule_name and message: each call decided by the rules that held when it was made. Where none did, it is allowed."""
    at = held(calls.select(key, time, "tool", "args"), history, time)
    decided = rule_index.first_match(at, history.where("name is not null").drop("valid_from"), key, ("version",))
    return at.select(key, "version").join(decided, key)
