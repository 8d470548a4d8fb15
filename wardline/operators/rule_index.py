"""Policies of thousands of rules that are a table: an inverted index over what their patterns need.

Of most patterns it is plain that a match holds a certain text, or one of some texts. Such a literal is known in the index by its three letters in a row
that the fewest other literals have, and calls meet rules by field and three letters. Rules of other kinds meet all calls of their tool.
Then the pairs that are left are verified: each pattern is compiled once in a worker.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.leaves import leaf_texts

GRAM = 3
#: Rows of rules or of their index up to this many are broadcast; more meet calls by a shuffle.
FEW = 200_000


def folded(x: Column) -> Column:
    """Text without regard to case, so that what a pattern's literal matches is the literal: letters that only case makes alike become one."""
    return F.translate(F.lower(F.translate(x, "İ", "i")), "ıſ", "is")


@lru_cache(maxsize=100_000)
def literals(pattern: str) -> tuple[str, ...] | None:
    """Texts of ASCII letters in lower case, of at least three, one of which every match of ``pattern`` holds; None if there are no such texts."""
    from re import _constants as k
    from re import _parser as parser

    def better(a, b):
        rank = lambda x: (min(map(len, x)), -len(x))
        return b if a is None or (b is not None and rank(b) > rank(a)) else a

    def of(parsed):
        best, run = None, ""
        for op, value in [*parsed, (None, None)]:
            if op is k.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            if op is k.AT:
                continue
            if len(run) >= GRAM:
                best = better(best, (run,))
            run = ""
            if op is k.SUBPATTERN:
                best = better(best, of(value[3]))
            elif op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT) and value[0] > 0:
                best = better(best, of(value[2]))
            elif op is k.ATOMIC_GROUP:
                best = better(best, of(value))
            elif op is k.BRANCH:
                each = [of(b) for b in value[1]]
                if all(each):
                    best = better(best, tuple(dict.fromkeys(x for b in each for x in b)))
        return best

    try:
        return of(parser.parse(pattern, re.IGNORECASE))
    except (re.error, OverflowError, RecursionError):
        return None


@F.pandas_udf(T.StructType([T.StructField("field", T.StringType()), T.StructField("literals", T.ArrayType(T.StringType()))]))
def anchor(conditions: pd.Series) -> pd.DataFrame:
    """Of a rule's conditions, all of which have to hold, a pattern match whose literals are longest: its field and literals."""
    out = []
    for each in conditions:
        best = (0, None, None)
        for c in each if each is not None else []:
            if c["type"] == "pattern_match" and len(c["patterns"]):
                found = [literals(p) for p in c["patterns"]]
                if all(found):
                    every = [x for f in found for x in f]
                    best = max(best, (min(map(len, every)), c["field"], every), key=lambda b: b[0])
        out.append(best[1:])
    return pd.DataFrame(out, columns=["field", "literals"])


@lru_cache(maxsize=100_000)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE)


@lru_cache(maxsize=100_000)
def _read(conditions: str) -> list[dict]:
    return [{"field": None, "patterns": [], "domains": [], **c} for c in json.loads(conditions)]


def _holds(condition: dict, args: dict) -> bool:
    kind, value = condition["type"], args.get(condition["field"]) or ""
    if kind == "always":
        return True
    if kind == "pattern_match":
        return any(compiled(p).search(value) for p in condition["patterns"])
    if kind == "pii_detection":
        return any(compiled(p).search(x) for v in args.values() for x in leaf_texts(v or "") for p in condition["patterns"])
    domain = value.strip().rpartition("@")[2].strip().lower() if "@" in value else ""
    return domain not in condition["domains"] or not domain


@F.arrow_udf(T.BooleanType())
def verified(args: pa.Array, conditions: pa.Array) -> pa.Array:
    """Whether all conditions (JSON: read once in a worker) hold of the arguments."""
    out = []
    for a, cs in zip(args.to_pylist(), conditions.to_pylist(), strict=True):
        own = dict(a or ())
        out.append(all(_holds(c, own) for c in _read(cs)))
    return pa.array(out, pa.bool_())


def _grams(x: Column) -> Column:
    """The distinct runs of three letters of a text."""
    letters = F.split(x, "")
    return F.transform(F.array(letters), lambda y: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(y) - GRAM), lambda i: F.concat(*[F.get(y, i + k) for k in range(GRAM)]))))[0]


def index(rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """field, gram and literal, and the rule's columns, for each literal of ``rules`` (of ``anchored``) that have some."""
    named = [*by, "ord", "name"]
    each = rules.where("literals is not null").select(*named, "field", F.explode("literals").alias("literal"))
    grams = each.select(*named, "field", "literal", F.explode(_grams(F.col("literal"))).alias("gram"))
    known = grams.select("field", "literal", "gram").distinct().groupBy("field", "gram").agg(F.count("*").alias("n"))
    rarest = grams.join(known, ["field", "gram"]).groupBy(*named, "field", "literal").agg(F.min(F.struct("n", "gram")).alias("g"))
    return rarest.select(*named, "field", "literal", F.col("g.gram").alias("gram")).join(rules.drop("literals", "field"), named)


def anchored(rules: DataFrame) -> DataFrame:
    """``rules`` (ord and name together name one) with field and literals of the anchor of each; null where there is none."""
    return rules.withColumn("a", anchor("conditions")).select(*[c for c in rules.columns if c not in ("field", "literals")], "a.field", "a.literals")


def placed(rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``rules`` with ``place``: a number in their order (ord, name), so that the first of many is a minimum of numbers."""
    w = Window.partitionBy(*by, "ord").orderBy("name", "tool", "action", "message", F.to_json("conditions"))
    return rules.withColumn("place", F.shiftleft(F.col("ord").cast("long"), 31) + F.row_number().over(w) - 1)


def _at_hand(rules: DataFrame) -> DataFrame:
    """``rules`` for a join with calls, which stay where they are if the rules are few: few tools and fields are known, and each would be one task."""
    return F.broadcast(rules) if rules.limit(FEW + 1).count() <= FEW else rules


def candidates(calls: DataFrame, rules: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``by``, args and rule (ord, place, and conditions as JSON) of the pairs of calls and rules that may match: all those that do, and few others."""
    rule = F.struct("ord", "place", "conditions").alias("rule")
    known = anchored(placed(rules, by)).withColumn("conditions", F.to_json("conditions"))
    entries, others = _at_hand(index(known, by).drop("name", "action", "message")), _at_hand(known.where("literals is null").drop("name", "action", "message"))
    said = calls.where("args is not null").select(key, *by, F.col("tool").alias("_tool"), "args", F.explode("args").alias("field", "_value"))
    said = said.withColumn("_value", folded(F.col("_value"))).where(F.length("_value") >= GRAM).withColumn("gram", F.explode(_grams(F.col("_value"))))
    met = said.join(entries, [*by, "field", "gram"]).where(((F.col("tool") == F.col("_tool")) | (F.col("tool") == "*")) & F.col("_value").contains(F.col("literal")))
    asked = calls.select(key, *by, F.coalesce("args", F.create_map().cast("map<string,string>")).alias("args"), F.explode(F.array_distinct(F.array("tool", F.lit("*")))).alias("tool"))
    rest = asked.join(others, [*by, "tool"])
    return met.select(key, *by, "args", rule).unionByName(rest.select(key, *by, "args", rule))


def first_match(calls: DataFrame, rules: DataFrame, key: str = "call_id", by: tuple[str, ...] = ()) -> DataFrame:
    """``key``, action, rule_name and message of the rule that decides each of ``calls`` (tool, args: a map of text), as ``policy.compiled`` has them.

    ``rules``: rows of a policy; ``by``: columns of both that say which policy it is. Patterns are Python's, without regard to case. The first match is
    a minimum of places, pre-aggregated: only keys and numbers are shuffled, and what the rule says comes to them in the end.
    """
    found = candidates(calls, rules, key, by).where(verified("args", F.col("rule.conditions")))
    first = found.groupBy(key, *by).agg(F.min("rule.place").alias("place"))
    told = _at_hand(placed(rules, by).select(*by, "place", F.col("action").alias("_action"), F.col("name").alias("rule_name"), F.col("message").alias("_message")))
    return calls.select(key, *by).join(first, [key, *by], "left").join(told, [*by, "place"], "left").select(
        key, F.coalesce("_action", F.lit("ALLOW")).alias("action"), "rule_name", F.coalesce("_message", F.lit("")).alias("message")
    )
