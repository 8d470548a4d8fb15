"""Ordered policies: the first rule whose conditions all hold decides, else the call is allowed."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..catalogue import ACTIONS, GENERATED, MESSAGES, RULES
from ..functions.leaves import leaves_where
from ..functions.names import free
from ..functions.text import DIALECT, domain, matches
from . import rule_index

#: Kinds of conditions.
KINDS = ("always", "pattern_match", "domain_allowlist", "pii_detection")
CONDITIONS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("field", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType())), T.StructField("domains", T.ArrayType(T.StringType()))]))
RULE = "ord int, name string, tool string, action string, message string, conditions array<struct<type:string,field:string,patterns:array<string>,domains:array<string>>>"


def in_leaves(x: Column, test) -> Column:
    """Whether ``test`` (a function of a Column) holds of any leaf of ``x``, if that is a JSON object or array, else of ``x`` itself."""
    return F.coalesce(F.array_size(leaves_where(x, "", test, scalars=True)) > 0, test(x))


def condition(type: str, field: str, patterns: list[str], domains: list[str], args: str = "args", whole: str | None = None) -> Column:
    """One condition as a Column over the map of arguments ``args``. ``whole``: a column with all arguments as one JSON object, if there is one;
    without it, arguments that are a JSON object or array are walked one by one."""
    value = F.col(args)[field] if field else F.lit(None)
    if type == "always":
        return F.lit(True)
    if type == "pattern_match":
        return matches(value, patterns)
    if type == "pii_detection":
        test = lambda x: matches(x, patterns)
        return in_leaves(F.col(whole), test) if whole else F.exists(F.map_values(args), lambda x: in_leaves(x, test))
    if type == "domain_allowlist":  # holds for what is not on the list
        return ~F.coalesce(domain(value).isin([d.strip().lower() for d in domains]), F.lit(False)) if domains else F.lit(True)
    raise ValueError(f"unknown condition {type}")


def rule_rows(rules=RULES) -> list[tuple]:
    return [(k, n, t, a, MESSAGES.get(n, ""), [(kind, f, x if kind != "domain_allowlist" else [], x if kind == "domain_allowlist" else [])]) for k, (n, t, a, kind, f, x) in enumerate(rules)]


def compiled(rules: list[tuple], tool: str = "tool", args: str = "args", whole: str | None = None) -> Column:
    """struct(action, rule_name, message) of the rule that decides, for calls with a ``tool`` and a map ``args``.

    Rules are literals of the plan: no join, cheap tests first, and a row tests only the rules of its tool.
    """
    def when(rule):
        _, name, on, action, message, conditions = rule
        holds = reduce(Column.__and__, [condition(*c, args=args, whole=whole) for c in conditions], F.lit(True))
        return F.when(holds if on == "*" else (F.col(tool) == on) & holds, F.struct(F.lit(action).alias("action"), F.lit(name).alias("rule_name"), F.lit(message).alias("message")))

    allowed = F.struct(F.lit("ALLOW").alias("action"), F.lit(None).cast("string").alias("rule_name"), F.lit("").alias("message"))
    return F.coalesce(*[when(r) for r in sorted(rules)], allowed)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rule_rows(rules), RULE)


def joined(calls: DataFrame, rules: DataFrame, key: str = "call_id") -> DataFrame:
    """The decisions of rules that are a table, for many or changing rules: one row a call with action and rule_name. See ``rule_index``."""
    return rule_index.first_match(calls, rules, key).drop("message")


def of_tool(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """``calls`` with ``ords``: those of the ``rules`` (tool, ord) that are of their tool or of all tools, in order. The rules come to the calls: dealt out by
    tool, all calls would be a few tasks."""
    tool, named, every = free(calls, "_tool", "_named", "_every")
    each = rules.groupBy(F.col("tool").alias(tool)).agg(F.collect_set("ord").alias(named))
    met = calls.join(F.broadcast(each), F.col("tool") == F.col(tool), "left").drop(tool).join(F.broadcast(each.where(F.col(tool) == "*").select(F.col(named).alias(every))), F.lit(True), "left")
    none = F.array().cast("array<int>")
    return met.withColumn("ords", F.array_sort(F.array_union(F.coalesce(named, none), F.coalesce(every, none)))).drop(named, every)


def _row(k: int, r: dict, compiles) -> tuple | None:
    """The raw rule ``r`` as a row of a policy; None if anything is wrong with it. ``compiles`` raises for a pattern that is none."""
    def listed(c, key):
        if not isinstance(c.get(key), list):
            raise ValueError(f"{key} is no list")
        return list(map(str, c[key]))

    def parsed(c):
        kind = str(c.get("type") or "").strip()
        if kind not in KINDS:
            raise ValueError(f"unknown condition {kind}")
        patterns = listed(c, "patterns") if kind in ("pattern_match", "pii_detection") else []
        domains = [d.strip().lower() for d in listed(c, "allowed_domains") if d.strip()] if kind == "domain_allowlist" else []
        field = c.get("field") if kind in ("pattern_match", "domain_allowlist") else ""
        if not isinstance(field, str):
            raise ValueError("field is no text")
        for p in patterns:
            compiles(p)
        return kind, field, patterns, domains

    try:
        action = r["action"].strip().upper()
        conditions = r.get("conditions") or [{"type": "always"}]
        if action not in ACTIONS or not isinstance(conditions, list):
            return None
        return k, str(r.get("name") or f"rule_{k}"), str(r.get("tool") or "*"), action, str(r.get("message") or ""), list(map(parsed, conditions))
    except Exception:  # noqa: BLE001 - whatever is wrong with a rule, it alone is left out
        return None


def valid(rules: list[dict], spark: SparkSession) -> list[tuple]:
    """Raw rules (of a policy file) as rows; a malformed one is left out whole: no mapping, unknown action, bad condition or pattern."""
    pattern = spark.sparkContext._jvm.java.util.regex.Pattern
    rows = (_row(k, r, lambda p: pattern.compile(DIALECT + p)) for k, r in enumerate(rules))
    return [r for r in rows if r]


def parsed(raw: DataFrame) -> DataFrame:
    """The same for rules that are a table (ord, rule: JSON): its other columns and those of a policy. Patterns have to be Python's."""
    kinds = T.StructType([T.StructField("name", T.StringType()), T.StructField("tool", T.StringType()), T.StructField("action", T.StringType()), T.StructField("message", T.StringType()), T.StructField("conditions", CONDITIONS)])

    @F.arrow_udf(kinds)
    def read(ord: pa.Array, rule: pa.Array) -> pa.Array:
        out = []
        for k, text in zip(ord.to_pylist(), rule.to_pylist(), strict=True):
            try:
                row = _row(k, json.loads(text), lambda p: re.compile(p, re.IGNORECASE))
            except (TypeError, ValueError, RecursionError):
                row = None
            out.append(None if row is None else {**dict(zip(kinds.names, row[1:], strict=True)), "conditions": [dict(zip(("type", "field", "patterns", "domains"), c, strict=True)) for c in row[5]]})
        return pa.array(out, to_arrow_type(kinds))

    (r,) = free(raw, "_r")
    kept = [c for c in raw.columns if c not in ("rule", *kinds.names)]
    return raw.withColumn(r, read("ord", "rule")).where(F.col(r).isNotNull()).select(*kept, f"{r}.*")


def raw(rows: list[tuple]) -> list[dict]:
    """Rows as the mappings of a policy file."""
    def plain(kind, field, patterns, domains):
        own = {"pattern_match": {"field": field, "patterns": patterns}, "pii_detection": {"patterns": patterns}, "domain_allowlist": {"field": field, "allowed_domains": domains}}
        return {"type": kind, **own.get(kind, {})}

    return [{"name": name, "tool": tool, "action": action.lower(), "message": message, "conditions": [plain(*c) for c in conditions]} for _, name, tool, action, message, conditions in rows]


def without_generated(rules: DataFrame) -> DataFrame:
    return rules.where(~F.col("name").startswith(GENERATED))


def upserted(generated: DataFrame, rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``generated`` (of ``scan.generated_rules``) before the other rules of ``rules``, whose generated ones go; ``ord`` anew. The result is a policy:
    messages and conditions come with it. ``by``: columns of both that say whose policy it is, so that many are made at once; without them,
    a policy is a control-plane table."""
    conditions = F.array(F.struct(F.lit("pattern_match").alias("type"), F.col("field"), F.col("patterns"), F.array().cast("array<string>").alias("domains")))
    new = generated.select(*by, "ord", "name", "tool", "action", "message", conditions.alias("conditions"))
    return added(new, without_generated(rules).select(*new.columns), by)


def added(rules: DataFrame, rule: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``rules`` and, behind them, those of ``rule`` (the same columns; its own ``ord`` is their order); ``by`` as in ``upserted``."""
    (part,) = free(rules, "_part")
    both = rules.withColumn(part, F.lit(0)).unionByName(rule.withColumn(part, F.lit(1)))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy(part, "ord", "name")) - 1).drop(part)


def each(policy: DataFrame, owners: DataFrame) -> DataFrame:
    """A policy for each row of ``owners``: the rules of ``policy`` (a control-plane table, which becomes a literal of the plan) beside its columns."""
    rows = sorted(policy.select(*[x.split()[0] for x in RULE.split(", ")]).collect())
    rule = F.from_json(F.lit(json.dumps([r.asDict(recursive=True) for r in rows])), f"array<struct<{RULE.replace(' array', ':array').replace(' int', ':int').replace(' string', ':string')}>>")
    return owners.select("*", F.inline(rule))
