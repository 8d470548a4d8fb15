"""Replay of an attack corpus: synthetic tools, outcome of each attack, score, report, rules for what got through."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import BASE64, BODY_NAMES, COMMAND_NAMES, FILES, GENERATED, HINTS, KEYWORDS, PATH_NAMES, PROBES, REDACTED, TOOLS, payload_rows
from ..functions.leaves import bound
from ..functions.names import free
from ..functions.text import escaped, matches, normalised_tool, redacted

PAYLOAD = "ord int, id string, name string, category string, tool string, arguments string, severity string"


def payloads(spark: SparkSession) -> DataFrame:
    expected = F.when(F.col("id").isin(*REDACTED), "redact").otherwise("block")
    return spark.createDataFrame(payload_rows(), PAYLOAD).withColumns({"args": F.from_json("arguments", "map<string,string>"), "expected_behavior": expected})


def tool_result(tool: Column, args: Column) -> Column:
    """What the synthetic tools answer: the text that a result carries; null for unknown tools or missing arguments."""
    content = F.coalesce(*[F.when(args["path"] == p, F.lit(t)) for p, t in FILES.items()], F.concat(F.lit("File contents of "), args["path"]))
    return (
        F.when((tool == "email_send") & args["to"].isNotNull() & args["subject"].isNotNull() & args["body"].isNotNull(), F.concat(F.lit("sent:"), args["to"], F.lit(":"), args["subject"]))
        .when(tool == "shell_exec", F.concat(F.lit("[mock] executed: "), args["command"]))
        .when(tool == "file_read", content)
    )


def error_code(tool: Column, args: Column) -> Column:
    """The synthetic tools' error: -32601 for an unknown tool, -32602 for arguments that are missing, else null."""
    wrong = F.coalesce(*[F.when(tool == t, F.array_contains(F.array(*[args[p].isNull() for p in props]), True)) for t, props in TOOLS])
    return F.when(~tool.isin([t for t, _ in TOOLS]), -32601).when(wrong, -32602).cast("int")


def status(error: Column, safe: Column, text: Column) -> Column:
    """An attack's outcome from its response: error, safe-scan marker, redaction mark, in this order."""
    return F.when(error.isNotNull(), "blocked").when(safe, "safe").when(text.contains("[REDACTED"), "redacted").otherwise("passed")


def classified(body: Column) -> Column:
    """An attack's outcome from the JSON of its response. An error that is not null is a block; a member of the result whose name starts
    with _ may say that it was only evaluated; a redaction counts in a result that is text, or in its members that are."""
    v = F.try_parse_json(body)
    error, result = F.try_variant_get(v, "$.error", "variant"), F.try_variant_get(v, "$.result", "variant")
    members = F.coalesce(F.from_json(F.when(F.schema_of_variant(result).startswith("OBJECT"), F.to_json(result)), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    safe = F.exists(F.map_entries(members), lambda e: e["key"].startswith("_") & ~F.lower(F.coalesce(F.try_variant_get(e["value"], "$.safe_scan", "string"), F.lit(""))).isin("", "false", "0", "0.0", "[]", "{}"))
    marked = F.exists(F.map_values(members), lambda x: (F.schema_of_variant(x) == "STRING") & F.try_variant_get(x, "$", "string").contains("[REDACTED"))
    text = F.when(F.schema_of_variant(result) == "STRING", F.try_variant_get(result, "$", "string").contains("[REDACTED"))
    failed = F.when(error.isNotNull() & ~F.is_variant_null(error), F.lit(-1))
    return F.when(failed.isNotNull(), "blocked").when(safe, "safe").when(F.coalesce(text, F.lit(False)) | marked, "redacted").otherwise("passed")


def outcome(decided: DataFrame, safe: bool = False) -> DataFrame:
    """``decided`` (tool, args, critical, action) with ``status`` of the response that each call gets."""
    blocked = F.col("critical") | (F.col("action") == "BLOCK")
    return decided.withColumn("response", F.when(~blocked & ~F.lit(safe), redacted(tool_result(F.col("tool"), F.col("args"))))).withColumn(
        "status", status(F.when(blocked, F.lit(-32001)), F.lit(safe), F.coalesce("response", F.lit("")))
    )


def counts(results: DataFrame, *by: str) -> DataFrame:
    """total, blocked, redacted, safe, passed and score of outcomes."""
    each = [F.count_if(F.col("status") == s).alias(s) for s in ("blocked", "redacted", "safe", "passed")]
    out = results.groupBy(*by).agg(F.count("*").alias("total"), *each)
    return out.withColumn("score", F.when(F.col("total") == 0, 0.0).otherwise(F.bround(F.col("passed") * 100.0 / F.col("total"), 1)))


def band(score: Column) -> Column:
    return F.when(score <= 20, "SECURE").when(score <= 50, "MODERATE RISK").when(score <= 80, "HIGH RISK").otherwise("CRITICAL")


def label(status: Column) -> Column:
    return F.when(status == "safe", "[=] SAFE OK").when(status == "blocked", "[+] BLOCKED").when(status == "redacted", "[~] REDACTED").otherwise("[!] VULNERABLE")


def generated_rules(failed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A rule for each failed attack (id, category, tool, args): name, tool, action, message, field, patterns, and the columns ``keep`` of the attack;
    unknown categories have none."""
    args, category = F.col("args"), F.col("category")
    body, command, path = (F.coalesce(args[f], F.lit("")) for f in ("body", "command", "path"))

    def first(text, kind, lower=False, take=1):
        return F.coalesce(*[F.when((F.lower(text).contains(row[0].lower()) if lower else text.contains(row[0])), row[take]) for row in KEYWORDS[kind]], F.lit(None))

    words = escaped(F.array_join(F.slice(F.split(F.trim(body), r"\s+"), 1, 4), " "))
    injection = F.when(matches(body, [BASE64]), BASE64).otherwise(F.coalesce(first(body, "prompt_injection", True), words))
    leak = F.when(F.col("tool") == "file_read", F.array(escaped(F.element_at(F.split(path, "/"), -1)))).otherwise(F.array(F.lit(r"\d{3}-\d{2}-\d{4}"), F.lit(r"4\d{3}[-\s]?\d{4}")))

    says = F.when(matches(body, [BASE64]), "base64-encoded prompt injection").otherwise(F.coalesce(first(body, "prompt_injection", True, 2), F.lit("prompt injection")))
    leaks = F.when(F.col("tool") == "file_read", F.concat(F.lit("reads of "), F.element_at(F.split(path, "/"), -1))).otherwise("emails containing SSN or credit card numbers")

    def rule(tool, field, patterns, blocks):
        return F.struct(tool.alias("tool"), field.alias("field"), patterns.alias("patterns"), F.concat(F.lit("blocks "), blocks).alias("message"))

    shell, of_file = (F.lit("shell_exec"), F.lit("command")), F.col("tool") == "file_read"
    row = (
        F.when(category == "prompt_injection", rule(F.lit("email_send"), F.lit("body"), F.array(injection), F.concat(says, F.lit(" in email body"))))
        .when(category == "data_exfiltration", rule(*shell, F.array(first(command, "data_exfiltration")), first(command, "data_exfiltration", take=2)))
        .when(category == "privilege_escalation", rule(*shell, F.array(first(command, "privilege_escalation")), first(command, "privilege_escalation", take=2)))
        .when(category == "pii_leak", rule(F.when(of_file, "file_read").otherwise("email_send"), F.when(of_file, "path").otherwise("body"), leak, leaks))
    )
    made = failed.select(*keep, "ord", F.concat(F.lit(GENERATED), "id").alias("name"), row.alias("_r")).where("_r is not null")
    return made.select(*keep, "ord", "name", "_r.tool", F.lit("BLOCK").alias("action"), "_r.message", "_r.field", "_r.patterns")


def tools(spark: SparkSession) -> DataFrame:
    """name and properties (array of names, in order)."""
    return spark.createDataFrame(TOOLS, "name string, properties array<string>")


def discovered(responses: DataFrame, body: str = "body") -> DataFrame:
    """name and schema (JSON) of the tools with a name that responses list, in order, beside the other columns; an answer with an error or without a list fails the job."""
    v = F.try_parse_json(body)
    error, listed = F.try_variant_get(v, "$.error", "string"), F.try_variant_get(v, "$.result.tools", "array<variant>")
    wrong = ~F.coalesce(error, F.lit("")).isin("", "false", "0", "{}", "[]") | listed.isNull()
    text = F.when(wrong, F.raise_error(F.lit("no list of tools"))).otherwise(F.get_json_object(body, "$.result.tools"))
    kept = responses.drop(body, "name", "schema")
    t, listing = free(kept, "t", "listing")
    # the text is a column of its own, where the body is parsed once for both conditions; in a generator it would be for each
    one = F.explode(F.from_json(listing, "array<struct<name variant, inputSchema string>>"))
    named = responses.select(*kept.columns, text.alias(listing)).select(*kept.columns, one.alias(t)).where(F.schema_of_variant(f"{t}.name") == "STRING")
    return named.select(*kept.columns, F.try_variant_get(f"{t}.name", "$", "string").alias("name"), F.col(f"{t}.inputSchema").alias("schema"))


def string_properties(schema: Column) -> Column:
    """Names of a schema's (JSON) properties that are strings or of no stated type, in order; what is no object has none."""
    each = F.from_json(F.get_json_object(schema, "$.properties"), "map<string,variant>")
    kind = lambda e: F.try_variant_get(e["value"], "$.type", "string")
    object_ = lambda e: F.coalesce(F.schema_of_variant(e["value"]).startswith("OBJECT"), F.lit(False))
    found = F.filter(F.map_entries(each), lambda e: object_(e) & F.coalesce(kind(e) == "string", F.lit(True)))
    return F.coalesce(F.transform(found, lambda e: e["key"]), F.array().cast("array<string>"))


def required(schema: Column) -> Column:
    """Names of a schema's required properties."""
    return F.coalesce(F.from_json(F.get_json_object(schema, "$.required"), "array<string>"), F.array().cast("array<string>"))


def with_defaults(args: Column, properties: Column, needed: Column) -> Column:
    """``args`` and, for each property that is needed and not there, the value test. All three are worked out once a row, whatever they are made of."""

    def filled(x):
        lacking = F.filter(x["properties"], lambda p: F.array_contains(x["needed"], p) & ~F.map_contains_key(x["args"], p))
        return F.map_concat(x["args"], F.map_from_entries(F.transform(lacking, lambda p: F.struct(p, F.lit("test")))))

    return bound(F.struct(args.alias("args"), properties.alias("properties"), needed.alias("needed")), filled)


def dynamic_payloads(catalogue: DataFrame) -> DataFrame:
    """Probes from tools' string properties (name, properties): by the property's name, and one injection for each tool; ids are unique.

    Needed properties (the column ``needed``; by default all) get a value.
    """
    if "needed" not in catalogue.columns:
        catalogue = catalogue.withColumn("needed", F.col("properties"))
    def as_probe(kind, value, category, severity):
        return F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"), F.lit(category).alias("category"), F.lit(severity).alias("severity"))

    each = catalogue.select("name", "properties", "needed", F.explode("properties").alias("p")).withColumn("l", F.lower("p"))
    probe = (
        F.when(F.col("l").isin(*COMMAND_NAMES), as_probe("cmd", PROBES["cmd"], "data_exfiltration", "critical"))
        .when(F.col("l").isin(*PATH_NAMES), as_probe("path", PROBES["path"], "privilege_escalation", "high"))
        .when(F.col("l") == "url", as_probe("path", PROBES["url"], "privilege_escalation", "high"))
    )
    named = each.withColumn("x", probe).where("x is not null").select("name", "properties", "needed", "p", "x")
    target = F.coalesce(F.get(F.filter("properties", lambda p: F.lower(p).isin(*BODY_NAMES)), F.lit(0)), F.get("properties", F.lit(0)))
    injected = catalogue.where(F.size("properties") > 0).select("name", "properties", "needed", target.alias("p"), as_probe("pi", PROBES["pi"], "prompt_injection", "critical").alias("x"))
    args = with_defaults(F.create_map("p", "x.value"), F.col("properties"), F.col("needed"))
    return named.unionByName(injected).select(F.concat_ws("-", F.lit("dyn"), "x.kind", "name", "p").alias("id"), "x.category", F.col("name").alias("tool"), "x.severity", args.alias("args")).dropDuplicates(["id"])


def mapped_tools(wanted: DataFrame, served: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``wanted`` (tool) with ``server_tool``: exact, without regard to case, similar (``similar_names``), or by hint; else null. ``served``: pos, name.

    ``by``: columns of both that say whose tools they are. All steps are equi-joins of distinct names; of several names that serve, one by its place.
    """
    own = [F.col(c) for c in by]
    (name,) = free(wanted, "server_tool") if "server_tool" not in wanted.columns else ("server_tool",)
    asked = wanted.where("tool is not null").select(*own, "tool").distinct()
    names = served.where("name is not null").select(*own, "pos", "name").distinct()
    exact = names.select(*own, F.col("name").alias("tool"), F.col("name").alias("exact")).distinct()
    folded = names.groupBy(*own, F.lower("name").alias("lower")).agg(F.max_by("name", "pos").alias("folded"))
    normal = names.groupBy(*own, normalised_tool(F.col("name")).alias("normal")).agg(F.min_by("name", "pos").alias("similar"))
    close = similar_names(asked.select(*own, normalised_tool(F.col("tool")).alias("name")).distinct(), normal.select(*own, F.col("normal").alias("name")), by)
    hints = F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(h).alias("hint")) for t, hs in HINTS.items() for h in hs])
    hinted = names.select(*own, "pos", "name", F.inline(hints)).where(F.lower("name").contains(F.col("hint"))).groupBy(*own, "tool").agg(F.min_by("name", "pos").alias("hinted"))
    keys = list(by)
    similar = close.join(normal, [*keys, "normal"]).select(*keys, F.col("name").alias("_asked"), "similar") if by else close.join(normal, "normal").select(F.col("name").alias("_asked"), "similar")
    found = (
        asked.withColumns({"_asked": normalised_tool(F.col("tool")), "lower": F.lower("tool")}).join(exact, [*keys, "tool"], "left").join(folded, [*keys, "lower"], "left")
        .join(similar, [*keys, "_asked"], "left").join(hinted, [*keys, "tool"], "left").select(*keys, "tool", F.coalesce("exact", "folded", "similar", "hinted").alias(name))
    )
    return wanted.drop(name).join(found, [*keys, "tool"], "left")


#: How alike two names are at least: twice the length of what their longest common parts, taken in turn, have in common, by both lengths.
ALIKE = 0.55


def similar_names(asked: DataFrame, names: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """name (of ``asked``), normal (the most similar name of ``names``; of equally similar ones the last in order) and ratio, for those of at least ``ALIKE``.

    What two names have in common is at most what their letters have, counted with repetitions. Each letter with its number is a token;
    names that are alike share one of their rarest, so that only these are joined (a prefix filter: nothing is lost). Of the pairs, those stay
    whose lengths and letters allow the ratio; it is worked out for these alone.
    """
    own = [F.col(c) for c in by]

    def tokens(df):
        letters = F.split("name", "")
        numbered = F.transform(letters, lambda x, i: F.concat(x, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
        return df.where("name <> ''").select(*own, "name", numbered.alias("tokens"))

    a, b = tokens(asked), tokens(names)
    # letters with numbers: as many as there are letters, times the length of the longest name
    rare = a.select(F.explode("tokens").alias("t")).unionAll(b.select(F.explode("tokens").alias("t"))).groupBy("t").agg(F.count("*").alias("n"))

    def rarest(df, name):
        spread = df.select(*own, "name", F.size("tokens").alias("size"), F.explode("tokens").alias("t")).join(rare, "t")
        order = F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"])
        least = F.ceil(F.col("size") * ALIKE / (2 - ALIKE) - 1e-9).cast("int")  # in common with the shortest name that may be alike
        kept = spread.groupBy(*own, "name", "size").agg(order.alias("order"))
        return kept.select(*own, F.col("name").alias(name), F.col("size").alias(f"{name}_size"), F.explode(F.slice("order", F.lit(1), F.col("size") - least + 1)).alias("t"))

    pairs = rarest(a, "name").join(rarest(b, "normal"), [*by, "t"]).where(2 * F.least("name_size", "normal_size") >= (ALIKE - 1e-9) * (F.col("name_size") + F.col("normal_size"))).select(*own, "name", "normal").distinct()
    both = pairs.join(a.withColumnRenamed("tokens", "x"), [*by, "name"]).join(b.select(*own, F.col("name").alias("normal"), F.col("tokens").alias("y")), [*by, "normal"])
    may = both.where(2 * F.size(F.array_intersect("x", "y")) >= (ALIKE - 1e-9) * (F.size("x") + F.size("y")))

    @F.pandas_udf("double")
    def ratio(name: pd.Series, normal: pd.Series) -> pd.Series:
        match = difflib.SequenceMatcher()
        out = []
        for x, y in zip(name, normal, strict=True):
            if match.b != x:
                match.set_seq2(x)
            match.set_seq1(y)
            out.append(match.ratio())
        return pd.Series(out, dtype="float64")

    found = may.select(*own, "name", "normal", ratio("name", "normal").alias("ratio")).where(F.col("ratio") >= ALIKE)
    return found.groupBy(*own, "name").agg(F.max(F.struct("ratio", "normal")).alias("best")).select(*own, "name", "best.normal", "best.ratio")
