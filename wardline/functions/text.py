"""Patterns over text as Columns. Patterns are literals, so each is compiled once a task."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalogue import DESCRIPTIONS, INJECTION, PII, PII_KINDS

#: Case-insensitive, Unicode classes, line feed as the only line end: what the rules' authors expect of their patterns.
DIALECT = "(?iUd)"


def matches(x: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found in ``x``; null counts as the empty text."""
    return reduce(Column.__or__, [F.coalesce(x, F.lit("")).rlike(DIALECT + p) for p in patterns], F.lit(False))


def _finding(severity: str, name: str, field, said: Column, pattern: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("pattern"), F.lit(field).alias("field"), said.alias("description"), F.lit(pattern).alias("matched_pattern"))


def findings(x: Column, field, tool: Column | None = None) -> Column:
    """The injection patterns that are found in ``x``: array of severity, name, field (where it is), description and pattern."""
    tool = F.lit("text") if tool is None else tool
    each = [F.when(matches(x, [p]), _finding(s, n, field, F.concat(F.lit(f"{DESCRIPTIONS[n]} in "), F.coalesce(tool, F.lit(""))), p)) for s, n, p in INJECTION]
    return F.filter(F.array(*each), lambda f: f.isNotNull())


def redaction_findings(x: Column, field, tool: Column | None = None, kinds=PII) -> Column:
    """A finding, as ``findings`` has them, for each match that the redaction of ``x`` replaces."""
    tool = F.lit("text") if tool is None else tool
    each = [
        F.array_repeat(_finding("medium", PII_KINDS.get(label, label.lower()), field, F.concat(F.lit("PII detected in "), F.coalesce(tool, F.lit("")), F.lit(f": {PII_KINDS.get(label, label.lower())}")), p), F.coalesce(n, F.lit(0)))
        for (label, p), n in zip(kinds, redaction_counts(x, kinds), strict=True)
    ]
    return F.flatten(F.array(*each))


def redacted(x: Column, kinds=PII) -> Column:
    """``x`` with each kind of personal data replaced, in order, each over what the last one left."""
    return reduce(lambda t, k: F.regexp_replace(t, DIALECT + k[1], f"[REDACTED-{k[0]}]"), kinds, x)


def redacted_leaves(x: Column, kind: T.DataType, kinds=PII) -> Column:
    """``x`` of type ``kind`` with every string leaf of its structs, arrays and map values redacted; names, keys and nulls stay."""
    if isinstance(kind, T.StringType):
        return redacted(x, kinds)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: redacted_leaves(v, kind.elementType, kinds))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: redacted_leaves(v, kind.valueType, kinds))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[redacted_leaves(x.getField(f.name), f.dataType, kinds).alias(f.name) for f in kind.fields]))
    return x


def redacted_json(values: pd.Series) -> pd.Series:
    """For ``pandas_udf``: JSON texts of any shape with every string leaf redacted; what is no JSON is redacted as text.

    As Python reads JSON: numbers with a fraction are doubles, and the last of equal keys counts.
    """
    each = [(re.compile(p, re.I), f"[REDACTED-{label}]") for label, p in PII]

    def text(x):
        for p, label in each:
            x = p.sub(label, x)
        return x

    def walk(v):
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items()}
        return [walk(x) for x in v] if isinstance(v, list) else text(v) if isinstance(v, str) else v

    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(walk(json.loads(x)), separators=(",", ":"))
        except (ValueError, RecursionError):
            return text(x)

    return values.map(one)


#: Rows of JSON that are held as Python's texts at a time.
ROWS = 200


def with_redacted_json(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the text ``column`` redacted as ``redacted_json`` does. Of a batch, ``ROWS`` rows at a time are Python's texts, so that a worker's memory
    does not grow with what batches hold."""
    place = df.columns.index(column)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                done = redacted_json(pd.Series(part.column(place).to_pylist(), dtype="object"))
                yield part.set_column(place, part.schema.field(place), pa.array(done.tolist(), part.schema.field(place).type))

    return df.mapInArrow(run, df.schema)


def redaction_counts(x: Column, kinds=PII) -> list[Column]:
    """How many matches of each kind the redaction of ``x`` replaces."""
    return [F.regexp_count(redacted(x, kinds[:k]), F.lit(DIALECT + p)).alias(label.lower()) for k, (label, p) in enumerate(kinds)]


def domain(x: Column) -> Column:
    """What stands behind the last @, trimmed and in lower case; null without one."""
    return F.when(x.contains("@"), F.nullif(F.lower(F.trim(F.substring_index(F.trim(x), "@", -1))), F.lit("")))


def escaped(x: Column) -> Column:
    """``x`` as a pattern that matches it."""
    return F.regexp_replace(x, r"([\\.^$*+?{}\[\]|()\-&~# \t\n\r\x0B\f])", r"\\$1")


def normalised_tool(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[-_]+", "")


def flag(x: Column) -> Column:
    """Whether a header says yes."""
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "on"), F.lit(False))


def shortened(x: Column, most: int = 500) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def health_url(x: Column) -> Column:
    """The first /mcp of a URL as /health, else /health of its host, else null."""
    root = F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(x.contains("/mcp"), F.regexp_replace(x, r"^(.*?)/mcp", "$1/health")).when(root != "", F.concat(root, F.lit("/health")))


def cell(x: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.regexp_replace(F.regexp_replace(x, r"\|", r"\\|"), "\n", " ")
