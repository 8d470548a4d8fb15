"""The library in SQL: functions and a table function of a session, for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..catalogue import DESCRIPTIONS, INJECTION, PII
from .sanitise import sanitiser
from .text import DIALECT


def _quoted(x: str) -> str:
    return "r'" + x + "'" if "'" not in x else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _redacted(x: str, kinds) -> str:
    for label, p in kinds:
        x = f"regexp_replace({x}, {_quoted(DIALECT + p)}, '[REDACTED-{label}]')"
    return x


def _any(x: str, patterns) -> str:
    return " OR ".join(f"coalesce({x}, '') RLIKE {_quoted(DIALECT + p)}" for p in patterns)


class Inspect:
    """severity, pattern, field, description and matched_pattern of each injection pattern in each string leaf of a JSON text.

    ``inspect_json(json, tool => 'name', least => 'critical')``: findings of at least that severity; both are constants and may be left out.
    """

    RANK = ("low", "medium", "high", "critical")

    @staticmethod
    def analyze(json: AnalyzeArgument, tool: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(json.dataType, (T.StringType, T.NullType)):
            raise ValueError("inspect_json needs a text")
        if least is not None and (not least.isConstantExpression or least.value not in Inspect.RANK):
            raise ValueError(f"least is one of {', '.join(Inspect.RANK)}")
        return AnalyzeResult(T.StructType([T.StructField(n, T.StringType()) for n in ("severity", "pattern", "field", "description", "matched_pattern")]))

    def __init__(self):
        import re

        self.each = [(s, n, p, re.compile(p, re.IGNORECASE)) for s, n, p in INJECTION]

    def eval(self, json: str, tool: str = "text", least: str = "low"):
        from .leaves import _walk

        if json is None:
            return
        for path, kind, value in _walk(json):
            if kind == "STRING":
                for severity, name, said, pattern in self.each:
                    if self.RANK.index(severity) >= self.RANK.index(least) and pattern.search(value):
                        yield severity, name, path.removeprefix("$").removeprefix("."), f"{DESCRIPTIONS[name]} in {tool}", said


def register(spark: SparkSession) -> None:
    """For this session: the scalar functions ``redacted(text)``, ``has_personal_data(text)``, ``is_suspicious(text)``, ``is_critical(text)``,
    ``mail_domain(text)`` and ``tool_name(text)``, which are SQL and so take part in optimisation; ``sanitised(json, tool)``, a struct of text and findings;
    and the table function ``inspect_json``."""
    kinds = {"redacted": ("STRING", _redacted("x", PII)), "has_personal_data": ("BOOLEAN", _any("x", [p for _, p in PII])), "is_suspicious": ("BOOLEAN", _any("x", [p for *_, p in INJECTION]))}
    kinds["is_critical"] = "BOOLEAN", _any("x", [p for s, _, p in INJECTION if s == "critical"])
    kinds["mail_domain"] = "STRING", "CASE WHEN contains(x, '@') THEN nullif(lower(trim(substring_index(trim(x), '@', -1))), '') END"
    kinds["tool_name"] = "STRING", "regexp_replace(lower(x), '[-_]+', '')"
    for name, (kind, body) in kinds.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    spark.udtf.register("inspect_json", F.udtf(Inspect))
    spark.udf.register("sanitised", sanitiser(PII, "result"))
