"""Responses and the requests that they answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redacted

KEY = ("session_id", "id")


def first_responses(responses: DataFrame) -> DataFrame:
    """Of each (session, id) the response that arrived first (by seq)."""
    w = Window.partitionBy(*KEY).orderBy("seq")
    return responses.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _timeline(requests: DataFrame, responses: DataFrame, waits: Column | None = None) -> DataFrame:
    """Requests and responses of each (session, id) in one order, with the seq of the last of either kind before each.

    Without ``seq``, requests come before responses. One shuffle, by (session, id), for both. Requests for which ``waits`` isn't true are left out.
    """
    def part(df, asks):
        seq = F.col("seq").cast("long") if "seq" in df.columns else F.lit(0 if asks else 1).cast("long")
        text, error = (F.lit(None).cast("string") if asks or c not in df.columns else F.col(c).cast("string") for c in ("text", "error"))
        rows = [*map(F.col, KEY), seq.alias("seq"), F.lit(asks).alias("asks"), (F.col("tool") if asks else F.lit(None).cast("string")).alias("tool"), text.alias("text"), error.alias("error")]
        return df.select(F.inline(F.when(waits, F.array(F.struct(*rows))))) if asks and waits is not None else df.select(*rows)

    w = Window.partitionBy(*KEY).orderBy("seq", F.col("asks").desc())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.struct("tool", "seq"), F.when(F.col("asks"), F.struct("seq", "tool"))).over(before)
    answered = F.max(F.when(~F.col("asks"), F.col("seq"))).over(before)
    return part(requests, True).unionByName(part(responses, False)).withColumns({"_asked": last, "_answered": answered, "_next": F.lead("asks").over(w)})


def met(requests: DataFrame, responses: DataFrame, waits: Column | None = None) -> DataFrame:
    """session_id, id, seq, tool, text and error of ``responses``, with the tool of the request that each answers: the last one of its
    (session, id) before it (by seq), unless another response has taken that already.

    ``waits``: a condition on requests that others don't meet. It generates a row or none, since a filter on what is costly to know would be
    copied, with all it is made of, to where the requests are read."""
    t = _timeline(requests, responses, waits).where(~F.col("asks"))
    waiting = F.col("_asked").isNotNull() & (F.col("_answered").isNull() | (F.col("_answered") <= F.col("_asked.seq")))
    return t.select(*KEY, "seq", F.when(waiting, F.col("_asked.tool")).alias("tool"), "text", "error")


def correlated(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``met`` without errors, where answers to a tool call are redacted; those that say an ``error`` (a column; null: none) and those to
    nothing pass as they are."""
    return met(requests, responses).select(*KEY, "seq", "tool", F.when(F.col("tool").isNotNull() & F.col("error").isNull(), redacted(F.col("text"))).otherwise(F.col("text")).alias("text"))


def orphans(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """session_id, id, tool and an error code of requests that still wait at the end. A later request of the same id takes an earlier one's place."""
    return _timeline(requests, responses).where(F.col("asks") & F.col("_next").isNull()).select(*KEY, "tool", F.lit(-32000).alias("code"))
