"""Streams of requests and responses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import redacted
from ..operators import policy
from ..plans.pipeline import decided
from ..sources import messages


def decisions(requests: DataFrame) -> DataFrame:
    """Stateless: a stream of calls with the decision on each."""
    return decided(requests)


def counters(requests: DataFrame, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Counts by action for windows of event time."""
    return decided(requests).withWatermark("ts", delay).groupBy(F.window("ts", window).alias("window"), "action").count()


def correlated(requests: DataFrame, responses: DataFrame, delay: str = "10 minutes", timeout: str = "20 seconds") -> DataFrame:
    """Stream-stream left join on (session_id, id): each request with its response's redacted text, or, once the watermark has
    passed the timeout, with a null text and the error code of an unanswered request. State is bounded by delay and timeout.
    """
    a = requests.select("session_id", "id", "tool", F.col("ts").alias("asked")).withWatermark("asked", delay)
    b = responses.select(F.col("session_id").alias("r_session"), F.col("id").alias("r_id"), F.col("ts").alias("answered"), "text").withWatermark("answered", delay)
    on = F.expr(f"session_id = r_session AND id = r_id AND answered >= asked AND answered <= asked + interval {timeout}")
    return a.join(b, on, "leftOuter").select("session_id", "id", "tool", "asked", "answered", redacted(F.col("text")).alias("text"), F.when(F.col("answered").isNull(), -32000).alias("code"))


def totals(requests: DataFrame) -> DataFrame:
    """Counts by action since the query's start, for the output modes complete and update; state is a number an action."""
    return decided(requests).groupBy("action").count()


def guarded(path: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: decide each batch of calls by the policy file as it is then, and hand it to ``write``.

    A changed file holds from the next batch on. The rules become literals of the batch's plan.
    """
    def run(batch: DataFrame, number: int) -> None:
        write(decided(batch, policy.valid(messages.policy(path), batch.sparkSession)), number)

    return run


def paired(events: DataFrame, delay: str = "10 minutes", timeout_s: int = 20) -> DataFrame:
    """Requests and responses of one stream, paired by state: session_id, id, tool, text and code.

    ``events``: session_id, id, seq, ts, tool (null for a response), text. A request waits under (session_id, id), a later one of the
    same id takes its place, and the first response takes it away: that response's text is redacted. A response that no request waits for
    passes as it is, without a tool. What waits longer than ``timeout_s`` (by watermark) is given up with an error code. Each id is a
    group of its own, so that one busy session is spread over all tasks; state is one name a waiting request.
    """
    def step(key, batches, state):
        if state.hasTimedOut:
            (tool,) = state.get
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "id": [key[1]], "tool": [tool], "text": [None], "code": [-32000]})
            return
        waiting, until = (state.get[0], None) if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            if isinstance(r.tool, str):
                waiting, until = r.tool, int(r.ts.timestamp() * 1000) + timeout_s * 1000
            else:
                out.append((*key, waiting, r.text, None))
                waiting = None
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update((waiting,))
            if until is not None:
                state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "id", "tool", "text", "code"])

    out = "session_id string, id long, tool string, text string, code int"
    marked = events.withWatermark("ts", delay).groupBy("session_id", "id").applyInPandasWithState(step, out, "tool string", "append", GroupStateTimeout.EventTimeTimeout)
    return marked.withColumn("text", F.when(F.col("tool").isNotNull(), redacted(F.col("text"))).otherwise(F.col("text")))
