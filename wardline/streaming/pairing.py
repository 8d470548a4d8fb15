"""Requests and responses of one stream, paired by state with timers that survives restarts and can begin with what a batch left waiting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import redacted
from ..operators.proxy import UNANSWERED

OUT = "session_id string, id string, seq long, tool string, text string, error string, code int"
#: What a request leaves behind: its place, its tool, and until when (in milliseconds of event time) it waits.
WAITING = "seq long, tool string, until long"
#: The state store that timers and typed state need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def enable(spark: SparkSession) -> None:
    spark.conf.set(*STORE)


class Pairing(StatefulProcessor):
    """One waiting request for each session and id. A later request takes an earlier one's place; the first response takes it away."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", WAITING)

    def _wait(self, seq: int, tool: str, at_ms: int, watermark: int) -> None:
        until = max(at_ms + self.timeout_ms, watermark + 1)
        self.waiting.update((seq, tool, until))
        self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        held = self.waiting.get() if self.waiting.exists() else None
        waits = (held[0], held[1], None) if held else None
        every = pd.concat(list(rows))
        # at one place, the request comes first
        for r in every.assign(answer=every["tool"].isna()).sort_values(["seq", "answer"], kind="stable").itertuples():
            if isinstance(r.tool, str):
                waits = (r.seq, r.tool, int(r.ts.timestamp() * 1000))
            else:
                out.append((key[0], key[1], r.seq, waits[1] if waits else None, r.text, r.error, None))
                waits = None
        if waits is None or waits[2] is not None:
            if held:
                self.handle.deleteTimer(held[2])
                self.waiting.clear()
            if waits:
                self._wait(*waits, now)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.waiting.exists():
            seq, tool, until = self.waiting.get()
            if until <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], key[1], seq, tool, None, None, UNANSWERED))
                self.waiting.clear()
        yield self._rows(out)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.sort_values("seq", kind="stable").iloc[-1]
        self._wait(int(last["seq"]), last["tool"], int(last["ts"].timestamp() * 1000), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        x = pd.DataFrame(rows, columns=["session_id", "id", "seq", "tool", "text", "error", "code"])
        return x.astype({"seq": "int64", "code": "Int32", **dict.fromkeys(["session_id", "id", "tool", "text", "error"], "object")})


def paired(events: DataFrame, delay: str = "10 minutes", timeout_s: int = 20, waiting: DataFrame | None = None) -> DataFrame:
    """session_id, id, seq, tool, text, error and code: a row for each response, with the tool of the request that it answers (null: none) and its text,
    redacted unless it is an error or answers nothing; and one with the code of an unanswered request for each that has waited ``timeout_s``
    (by watermark).

    ``events``: session_id, id, seq, ts, tool (null: a response), text and error. Ids are JSON texts: 1 and "1" are two ids. ``waiting``: session_id, id, seq,
    tool and ts of requests that wait already, of a batch. A session and an id are a key together, so that a busy session is spread over all
    tasks; state is one short row a waiting request. The session needs ``enable``.
    """
    columns = ["session_id", "id", "seq", "ts", "tool", "text", "error"]
    keyed = events.select(*columns).withWatermark("ts", delay).groupBy("session_id", "id")
    first = waiting.select("session_id", "id", "seq", "tool", "ts").groupBy("session_id", "id") if waiting is not None else None
    x = keyed.transformWithStateInPandas(Pairing(timeout_s * 1000), OUT, "Append", "EventTime", first)
    told = F.when(F.col("tool").isNotNull() & F.col("error").isNull(), redacted(F.col("text"))).otherwise(F.col("text"))
    return x.withColumn("text", told)
