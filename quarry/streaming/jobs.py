"""Streaming forms (T1, T3, T8-T10): admission with state, trace rollup with a watermark, rules, and ingestion by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.ingest import chunk_documents
from ..operators.operations import WINDOW_SECONDS, Limiter, trace_rollup
from ..operators.rules import check_answers, classify_routes
from ..sources.tables import BUCKETS, read_replaced, replace_on_disk


#: State of processors is kept by this store; the default one has no column families.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_SECONDS = 2 * 86400
DECISIONS = "client long, request_id long, ts timestamp, second double, decision string, retry_after double"


def _ordered(frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """The columns' values of a key's rows in a batch, in order; no frame is held."""
    return sorted(row for f in frames for row in zip(*(f[c].tolist() for c in columns), strict=True))


class ClientLimits(StatefulProcessor):
    """A client's accepted requests of the last window, and how many it had on its last day; both go when it has been idle for two days."""

    def __init__(self, per_window: int, per_day: int, window: float):
        self.limits = per_window, per_day, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "second double")
        self.today = handle.getValueState("today", "day long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        day, n = self.today.get() if self.today.exists() else (-1, 0)
        own = Limiter(*self.limits, [x[0] for x in self.recent.get()], day, n)
        found = _ordered(rows, "second", "request_id")
        said = [own.admit(t) for t, _ in found]
        self.recent.put([(t,) for t in own.recent]) if own.recent else self.recent.clear()
        self.today.update((own.day, own.today))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((found[-1][0] + IDLE_SECONDS) * 1000))
        second = [t for t, _ in found]
        yield pd.DataFrame({"client": key[0], "request_id": [i for _, i in found], "ts": pd.to_datetime([round(t * 1_000_000) for t in second], unit="us"), "second": second, "decision": [d for d, _ in said], "retry_after": [w for _, w in said]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.today.clear()
        yield pd.DataFrame({"client": pd.Series(dtype="int64"), "request_id": pd.Series(dtype="int64"), "ts": pd.Series(dtype="datetime64[ns]"), "second": pd.Series(dtype="float64"), "decision": pd.Series(dtype="object"), "retry_after": pd.Series(dtype="float64")})

    def close(self) -> None:
        pass


class DayBudget(StatefulProcessor):
    """How many requests of a day were let through; goes a day after its end."""

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n = self.spent.get()[0] if self.spent.exists() else 0
        found = _ordered(rows, "second", "request_id", "client", "decision", "retry_after")
        out = []
        for second, request, client, decision, wait in found:
            if n >= self.budget:
                decision, wait = "budget", (key[0] + 1) * 86400 - second
            n += decision == "accepted"
            out.append((client, request, second, decision, wait))
        self.spent.update((n,))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer((key[0] + 2) * 86_400_000)
        yield pd.DataFrame(out, columns=["client", "request_id", "second", "decision", "retry_after"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.spent.clear()
        yield pd.DataFrame({"client": pd.Series(dtype="int64"), "request_id": pd.Series(dtype="int64"), "second": pd.Series(dtype="float64"), "decision": pd.Series(dtype="object"), "retry_after": pd.Series(dtype="float64")})

    def close(self) -> None:
        pass


def _limited(requests: DataFrame, per_window: int, per_day: int, window: float, late: str) -> DataFrame:
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = requests.withWatermark("ts", late).select("client", "request_id", "ts", F.col("ts").cast("double").alias("second"))
    return timed.groupBy("client").transformWithStateInPandas(ClientLimits(per_window, per_day, window), DECISIONS, "append", "eventTime", eventTimeColumnName="ts")


def admit_stream(requests: DataFrame, per_window: int, per_day: int, window: float = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The batch fold as a stream (client, request_id, ts); a client idle for two days is forgotten by a timer.

    Requests of one batch are taken in order of time; rows later than the watermark are dropped before. The session's state
    store becomes RocksDB.
    """
    return _limited(requests, per_window, per_day, window, late).drop("ts")


def admit_within_budget_stream(requests: DataFrame, per_window: int, per_day: int, budget: int, window: float = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """As admit_stream, then one budget a day over all clients, by a second operator whose state is one count a day.

    From the budget-th accepted request of a day on, all of that day are refused. A client's own limits count what they let
    through, also after that; it is another day's count by then, so only requests right after midnight can meet it.
    """
    limited = _limited(requests, per_window, per_day, window, late).withColumn("day", F.floor(F.col("second") / 86400))
    return limited.groupBy("day").transformWithStateInPandas(DayBudget(budget), "client long, request_id long, second double, decision string, retry_after double", "append", "eventTime")


def confirmed_stream(proposals: DataFrame, confirms: DataFrame, valid: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Each confirmation (token, confirmed_at) with its proposal (token, scope, slot, proposed_at), if that was still valid.

    outcome: "open" for one in time; "expired" for one without a proposal of the ``valid`` time before it. The latter is known, and
    comes, once both watermarks have passed. What is later than its watermark isn't seen.
    """
    asked = proposals.withWatermark("proposed_at", late).select("token", "scope", "slot", "proposed_at")
    said = confirms.withWatermark("confirmed_at", late).select(F.col("token").alias("confirmed"), "confirmed_at")
    inside = (F.col("confirmed") == F.col("token")) & (F.col("confirmed_at") >= F.col("proposed_at")) & (F.col("confirmed_at") <= F.col("proposed_at") + F.expr(f"INTERVAL {valid}"))
    joined = said.join(asked, inside, "left_outer")
    return joined.select(F.col("confirmed").alias("token"), "scope", "slot", "proposed_at", "confirmed_at", F.when(F.col("token").isNull(), "expired").otherwise("open").alias("outcome"))


def trace_rollup_stream(traces: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """The trace rollup of each route and hour; created_at must be a timestamp."""
    return trace_rollup(traces.withWatermark("created_at", late), [F.window("created_at", every).alias("window"), "route"])


def classified_stream(messages: DataFrame) -> DataFrame:
    """Routes of messages as they come."""
    return classify_routes(messages)


def checked_stream(answers: DataFrame) -> DataFrame:
    """Answers checked as they come."""
    return check_answers(answers)


def ingest_batches(target: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's documents take the place of what the target has of them; a document that is empty now has no chunks.

    Only the target's folders of these documents are rewritten, and a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        replace_on_disk(chunk_documents(batch), batch.select("doc_id"), target, "doc_id", buckets)

    return write


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of all documents as they are now."""
    return read_replaced(spark, target, "doc_id")
