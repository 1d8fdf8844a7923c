"""Operational jobs: cost, traces, admission and booking."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .records import choose_provider

# Booking and admission rules.
LEAD_DAYS, SLOT_MINUTES, MATCH_HOURS, WINDOW_SECONDS = 365, 30, 12, 60
#: Requests of a client that one task folds in a row.
WHOLE = 200_000


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """The cost of each row's tokens at its model's price a million; no price, no cost."""
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1_000_000
    return usage.join(prices, "model", "left").withColumn("cost_usd", F.round(cost, 8)).drop("input_price", "output_price")


def trace_rollup(traces: DataFrame, by: list[str | Column]) -> DataFrame:
    """Requests, failures, latency and cost of each route."""
    return traces.groupBy(*by).agg(F.count("*").alias("n"), F.count("error").alias("n_failed"), F.avg("total_ms").alias("mean_ms"), F.max("total_ms").alias("max_ms"), F.sum("input_tokens").alias("input_tokens"), F.sum("cost_usd").alias("cost_usd"))


def stage_rollup(traces: DataFrame) -> DataFrame:
    """The time of each stage of a map column."""
    return traces.select(F.explode("stage_ms").alias("stage", "ms")).groupBy("stage").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"))


def seconds_to_midnight(ts: Column) -> Column:
    """T4: until the day ends, in the session's time zone."""
    return (F.unix_timestamp(F.date_add(ts.cast("date"), 1).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))).cast("long")


class Limiter:
    """Accepted requests of one client in the last window and day; refused ones don't count."""

    def __init__(self, per_window: int, per_day: int, window: float = WINDOW_SECONDS, recent=(), day: int = -1, today: int = 0):
        self.per_window, self.per_day, self.window = per_window, per_day, window
        self.recent, self.day, self.today = deque(recent), day, today

    def admit(self, t: float) -> tuple[str, float]:
        """The decision on a request at second t, and after how many seconds to come back."""
        if (day := int(t // 86400)) != self.day:
            self.day, self.today = day, 0
        while self.recent and self.recent[0] <= t - self.window:
            self.recent.popleft()
        if self.per_day and self.today >= self.per_day:
            return "daily_limit", (day + 1) * 86400 - t
        if self.per_window and len(self.recent) >= self.per_window:
            return "window_limit", self.recent[0] + self.window - t
        self.recent.append(t)
        self.today += 1
        return "accepted", 0.0


DECIDED = "client long, request_id long, second double, decision string, retry_after double"


def admit(requests: DataFrame, per_window: int, per_day: int, window: float = WINDOW_SECONDS) -> DataFrame:
    """Each request (client, request_id, second) with its decision: an ordered fold over each client's requests.

    Clients with at most WHOLE requests are folded once, in order. One with more is cut where it pauses for longer than the window,
    for nothing but the day's count reaches across a pause; the parts are folded by tasks of their own, so a client with very many requests is spread. Pauses are found from counts of spans as long
    as the window, not from the requests in order. A first fold counts what each part lets through a day. Parts before which their
    first day's count isn't 0 are folded again from that count, until no count changes; without a part that meets the day's limit
    the first fold holds. A task sees one batch of rows at a time and holds one part's state.
    """
    rows = requests.select("client", "request_id", "second", F.lit(False).alias("closed"))
    return _folded_clients(rows, per_window, per_day, window)


def _folded_clients(rows: DataFrame, per_window: int, per_day: int, window: float) -> DataFrame:
    valid = rows.where("client is not null and second is not null")
    hot = valid.groupBy("client").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("client")
    if not hot.isEmpty():
        parts = _folded_parts(rows.join(hot, "client", "left_semi"), per_window, per_day, window)
        return parts.unionByName(_folded_once(rows.join(hot, "client", "left_anti"), per_window, per_day, window))
    return _folded_once(rows, per_window, per_day, window)


def _folded_once(rows: DataFrame, per_window: int, per_day: int, window: float) -> DataFrame:
    whole = rows.where("client is not null and second is not null").withColumns({"part": F.lit(0).cast("long"), "start": F.lit(0)})
    return written(_folded(whole, per_window, per_day, window), "admitted").drop("part").unionByName(_undecided(rows))


def _undecided(rows: DataFrame) -> DataFrame:
    return rows.where("client is null or second is null").select("client", "request_id", "second", F.lit(None).cast("string").alias("decision"), F.lit(None).cast("double").alias("retry_after"))


def _parts(rows: DataFrame, window: float) -> DataFrame:
    """The rows with ``part``, the span in which the client's last pause before them ended."""
    span = F.floor(F.col("second") / window).alias("span")
    spans = rows.groupBy("client", span).agg(F.min("second").alias("first"), F.max("second").alias("last"))
    order = Window.partitionBy("client").orderBy("span")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(order) > window, F.lit(True))
    heads = spans.withColumn("head", F.when(fresh, F.col("span"))).withColumn("part", F.max("head").over(order)).select("client", "span", "part")
    return rows.withColumn("span", span).join(heads, ["client", "span"]).drop("span")


def _folded_parts(rows: DataFrame, per_window: int, per_day: int, window: float) -> DataFrame:
    keyed = _parts(rows.where("client is not null and second is not null"), window)
    day = F.floor(F.col("second") / 86400).alias("day")
    firsts = keyed.groupBy("client", "part").agg(F.min(day).alias("day"))
    starts = None
    while True:
        begun = keyed.withColumn("start", F.lit(0)) if starts is None else keyed.join(starts, ["client", "part"], "left").fillna(0, ["start"])
        done = written(_folded(begun, per_window, per_day, window), "admitted")
        if not per_day:
            break
        taken = done.where("decision = 'accepted'").groupBy("client", day, "part").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("client", "day").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # a part without an accepted request has a count before it all the same
        counts = taken.join(firsts, ["client", "day", "part"], "full").fillna(0, ["n"]).withColumn("start", F.least(F.lit(per_day), before))
        found = written(counts.join(firsts, ["client", "day", "part"], "left_semi").where("start > 0").select("client", "part", "start"), "starts")
        if starts is None:
            # only a part that would go beyond the limit is decided otherwise
            over = found.join(taken.join(firsts, ["client", "day", "part"]), ["client", "part"]).where(F.col("start") + F.col("n") > per_day)
            if over.isEmpty():
                break
        elif found.exceptAll(starts).isEmpty() and starts.exceptAll(found).isEmpty():
            break
        starts = found
    return done.drop("part").unionByName(_undecided(rows))


def _folded(requests: DataFrame, per_window: int, per_day: int, window: float) -> DataFrame:
    """The fold of each client's parts, from ``start`` requests of the first day on; requests that are ``closed`` are refused by the day's budget and use nothing up."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, None
        for f in frames:
            decision, retry = [], []
            for who, part, t, start, closed in zip(f["client"], f["part"], f["second"], f["start"], f["closed"], strict=True):
                if own is None or (who, part) != key:
                    key, own = (who, part), Limiter(per_window, per_day, window, (), int(t // 86400), start)
                said, wait = ("budget", (int(t // 86400) + 1) * 86400 - t) if closed else own.admit(t)
                decision.append(said)
                retry.append(wait)
            yield f[["client", "request_id", "second", "part"]].assign(decision=decision, retry_after=retry)

    return requests.repartition("client", "part").sortWithinPartitions("client", "part", "second", "request_id").mapInPandas(fold, f"{DECIDED}, part long")


def admit_within_budget(requests: DataFrame, per_window: int, per_day: int, budget: int, window: float = WINDOW_SECONDS) -> DataFrame:
    """Admit, but no more than ``budget`` requests a day are accepted over all clients; the budget is asked first.

    What is refused uses up nothing. A day is closed from its budget-th accepted request on; as a closed day changes what the first
    requests of the next one meet, days are closed until no closing changes. One row a day is held.
    """
    spark = requests.sparkSession
    rows = requests.select("client", "request_id", "second")
    day = F.floor(F.col("second") / 86400).alias("day")
    closings: dict[int, tuple[float, int]] = {}
    while True:
        ends = spark.createDataFrame([(d, t, i) for d, (t, i) in closings.items()], "day long, end_second double, end_id long")
        closed = F.struct("second", "request_id") > F.struct(F.col("end_second").alias("second"), F.col("end_id").alias("request_id"))
        marked = rows.withColumn("day", day).join(F.broadcast(ends), "day", "left").select("client", "request_id", "second", (F.col("end_second").isNotNull() & closed).alias("closed"))
        decided = _folded_clients(marked, per_window, per_day, window)
        taken = decided.where("decision = 'accepted'").select(day, "second", "request_id")
        # the place in the day: counts of minutes first, then within the minute where the budget is reached
        minutes = taken.groupBy("day", F.floor(F.col("second") / 60).alias("minute")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("day").orderBy("minute"))
        last = minutes.withColumn("upto", upto).where((F.col("upto") >= budget) & (F.col("upto") - F.col("n") < budget)).select("day", "minute", (F.lit(budget) - (F.col("upto") - F.col("n"))).alias("place"))
        place = F.row_number().over(Window.partitionBy("day").orderBy("second", "request_id"))
        inside = taken.withColumn("minute", F.floor(F.col("second") / 60)).join(last, ["day", "minute"]).withColumn("at", place).where("at = place")
        new = {r["day"]: (r["second"], r["request_id"]) for r in inside.select("day", "second", "request_id").collect()}
        if new == closings:
            return decided
        closings = new


def admit_global(requests: DataFrame, budget: int) -> DataFrame:
    """T2 for requests that their clients' limits let through: whether one is among the first of its day. Counts of short spans are added up first, so no task sees a whole day."""
    rows = requests.withColumns({"day": F.floor(F.col("second") / 86400), "span": F.floor(F.col("second") / 60)})
    spans = rows.groupBy("day", "span").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("day").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(spans.withColumn("before", before).drop("n"), ["day", "span"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("day", "span").orderBy("second", "request_id"))
    return placed.withColumn("admitted", place <= budget).drop("before", "span", "day")


def snapped(ts: Column) -> Column:
    """The start of the half hour."""
    return F.date_trunc("hour", ts) + F.make_dt_interval(mins=(F.floor(F.minute(ts) / SLOT_MINUTES) * SLOT_MINUTES).cast("int"))


def lenient_timestamp(c: Column) -> Column:
    """An ISO time, or null."""
    return F.try_to_timestamp(c)


def clashes(requests: DataFrame, appointments: DataFrame) -> DataFrame:
    """Requests (scope, slot) whose slot holds a scheduled appointment."""
    taken = appointments.where("status = 'scheduled'").select("scope", snapped(F.col("appointment_date")).alias("slot")).distinct()
    return requests.join(taken, ["scope", "slot"], "left_semi")


def validate_bookings(requests: DataFrame, appointments: DataFrame, encounters: DataFrame, providers: DataFrame, now, types: list[str]) -> DataFrame:
    """T5: requests (request_id, scope, when, appointment_type) with slot, outcome, reason and provider."""
    rows = requests.withColumn("asked", lenient_timestamp(F.col("when"))).withColumn("slot", snapped(F.col("asked")))
    taken = appointments.where("status = 'scheduled'").select("scope", snapped(F.col("appointment_date").cast("timestamp")).alias("slot"), F.lit(True).alias("taken")).distinct()
    rows = rows.join(taken, ["scope", "slot"], "left")
    reason = F.when(F.col("asked").isNull(), "unparsable_time").when(F.col("slot") <= F.lit(now).cast("timestamp"), "in_the_past").when(F.datediff("slot", F.lit(now)) > LEAD_DAYS, "too_far_ahead").when(F.col("taken"), "slot_taken")
    rows = rows.withColumns({"reason": reason, "appointment_type": F.when(F.col("appointment_type").isin(types), F.col("appointment_type")).otherwise(types[0])}).withColumn("outcome", F.when(F.col("reason").isNull(), "proposed").otherwise("refused"))
    return choose_provider(rows.drop("taken", "asked"), encounters, providers)


def resolve_cancellations(requests: DataFrame, appointments: DataFrame, now) -> DataFrame:
    """The scheduled appointment that a cancellation (request_id, scope, near) means: within 12 hours, the earliest.

    Times are put into buckets of 12 hours; a request is joined with its scope's appointments of its own bucket and the two beside
    it, and the earliest is aggregated, so only what is a day apart at most meets.
    """
    width = MATCH_HOURS * 3600
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(second(c) / width)
    asked = requests.select("*", F.explode(F.array(*[bucket("near") + i for i in (-1, 0, 1)])).alias("_bucket"))
    open_ = appointments.where((F.col("status") == "scheduled") & (F.col("appointment_date") >= F.lit(now))).withColumn("_bucket", bucket("appointment_date"))
    both = asked.join(open_, ["scope", "_bucket"]).where(F.abs(second("near") - second("appointment_date")) <= width)
    rest = [c for c in both.columns if c not in ("request_id", "_bucket", "appointment_date", "id")]
    return both.groupBy("request_id").agg(F.min(F.struct("appointment_date", "id", *rest)).alias("row")).select("request_id", "row.*")


def not_yet_executed(confirms: DataFrame, audit: DataFrame) -> DataFrame:
    """Confirmations whose token the audit log hasn't executed."""
    return confirms.join(audit.where("outcome = 'executed'").select("token").distinct(), "token", "left_anti")


def check_confirms(confirms: DataFrame, appointments: DataFrame, audit: DataFrame, now) -> DataFrame:
    """Confirmations (token, scope, slot, expires_at, ...) each on its own, against what is booked: expired, repeated, slot_taken or executed.

    A token counts once, by its earliest (slot, expires_at). Others of the same table aren't looked at; ``apply_confirms`` does that.
    """
    rest = [c for c in confirms.columns if c not in ("token", "slot", "expires_at")]
    once = confirms.groupBy("token").agg(F.min(F.struct("slot", "expires_at", *rest)).alias("row")).select("token", "row.*")
    # a marked join side each: what the audit log executed, and what holds the slot
    done = audit.where("outcome = 'executed'").select("token").distinct().withColumn("done", F.lit(True))
    taken = appointments.where("status = 'scheduled'").select("scope", snapped(F.col("appointment_date")).alias("slot")).distinct().withColumn("taken", F.lit(True))
    rows = once.join(done, "token", "left").join(taken, ["scope", "slot"], "left")
    outcome = F.when(F.col("expires_at") < F.lit(now), "expired").when(F.col("done"), "repeated").when(F.col("taken"), "slot_taken").otherwise("executed")
    return rows.withColumn("outcome", outcome).select(*confirms.columns, "outcome")


def apply_confirms(confirms: DataFrame, appointments: DataFrame, audit: DataFrame, now) -> DataFrame:
    """Confirmations (token, scope, slot, expires_at, ...) with their outcome: expired, repeated, slot taken or executed.

    Each is checked on its own first. Of rival tokens for one slot of a scope, the one that was proposed first (smallest expires_at,
    then token) is executed if the slot is free; the others find it taken. Rows of a slot are put together by aggregation, so a slot
    that very many ask for is no group of one task.
    """
    rows = check_confirms(confirms, appointments, audit, now)
    winners = rows.where("outcome = 'executed'").groupBy("scope", "slot").agg(F.min(F.struct("expires_at", "token")).getField("token").alias("winner"))
    beaten = (F.col("outcome") == "executed") & ~F.col("token").eqNullSafe(F.col("winner"))
    return rows.join(winners, ["scope", "slot"], "left").withColumn("outcome", F.when(beaten, "slot_taken").otherwise(F.col("outcome"))).select(*confirms.columns, "outcome")


def booked(appointments: DataFrame, decided: DataFrame) -> DataFrame:
    """The appointments with one more for each executed confirmation (token, scope, slot, ...); columns that both have are taken over.

    A new row's id is a hash of its token, so doing it twice equals once.
    """
    own = {"id": F.xxhash64("token"), "appointment_date": F.col("slot"), "status": F.lit("scheduled")}
    kinds = {f.name: f.dataType for f in appointments.schema.fields}
    columns = [own.get(c, F.col(c) if c in decided.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in appointments.columns]
    new = decided.where("outcome = 'executed'").select(*columns)
    return appointments.unionByName(new.join(appointments.select("id"), "id", "left_anti").select(appointments.columns))


def apply_cancels(cancels: DataFrame, appointments: DataFrame) -> DataFrame:
    """Appointments with the scheduled ones that are cancelled (id) marked so."""
    hit = cancels.select("id").distinct().withColumn("hit", F.lit(True))
    return appointments.join(hit, "id", "left").withColumn("status", F.when(F.col("hit") & (F.col("status") == "scheduled"), "cancelled").otherwise(F.col("status"))).drop("hit")
