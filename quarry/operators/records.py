"""Scoped record queries.

Every operator answers for all scopes at once: windows are partitioned by scope, so a filter on one scope reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Bounds of a list that a caller may ask for.
LEAST, MOST = 1, 200


def scoped(df: DataFrame, scope) -> DataFrame:
    """rows of one scope; a null scope, asked for or stored, matches nothing."""
    return df.where(F.col("scope") == F.lit(scope))


def register_scoped_views(spark: SparkSession, tables: dict[str, DataFrame], scope, allow: dict[str, Sequence[str]]) -> None:
    """temporary views with the allowed columns of the allowed tables, of one scope."""
    for name, columns in allow.items():
        scoped(tables[name], scope).select(*columns).createOrReplaceTempView(name)


def resolve_scope(users: DataFrame, mapping: DataFrame, scopes: DataFrame) -> DataFrame:
    """(user_id, scope) of active mappings between users and scopes that exist."""
    return mapping.where("is_active").join(users.select("user_id"), "user_id").join(scopes.select("scope"), "scope").select("user_id", "scope").distinct()


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def bounded(df: DataFrame, order: Sequence[Column], limit: int | None = None, default: int = 50, by: str = "scope") -> DataFrame:
    """a list for each scope, its length clamped."""
    return top(df, [by], order, max(LEAST, min(MOST, default if limit is None else limit)))


def appointments(df: DataFrame, status: str | None = None, since=None, until=None, newest_first: bool = True, limit: int | None = None) -> DataFrame:
    """appointments by status and time."""
    for condition in [F.col("status") == status] * (status is not None) + [F.col("appointment_date") >= F.lit(since)] * (since is not None) + [F.col("appointment_date") <= F.lit(until)] * (until is not None):
        df = df.where(condition)
    way = F.desc if newest_first else F.asc
    return bounded(df, [way("appointment_date"), way("id")], limit)


def readings(df: DataFrame, test_name: str | None = None, since: date | None = None, until: date | None = None, limit: int | None = None) -> DataFrame:
    """readings of a test, whatever its name's case, between two dates."""
    if test_name is not None:
        df = df.where(F.lower("test_name") == test_name.lower())
    if since is not None:
        df = df.where(F.col("result_date") >= F.lit(since))
    if until is not None:
        df = df.where(F.col("result_date") <= F.lit(until))
    return bounded(df, [F.desc("result_date"), F.desc("id"), F.desc("value"), F.desc("price")], limit)


def months_back(df: DataFrame, column: str, n: int, today: date) -> DataFrame:
    """rows of the last n months of 30 days."""
    return df.where(F.col(column) >= F.date_sub(F.lit(today), 30 * n))


def profile(df: DataFrame, today: date) -> DataFrame:
    """full name and whole years of age."""
    born = F.col("date_of_birth")
    before = F.date_format(F.lit(today), "MMdd") < F.date_format(born, "MMdd")
    return df.withColumns({"full_name": F.concat_ws(" ", "first_name", "last_name"), "age": F.year(F.lit(today)) - F.year(born) - before.cast("int")})


def compact_row(column: str | Column) -> Column:
    """a map without the keys that have no value."""
    return F.map_filter(column, lambda _, v: v.isNotNull())


def term_matches(display: Column, key: Column, aliases: Column, term: Column) -> Column:
    """whether a term stands in a name, a key or an alias, whatever the case."""
    has = lambda c: F.contains(F.lower(c), F.lower(term))
    return has(display) | has(key) | F.exists(aliases, has)


def next_appointment(df: DataFrame, now) -> DataFrame:
    """Q1: the earliest scheduled appointment of each scope from a time on."""
    return top(df.where((F.col("status") == "scheduled") & (F.col("appointment_date") >= F.lit(now))), ["scope"], [F.asc("appointment_date"), F.asc("id")], 1).drop("rank")


def last_encounter(df: DataFrame) -> DataFrame:
    """Q2: the latest encounter of each scope."""
    return top(df, ["scope"], [F.desc("encounter_date"), F.desc("id")], 1).drop("rank")


def with_provider(facts: DataFrame, providers: DataFrame) -> DataFrame:
    """Facts with their provider's columns, where they have one."""
    return facts.join(providers, "provider_id", "left")


#: Widths of buckets of days, as powers of two from one day on; days are told apart from 1970 on by half of the widest each way.
LEVELS = 22
#: Dates of a scope that each of its courses is compared with.
FEW_DATES = 64


def _day(c: str) -> Column:
    return F.least(F.lit((1 << LEVELS) - 1), F.greatest(F.lit(0), F.unix_date(c) + (1 << LEVELS - 1)))


def _buckets_of(start: Column, end: Column) -> Column:
    """The fewest buckets, of several widths, that make up the days from start to end, each day in one of them."""
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    width = lambda k: F.call_function("shiftleft", F.lit(1), k)
    low, high = (lambda k: F.call_function("shiftright", start + width(k) - 1, k)), (lambda k: F.call_function("shiftright", end + 1, k))
    # a bucket at the left edge where that is the right half of a wider one, and at the right edge where that is the left half
    edge = lambda k, odd, at: F.when((low(k) < high(k)) & (odd % 2 == 1), F.struct(k.alias("level"), at.alias("bucket")))
    return F.array_compact(F.flatten(F.transform(levels, lambda k: F.array(edge(k, low(k), low(k)), edge(k, high(k), high(k) - 1)))))


def in_effect(courses: DataFrame, dates: DataFrame) -> DataFrame:
    """Courses in force on each date of their scope (scope, on_date).

    Courses of a scope with few dates come once, to the list of its dates. Where a scope has more dates than FEW_DATES, a course is cut
    into buckets of days, wide ones for most of a long course, and a date stands in one bucket of each width; those of one scope and
    bucket are joined. A course has each of its days in one bucket, so what meets is in force, and nothing else meets.
    """
    dates = dates.where("on_date is not null")
    rest = [c for c in dates.columns if c != "scope"]
    many = dates.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > FEW_DATES).select("scope")
    crowded = not many.isEmpty()
    few = dates.join(many, "scope", "left_anti") if crowded else dates
    lists = few.groupBy("scope").agg(F.collect_list(F.struct(*rest)).alias("_dates"))
    holds = lambda d: (F.col("start_date") <= d["on_date"]) & (F.col("end_date").isNull() | (F.col("end_date") >= d["on_date"]))
    own = [c for c in courses.columns if c != "scope"]
    found = courses.join(lists, "scope").select("scope", *own, F.inline(F.filter("_dates", holds)))
    if not crowded:
        return found
    met = _in_effect_by_buckets(courses.join(many, "scope", "left_semi"), dates.join(many, "scope", "left_semi"))
    return found.unionByName(met)


def _in_effect_by_buckets(courses: DataFrame, dates: DataFrame) -> DataFrame:
    asked = dates.where("on_date is not null").withColumn("_day", _day("on_date")).select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")).withColumn("bucket", F.call_function("shiftright", F.col("_day"), F.col("level"))).drop("_day")
    end = F.when(F.col("end_date").isNull(), (1 << LEVELS) - 1).otherwise(_day("end_date"))
    held = courses.where("start_date is not null").select("*", F.inline(_buckets_of(_day("start_date"), end)))
    return held.join(asked, ["scope", "level", "bucket"]).drop("level", "bucket")


def current(courses: DataFrame, as_of: date) -> DataFrame:
    """Active courses in force on a date."""
    on = F.lit(as_of)
    return courses.where((F.col("status") == "active") & (F.col("start_date") <= on) & (F.col("end_date").isNull() | (F.col("end_date") >= on)))


def diff_flagged(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """What started, stopped or changed between two states: rows (scope, name, start_date, values..., was, now) are in either or both.

    Names match without case and edges. A name that a state has several times counts with its latest start, then by its values.
    """
    state = F.struct("start_date", *values)
    both = rows.groupBy("scope", F.lower(F.trim("name")).alias("key")).agg(F.max(F.when(F.col("was"), state)).alias("before"), F.max(F.when(F.col("now"), state)).alias("after"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"before.{v}").eqNullSafe(F.col(f"after.{v}"))
    change = F.when(F.col("before").isNull(), "started").when(F.col("after").isNull(), "stopped").when(~same, "changed")
    return both.select("scope", "key", *[F.col(f"{side}.{v}").alias(f"{v}_{side}") for side in ("before", "after") for v in values], change.alias("change")).where("change is not null")


def diff_states(before: DataFrame, after: DataFrame, values: Sequence[str]) -> DataFrame:
    """J6 for two tables."""
    columns = ["scope", "name", "start_date", *values]
    flagged = lambda df, was: df.select(*columns, F.lit(was).alias("was"), F.lit(not was).alias("now"))
    return diff_flagged(flagged(before, True).unionByName(flagged(after, False)), values)


def in_force(day: Column) -> Column:
    """Whether a course holds on a day; both ends count, an open end is in force."""
    return (F.col("start_date") <= day) & (F.col("end_date").isNull() | (F.col("end_date") >= day))


def changes_at_last_encounter(encounters: DataFrame, courses: DataFrame, values: Sequence[str]) -> DataFrame:
    """What changed between the day before each scope's latest encounter and that day; courses are read once."""
    days = last_encounter(encounters).select("scope", "encounter_date")
    rows = courses.join(days, "scope").withColumns({"was": in_force(F.date_sub("encounter_date", 1)), "now": in_force(F.col("encounter_date"))})
    return diff_flagged(rows.where("was or now"), values)


def choose_provider(requests: DataFrame, encounters: DataFrame, providers: DataFrame) -> DataFrame:
    """Q10: the provider that each request's scope saw last, or else the one of the lowest id."""
    seen = encounters.where("provider_id is not null").groupBy("scope").agg(F.max_by("provider_id", F.struct("encounter_date", "id")).alias("seen"))
    anyone = providers.agg(F.min("provider_id").alias("anyone"))
    return requests.join(seen, "scope", "left").join(F.broadcast(anyone)).withColumn("provider_id", F.coalesce("seen", "anyone")).drop("seen", "anyone")


def count_over(df: DataFrame, threshold: float, since: date) -> DataFrame:
    """A1: how many readings of each scope are over a threshold since a date."""
    return df.where(F.col("result_date") >= F.lit(since)).groupBy("scope").agg(F.count_if(F.col("value") > threshold).alias("n_over"))


def avg_since(df: DataFrame, since: date) -> DataFrame:
    """A2: the mean reading of each scope since a date."""
    return df.where(F.col("result_date") >= F.lit(since)).groupBy("scope").agg(F.avg("value").alias("mean_value"))


def count_this_year(df: DataFrame, column: str, today: date) -> DataFrame:
    """A3: rows of each scope in today's year."""
    return df.where(F.year(column) == today.year).groupBy("scope").agg(F.count("*").alias("n"))


def compare_periods(df: DataFrame, first: tuple[date, date], second: tuple[date, date]) -> DataFrame:
    """A4: mean reading of each scope in two periods, and their difference."""
    mean = lambda p: F.avg(F.when(F.col("result_date").between(F.lit(p[0]), F.lit(p[1])), F.col("value")))
    return df.groupBy("scope").agg(mean(first).alias("mean_first"), mean(second).alias("mean_second")).withColumn("difference", F.col("mean_second") - F.col("mean_first"))


def max_value(df: DataFrame) -> DataFrame:
    """A5: the largest reading of each scope and test, and the last day it was read."""
    return df.groupBy("scope", "test_name").agg(F.max("value").alias("max_value"), F.max_by("result_date", F.struct("value", "result_date")).alias("on_date"))


def cap_rows(df: DataFrame, order: Sequence[Column], most: int = MOST) -> DataFrame:
    """Q9: the first rows of a result, and whether there were more."""
    total = df.limit(most + 1).agg(F.count("*").alias("n"))
    return df.orderBy(*order).limit(most).join(F.broadcast(total)).withColumn("truncated", F.col("n") > most).drop("n")


def scoped_sql(spark: SparkSession, tables: dict[str, DataFrame], scope, allow: dict[str, Sequence[str]], sql: str) -> DataFrame:
    """A statement over scoped views; set operations as Spark has them."""
    register_scoped_views(spark, tables, scope, allow)
    return spark.sql(sql)


def listed(df: DataFrame, item: Column, order: Sequence[str], most: int = 10) -> DataFrame:
    """For each scope the first items as one line, and how many older ones are left out."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(*[F.desc(c) for c in order])))
    shown = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", item.alias("item")))))
    line = F.array_join(F.transform(shown, lambda x: x["item"]), "; ")
    out = ranked.groupBy("scope").agg(line.alias("line"), F.count("*").alias("n"))
    return out.select("scope", F.when(F.col("n") > most, F.concat("line", F.lit("; and "), (F.col("n") - most).cast("string"), F.lit(" older"))).otherwise(F.col("line")).alias("summary"), "n")


def record_card(appointments_: DataFrame, readings_: DataFrame, courses: DataFrame, encounters: DataFrame, now, today: date) -> DataFrame:
    """One row per scope with what its lookups find: counts and the latest of each kind."""
    parts = [
        next_appointment(appointments_, now).select("scope", F.col("appointment_date").alias("next_appointment")),
        appointments_.groupBy("scope").agg(F.count("*").alias("n_appointments"), F.count_if(F.col("status") == "cancelled").alias("n_cancelled")),
        current(courses, today).groupBy("scope").agg(F.count_distinct("name").alias("n_current"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("current_names")),
        courses.groupBy("scope").agg(F.count_distinct("condition").alias("n_conditions")),
        readings_.groupBy("scope").agg(F.count("*").alias("n_readings"), F.max("result_date").alias("last_reading")),
        last_encounter(encounters).select("scope", F.col("encounter_date").alias("last_encounter"), F.col("provider_id").alias("last_provider")),
    ]
    out = parts[1]
    for part in parts[:1] + parts[2:]:
        out = out.join(part, "scope", "full")
    return out


# The lookups of a record and what they say where nothing is found.
LOOKUPS = [
    ("profile", "No patient record found."),
    ("next_appointment", "No upcoming appointment is scheduled."),
    ("appointments", "No appointments are on record."),
    ("medications", "No active medications are recorded."),
    ("lab_results", "No lab results found."),
    ("encounters", "No encounters are recorded."),
    ("last_encounter", "No encounters are recorded."),
    ("medication_changes", "No encounters are recorded."),
]


def record_lookups(people: DataFrame, appointments_: DataFrame, readings_: DataFrame, courses: DataFrame, encounters: DataFrame, now, today: date, most: int = 10) -> DataFrame:
    """One row per scope and lookup: how many rows it found, and what it says in one line.

    people: scope, full_name, age, record_no; appointments: appointment_date, appointment_type, provider_name, status, id; readings:
    test_name, value, unit, result_date, id; courses: name, dosage, frequency, status, start_date, end_date; encounters:
    encounter_date, encounter_type, reason, provider_name, id. Lists name their ``most`` latest rows and count the older ones.
    """
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    said = lambda name, *parts: F.when(F.col(name).isNotNull(), text(*parts)).otherwise("")
    day, moment = X.human_date, lambda c: text(X.human_date(c), " at ", F.date_format(c, "HH:mm"))
    shown = lambda lookup, df, line, n=None: df.select("scope", F.lit(lookup).alias("lookup"), (F.lit(1) if n is None else n).cast("long").alias("n"), line.alias("summary"))
    number, who = F.col("n").cast("string"), said("provider_name", " with ", F.col("provider_name"))

    upcoming = appointments_.groupBy("scope").agg(F.count_if(F.col("appointment_date") > F.lit(now)).alias("upcoming"))
    visits = listed(appointments_, text(moment(F.col("appointment_date")), " ", F.col("appointment_type"), who, " (", F.col("status"), ")"), ["appointment_date", "id"], most).join(upcoming, "scope")
    drugs = current(courses, today).groupBy("scope").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", F.col("dosage").cast("string"), "frequency"))), "; ").alias("line"))
    latest = readings_.groupBy("scope").agg(F.count("*").alias("n"), F.max(F.struct("result_date", "id", "test_name", F.col("value").cast("string").alias("value"), "unit")).alias("x"))
    stays = listed(encounters, text(day(F.col("encounter_date")), " ", F.col("encounter_type"), said("reason", " for ", F.col("reason")), who), ["encounter_date", "id"], most)
    last = last_encounter(encounters)
    changes = changes_at_last_encounter(encounters, courses, ["dosage"])
    before, after = F.col("dosage_before").cast("string"), F.col("dosage_after").cast("string")
    change = F.when(F.col("change") == "started", text(F.col("key"), " started (", after, ")")).when(F.col("change") == "stopped", text(F.col("key"), " discontinued (was ", before, ")")).otherwise(text(F.col("key"), " changed from ", before, " to ", after))
    changed = changes.groupBy("scope").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(change)), "; ").alias("line"))
    changed = last.select("scope", "encounter_date").join(changed, "scope", "left")
    at = day(F.col("encounter_date"))
    parts = [
        shown("profile", people, text(F.col("full_name"), ", age ", F.col("age").cast("string"), ", record ", F.col("record_no"), ".")),
        shown("next_appointment", next_appointment(appointments_, now), text("Next appointment: ", moment(F.col("appointment_date")), who, ".")),
        shown("appointments", visits, text(number, " appointments on record, ", F.col("upcoming").cast("string"), " of them upcoming: ", F.col("summary"), "."), F.col("n")),
        shown("medications", drugs, text(number, " active medications: ", F.col("line"), "."), F.col("n")),
        shown("lab_results", latest, text(number, " results; most recent ", F.concat_ws(" ", "x.test_name", "x.value", "x.unit"), " on ", day(F.col("x.result_date")), "."), F.col("n")),
        shown("encounters", stays, text(number, " encounters on record: ", F.col("summary"), "."), F.col("n")),
        shown("last_encounter", last, text("Last visit: ", at, who, ".", said("reason", " Reason: ", F.col("reason")))),
        shown("medication_changes", changed, F.when(F.col("n").isNull(), text("No medication changes were recorded at the ", at, " visit.")).otherwise(text("At the ", at, " visit: ", F.col("line"), ".")), F.coalesce("n", F.lit(0))),
    ]
    every = people.select("scope", F.explode(F.array(*[F.struct(F.lit(k).alias("lookup"), F.lit(none).alias("none")) for k, none in LOOKUPS])).alias("x")).select("scope", "x.*")
    return every.join(reduce(DataFrame.unionByName, parts), ["scope", "lookup"], "left").select("scope", "lookup", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("summary", "none").alias("summary"))


def list_conversations(messages: DataFrame, limit: int = 20, by: str = "owner") -> DataFrame:
    """Q11: each owner's conversations by their last message (conv_id, owner, updated_at)."""
    last = messages.groupBy(by, "conv_id").agg(F.max("updated_at").alias("updated_at"), F.count("*").alias("n_messages"))
    return top(last, [by], [F.desc("updated_at"), F.asc("conv_id")], limit)


def pipe_table(df: DataFrame, order: list[Column], most: int = 25) -> DataFrame:
    """One row ``table``: a header, the first rows in order between pipes, and how many more there are. ``most`` is the view's length."""
    first = df.withColumn("row", X.pipe_row(df.dtypes)).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    shown = first.where(F.col("place") <= most).agg(F.array_sort(F.collect_list(F.struct("place", "row"))).alias("rows"))
    out = shown.join(F.broadcast(df.agg(F.count("*").alias("n"))))
    lines = F.concat(F.array(F.lit(" | ".join(df.columns))), F.transform("rows", lambda r: r["row"]), F.when(F.col("n") > most, F.array(F.format_string("... %d more row(s)", F.col("n") - most))).otherwise(F.array().cast("array<string>")))
    return out.select(F.when(F.col("n") == 0, "(no rows)").otherwise(F.array_join(lines, "\n")).alias("table"))
