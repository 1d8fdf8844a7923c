"""Registered record queries and their SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import records as R
from ..sources import standins as S
from ..sources.tables import empty_tables, load, replace_by_key, table_counts
from .registry import query

TODAY, NOW = date(1999, 6, 15), datetime(1999, 6, 15)
A, E, L, M = (f"({x})" for x in (S.APPOINTMENTS_SQL, S.ENCOUNTERS_SQL, S.READINGS_SQL, S.MEDICATIONS_SQL))
IN_EFFECT = "start_date <= {0} AND (end_date IS NULL OR end_date >= {0})"


@query(f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY appointment_date, id) AS r FROM {A} WHERE status = 'scheduled' AND appointment_date >= TIMESTAMP '1999-06-15') WHERE r = 1")
def next_appointment(spark, sf_dir):
    return R.next_appointment(S.appointments(spark, sf_dir), NOW)


@query(f"SELECT e.scope, e.id, e.encounter_date, e.provider_id, s_name AS provider_name FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY encounter_date DESC, id DESC) AS r FROM {E}) e LEFT JOIN supplier ON s_suppkey = e.provider_id WHERE r = 1")
def last_encounter_with_provider(spark, sf_dir):
    providers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("provider_name"))
    return R.with_provider(R.last_encounter(S.encounters(spark, sf_dir)), providers)


@query(f"SELECT *, row_number() OVER (PARTITION BY scope ORDER BY appointment_date DESC, id DESC)::INTEGER AS rank FROM {A} WHERE status = 'completed' AND appointment_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' QUALIFY rank <= 5")
def appointments_filtered(spark, sf_dir):
    return R.appointments(S.appointments(spark, sf_dir), "completed", datetime(1996, 1, 1), datetime(1998, 12, 31), True, 5)


@query(f"SELECT *, row_number() OVER (PARTITION BY scope ORDER BY result_date DESC, id DESC, value DESC, price DESC)::INTEGER AS rank FROM {L} WHERE lower(test_name) = 'r' AND result_date >= DATE '1997-01-01' QUALIFY rank <= 200")
def lab_filter_bounded(spark, sf_dir):
    return R.readings(S.readings(spark, sf_dir), "r", date(1997, 1, 1), None, 1000)


@query(f"SELECT scope, count(*)::BIGINT AS n, min(result_date) AS first_date FROM {L} WHERE result_date >= DATE '1999-06-15' - 180 GROUP BY scope")
def months_back(spark, sf_dir):
    return R.months_back(S.readings(spark, sf_dir), "result_date", 6, TODAY).groupBy("scope").agg(F.count("*").alias("n"), F.min("result_date").alias("first_date"))


@query("SELECT c_custkey AS scope, c_name AS full_name, extract(year FROM DATE '1999-06-15')::INTEGER - extract(year FROM b)::INTEGER - (strftime(DATE '1999-06-15', '%m%d') < strftime(b, '%m%d'))::INTEGER AS age FROM (SELECT *, DATE '1930-01-01' + (c_custkey * 37 % 20000)::INTEGER AS b FROM customer)")
def profile(spark, sf_dir):
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope"), F.col("c_name").alias("first_name"), F.lit(None).cast("string").alias("last_name"), F.date_add(F.lit(date(1930, 1, 1)), (F.col("c_custkey") * 37 % 20000).cast("int")).alias("date_of_birth"))
    return R.profile(people, TODAY).select("scope", "full_name", "age")


@query("SELECT event_type, count(*)::BIGINT AS n, count(CASE WHEN value >= 100 THEN 1 END)::BIGINT AS n_large, (count(*) + count(CASE WHEN value >= 100 THEN 1 END))::BIGINT AS n_keys FROM events GROUP BY 1")
def compact_row(spark, sf_dir):
    row = F.create_map(F.lit("user"), F.col("user_id").cast("double"), F.lit("large"), F.when(F.col("value") >= 100, F.col("value")))
    kept = load(spark, sf_dir, "events").select("event_type", R.compact_row(row).alias("row"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.map_contains_key("row", "large")).alias("n_large"), F.sum(F.size("row")).alias("n_keys"))


@query("SELECT p_partkey, term FROM part, (VALUES ('RED'), ('econ'), ('bolt'), ('#12')) t(term) WHERE contains(lower(p_brand), lower(term)) OR contains(lower(p_type), lower(term)) OR len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), lower(term)))) > 0")
def term_matches(spark, sf_dir):
    terms = spark.createDataFrame([("RED",), ("econ",), ("bolt",), ("#12",)], "term string")
    parts = load(spark, sf_dir, "part")
    return parts.join(F.broadcast(terms), R.term_matches(F.col("p_brand"), F.col("p_type"), F.split("p_name", " "), F.col("term"))).select("p_partkey", "term")


@query(f"SELECT scope, on_date, count(*)::BIGINT AS n, count(DISTINCT name)::BIGINT AS n_names, sum(dosage) AS dosage FROM (SELECT m.*, d.on_date FROM {M} m, (SELECT unnest([DATE '1996-03-01', DATE '1998-03-01', DATE '2000-03-01']) AS on_date) d WHERE " + IN_EFFECT.format("d.on_date") + ") GROUP BY ALL")
def in_effect_on(spark, sf_dir):
    courses = S.medications(spark, sf_dir)
    days = spark.createDataFrame([(date(y, 3, 1),) for y in (1996, 1998, 2000)], "on_date date")
    dates = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope")).join(F.broadcast(days))
    return R.in_effect(courses, dates).groupBy("scope", "on_date").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"), F.sum("dosage").alias("dosage"))


@query(f"SELECT scope, name, dosage, status, start_date, end_date, count(*)::BIGINT AS n FROM {M} WHERE status = 'active' AND " + IN_EFFECT.format("DATE '1999-06-15'") + " GROUP BY ALL")
def current_on(spark, sf_dir):
    return R.current(S.medications(spark, sf_dir), TODAY).groupBy("scope", "name", "dosage", "status", "start_date", "end_date").agg(F.count("*").alias("n"))


def _diff(before: str, after: str) -> str:
    side = "SELECT scope, lower(trim(name)) AS key, dosage, status FROM ({}) QUALIFY row_number() OVER (PARTITION BY scope, lower(trim(name)) ORDER BY start_date DESC, dosage DESC, status DESC) = 1"
    return f"""WITH b AS ({side.format(before)}), a AS ({side.format(after)})
SELECT coalesce(b.scope, a.scope) AS scope, coalesce(b.key, a.key) AS key, b.dosage AS dosage_before, b.status AS status_before, a.dosage AS dosage_after, a.status AS status_after,
CASE WHEN b.scope IS NULL THEN 'started' WHEN a.scope IS NULL THEN 'stopped' ELSE 'changed' END AS change
FROM b FULL JOIN a ON b.scope = a.scope AND b.key = a.key WHERE b.scope IS NULL OR a.scope IS NULL OR b.dosage IS DISTINCT FROM a.dosage OR b.status IS DISTINCT FROM a.status"""


@query(_diff(f"SELECT * FROM {M} WHERE " + IN_EFFECT.format("DATE '1997-01-01'"), f"SELECT * FROM {M} WHERE " + IN_EFFECT.format("DATE '1999-01-01'")))
def state_diff(spark, sf_dir):
    flagged = S.medications(spark, sf_dir).withColumns({"was": R.in_force(F.lit(date(1997, 1, 1))), "now": R.in_force(F.lit(date(1999, 1, 1)))})
    return R.diff_flagged(flagged.where("was or now"), ["dosage", "status"])


LAST = f"(SELECT scope, encounter_date FROM {E} QUALIFY row_number() OVER (PARTITION BY scope ORDER BY encounter_date DESC, id DESC) = 1)"


@query(_diff(f"SELECT m.* FROM {M} m JOIN {LAST} l ON m.scope = l.scope WHERE " + IN_EFFECT.format("l.encounter_date - 1"), f"SELECT m.* FROM {M} m JOIN {LAST} l ON m.scope = l.scope WHERE " + IN_EFFECT.format("l.encounter_date")))
def state_diff_at_last_encounter(spark, sf_dir):
    return R.changes_at_last_encounter(S.encounters(spark, sf_dir), S.medications(spark, sf_dir), ["dosage", "status"])


@query(f"SELECT c_custkey AS scope, coalesce(seen, (SELECT min(s_suppkey) FROM supplier)) AS provider_id FROM customer LEFT JOIN (SELECT scope, provider_id AS seen FROM {E} WHERE provider_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scope ORDER BY encounter_date DESC, id DESC) = 1) e ON e.scope = c_custkey")
def choose_provider(spark, sf_dir):
    requests = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope"))
    providers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider_id"))
    return R.choose_provider(requests, S.encounters(spark, sf_dir), providers)


@query(f"SELECT scope, count(CASE WHEN value > 40 THEN 1 END)::BIGINT AS n_over FROM {L} WHERE result_date >= DATE '1998-06-15' GROUP BY 1")
def threshold_count(spark, sf_dir):
    return R.count_over(S.readings(spark, sf_dir), 40, date(1998, 6, 15))


@query(f"SELECT scope, avg(value) AS mean_value FROM {L} WHERE result_date >= DATE '1998-06-15' GROUP BY 1")
def avg_since(spark, sf_dir):
    return R.avg_since(S.readings(spark, sf_dir), date(1998, 6, 15))


@query(f"SELECT scope, count(*)::BIGINT AS n FROM {A} WHERE year(appointment_date) = 1999 GROUP BY 1")
def count_year(spark, sf_dir):
    return R.count_this_year(S.appointments(spark, sf_dir), "appointment_date", TODAY)


@query(f"SELECT scope, a AS mean_first, b AS mean_second, b - a AS difference FROM (SELECT scope, avg(value) FILTER (result_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') AS a, avg(value) FILTER (result_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31') AS b FROM {L} GROUP BY 1)")
def compare_periods(spark, sf_dir):
    return R.compare_periods(S.readings(spark, sf_dir), (date(1997, 1, 1), date(1997, 12, 31)), (date(1998, 1, 1), date(1998, 12, 31)))


@query(f"SELECT scope, test_name, value AS max_value, result_date AS on_date FROM {L} QUALIFY row_number() OVER (PARTITION BY scope, test_name ORDER BY value DESC, result_date DESC) = 1")
def max_per_test(spark, sf_dir):
    return R.max_value(S.readings(spark, sf_dir))


@query("SELECT o_orderkey AS id, true AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def cap_rows(spark, sf_dir):
    return R.cap_rows(load(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")]).select(F.col("o_orderkey").alias("id"), "truncated")


_SETS = "(SELECT o_custkey AS scope FROM {o} WHERE o_orderstatus = 'O' UNION SELECT o_custkey FROM {o} WHERE o_orderstatus = 'F') INTERSECT SELECT o_custkey FROM {o} WHERE o_totalprice > 100000 EXCEPT SELECT o_custkey FROM {o} WHERE o_orderpriority = '1-URGENT'"


@query(_SETS.format(o="orders"))
def scoped_union_except_intersect(spark, sf_dir):
    load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").createOrReplaceTempView("quarry_orders")
    return spark.sql(_SETS.format(o="quarry_orders"))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, max(o_totalprice) AS highest FROM orders WHERE o_custkey = 7 GROUP BY 1")
def scoped_sql(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").withColumn("scope", F.col("o_custkey"))
    return R.scoped_sql(spark, {"own_orders": orders}, 7, {"own_orders": ["o_orderpriority", "o_totalprice"]}, "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS highest FROM own_orders GROUP BY 1")


@query(f"""SELECT scope, string_agg(CASE WHEN r <= 10 THEN item END, '; ' ORDER BY r) || CASE WHEN count(*) > 10 THEN '; and ' || (count(*) - 10) || ' older' ELSE '' END AS summary, count(*)::BIGINT AS n
FROM (SELECT scope, appointment_type || ' ' || id AS item, row_number() OVER (PARTITION BY scope ORDER BY appointment_date DESC, id DESC) AS r FROM {A}) GROUP BY 1""")
def listed(spark, sf_dir):
    return R.listed(S.appointments(spark, sf_dir), F.concat_ws(" ", "appointment_type", F.col("id").cast("string")), ["appointment_date", "id"])


@query(f"""SELECT a.scope, n.appointment_date AS next_appointment, n_appointments, n_cancelled, n_current, current_names, n_conditions, n_readings, last_reading, encounter_date AS last_encounter, provider_id AS last_provider
FROM (SELECT scope, count(*)::BIGINT AS n_appointments, count(CASE WHEN status = 'cancelled' THEN 1 END)::BIGINT AS n_cancelled FROM {A} GROUP BY 1) a
LEFT JOIN (SELECT scope, min(appointment_date) AS appointment_date FROM {A} WHERE status = 'scheduled' AND appointment_date >= TIMESTAMP '1999-06-15' GROUP BY 1) n ON n.scope = a.scope
LEFT JOIN (SELECT scope, count(DISTINCT name)::BIGINT AS n_current, string_agg(DISTINCT name, ', ' ORDER BY name) AS current_names FROM {M} WHERE status = 'active' AND {IN_EFFECT.format("DATE '1999-06-15'")} GROUP BY 1) c ON c.scope = a.scope
LEFT JOIN (SELECT scope, count(DISTINCT condition)::BIGINT AS n_conditions FROM {M} GROUP BY 1) m ON m.scope = a.scope
LEFT JOIN (SELECT scope, count(*)::BIGINT AS n_readings, max(result_date) AS last_reading FROM {L} GROUP BY 1) l ON l.scope = a.scope
LEFT JOIN (SELECT * FROM {E} QUALIFY row_number() OVER (PARTITION BY scope ORDER BY encounter_date DESC, id DESC) = 1) e ON e.scope = a.scope""")
def record_card(spark, sf_dir):
    return R.record_card(S.appointments(spark, sf_dir), S.readings(spark, sf_dir), S.medications(spark, sf_dir), S.encounters(spark, sf_dir), NOW, TODAY)


_DAY = "strftime({0}, '%-d %B %Y')"
_MOMENT = "strftime({0}, '%-d %B %Y at %H:%M')"
_NAMED = "(SELECT x.*, s_name AS provider_name, CASE WHEN x.id % 3 = 0 THEN 'review' END AS reason, 'visit' AS encounter_type FROM {0} x LEFT JOIN supplier ON s_suppkey = x.provider_id)"
_SEEN = f"(SELECT a.*, provider_name FROM {A} a JOIN {_NAMED.format(E)} e ON e.id = a.id)"
_LIST = "(SELECT scope, count(*) AS n, string_agg(item, '; ' ORDER BY r) FILTER (r <= 10) || CASE WHEN count(*) > 10 THEN '; and ' || (count(*) - 10) || ' older' ELSE '' END AS line{2} FROM (SELECT *, {1} AS item, row_number() OVER (PARTITION BY scope ORDER BY d DESC, id DESC) AS r FROM {0}) GROUP BY 1)"
_WHO = "coalesce(' with ' || provider_name, '')"
_CHANGE = "CASE change WHEN 'started' THEN key || ' started (' || dosage_after || ')' WHEN 'stopped' THEN key || ' discontinued (was ' || dosage_before || ')' ELSE key || ' changed from ' || dosage_before || ' to ' || dosage_after END"
_CHANGES = f"""(SELECT * FROM (SELECT coalesce(b.scope, a.scope) AS scope, coalesce(b.key, a.key) AS key, b.dosage AS dosage_before, a.dosage AS dosage_after, CASE WHEN b.scope IS NULL THEN 'started' WHEN a.scope IS NULL THEN 'stopped' WHEN a.dosage IS DISTINCT FROM b.dosage THEN 'changed' END AS change
FROM (SELECT m.scope, lower(trim(name)) AS key, dosage FROM {M} m JOIN {LAST} l ON m.scope = l.scope WHERE {IN_EFFECT.format("l.encounter_date - 1")} QUALIFY row_number() OVER (PARTITION BY m.scope, lower(trim(name)) ORDER BY start_date DESC, dosage DESC) = 1) b
FULL JOIN (SELECT m.scope, lower(trim(name)) AS key, dosage FROM {M} m JOIN {LAST} l ON m.scope = l.scope WHERE {IN_EFFECT.format("l.encounter_date")} QUALIFY row_number() OVER (PARTITION BY m.scope, lower(trim(name)) ORDER BY start_date DESC, dosage DESC) = 1) a ON a.scope = b.scope AND a.key = b.key) WHERE change IS NOT NULL)"""


@query(f"""WITH e AS (SELECT *, encounter_date AS d FROM {_NAMED.format(E)}), a AS (SELECT *, appointment_date AS d FROM {_SEEN}),
r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY result_date DESC, id DESC, test_name DESC, value::VARCHAR DESC) AS k, count(*) OVER (PARTITION BY scope) AS n FROM {L}),
z AS (SELECT scope, encounter_date, provider_name, reason FROM e QUALIFY row_number() OVER (PARTITION BY scope ORDER BY encounter_date DESC, id DESC) = 1),
p AS (SELECT c_custkey AS scope, 'profile' AS lookup, 1 AS n, c_name || ', age ' || c_custkey % 90 || ', record P' || c_custkey || '.' AS summary FROM customer
UNION ALL SELECT scope, 'next_appointment', 1, 'Next appointment: ' || {_MOMENT.format("d")} || {_WHO} || '.' FROM (SELECT * FROM a WHERE status = 'scheduled' AND d >= TIMESTAMP '1999-06-15' QUALIFY row_number() OVER (PARTITION BY scope ORDER BY d, id) = 1)
UNION ALL SELECT scope, 'appointments', n, n || ' appointments on record, ' || up || ' of them upcoming: ' || line || '.' FROM {_LIST.format("a", _MOMENT.format("d") + " || ' ' || appointment_type || " + _WHO + " || ' (' || status || ')'", ", count(CASE WHEN d > TIMESTAMP '1999-06-15' THEN 1 END) AS up")}
UNION ALL SELECT scope, 'medications', count(*), count(*) || ' active medications: ' || string_agg(name || ' ' || dosage || ' daily', '; ' ORDER BY name || ' ' || dosage || ' daily') || '.' FROM {M} WHERE status = 'active' AND {IN_EFFECT.format("DATE '1999-06-15'")} GROUP BY 1
UNION ALL SELECT scope, 'lab_results', n, n || ' results; most recent ' || test_name || ' ' || value || ' mg on ' || {_DAY.format("result_date")} || '.' FROM r WHERE k = 1
UNION ALL SELECT scope, 'encounters', n, n || ' encounters on record: ' || line || '.' FROM {_LIST.format("e", _DAY.format("d") + " || ' ' || encounter_type || coalesce(' for ' || reason, '') || " + _WHO, "")}
UNION ALL SELECT scope, 'last_encounter', 1, 'Last visit: ' || {_DAY.format("encounter_date")} || {_WHO} || '.' || coalesce(' Reason: ' || reason, '') FROM z
UNION ALL SELECT z.scope, 'medication_changes', coalesce(n, 0), CASE WHEN n IS NULL THEN 'No medication changes were recorded at the ' || {_DAY.format("encounter_date")} || ' visit.' ELSE 'At the ' || {_DAY.format("encounter_date")} || ' visit: ' || line || '.' END FROM z LEFT JOIN (SELECT scope, count(*) AS n, string_agg({_CHANGE}, '; ' ORDER BY {_CHANGE}) AS line FROM {_CHANGES} GROUP BY 1) c ON c.scope = z.scope)
SELECT c_custkey AS scope, w.lookup, coalesce(n, 0)::BIGINT AS n, coalesce(summary, nothing) AS summary FROM customer, (VALUES {", ".join(f"('{k}', '{none}')" for k, none in R.LOOKUPS)}) w(lookup, nothing) LEFT JOIN p ON p.scope = c_custkey AND p.lookup = w.lookup""")
def record_lookups(spark, sf_dir):
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope"), F.col("c_name").alias("full_name"), (F.col("c_custkey") % 90).alias("age"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("record_no"))
    names = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("provider_name"))
    visits = R.with_provider(S.encounters(spark, sf_dir), names).withColumns({"reason": F.when(F.col("id") % 3 == 0, "review"), "encounter_type": F.lit("visit")})
    booked = S.appointments(spark, sf_dir).join(visits.select("id", "provider_name"), "id")
    tests = S.readings(spark, sf_dir).withColumn("unit", F.lit("mg"))
    return R.record_lookups(people, booked, tests, S.medications(spark, sf_dir).withColumn("frequency", F.lit("daily")), visits, NOW, TODAY)


@query("SELECT DISTINCT user_id, c_custkey AS scope FROM events JOIN customer ON c_custkey = user_id % 97 WHERE event_type = 'signup'")
def resolve_scope(spark, sf_dir):
    events, customers = load(spark, sf_dir, "events"), load(spark, sf_dir, "customer")
    mapping = events.select("user_id", (F.col("user_id") % 97).alias("scope"), (F.col("event_type") == "signup").alias("is_active"))
    return R.resolve_scope(events.select("user_id").distinct(), mapping, customers.select(F.col("c_custkey").alias("scope")))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n_rows FROM {t}" for t in _TABLES))
def row_counts(spark, sf_dir):
    return table_counts({t: load(spark, sf_dir, t) for t in _TABLES})


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) = 0 AS is_empty FROM {t}" for t in _TABLES))
def required_tables_empty(spark, sf_dir):
    return empty_tables({t: load(spark, sf_dir, t) for t in _TABLES})


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def replace_rows(spark, sf_dir):
    target = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    updates = target.where("c_nationkey = 3").withColumn("c_mktsegment", F.lit("moved"))
    return replace_by_key(replace_by_key(target, updates, "c_custkey"), updates, "c_custkey").drop("c_nationkey")


@query("SELECT conv_id % 10 AS owner, conv_id, max(turn) AS updated_at, count(*)::BIGINT AS n_messages, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY max(turn) DESC, conv_id)::INTEGER AS rank FROM conversations GROUP BY conv_id QUALIFY rank <= 5")
def list_conversations(spark, sf_dir):
    messages = load(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("owner"), "conv_id", F.col("turn").alias("updated_at"))
    return R.list_conversations(messages, 5)
