"""Registered graph queries and their SQL. Owners are customers, visits orders, medications parts, providers suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import standins as S
from ..sources.scratch import written
from ..sources.tables import load
from .records import E, L, M
from .registry import query


def _graph(spark, sf_dir):
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    customers, suppliers, parts = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier"), load(spark, sf_dir, "part")
    nodes = G.union_all([G.nodes(customers, "Owner", "c_custkey", "c_custkey", "c_name"), G.nodes(orders, "Visit", "o_orderkey", "o_custkey"), G.nodes(suppliers, "Provider", "s_suppkey", None, "s_name"), G.nodes(parts, "Medication", "p_partkey", None, "p_name"), G.nodes(parts, "Condition", "p_type", None, "p_type")])
    edges = G.union_all([G.edges(orders, "Owner", "o_custkey", "HAD", "Visit", "o_orderkey"), G.edges(lines, "Visit", "l_orderkey", "GAVE", "Medication", "l_partkey"), G.edges(lines, "Visit", "l_orderkey", "BY", "Provider", "l_suppkey"), G.edges(parts, "Medication", "p_partkey", "TREATS", "Condition", "p_type")])
    return nodes, edges


@query("""SELECT 'node' AS kind, 'Owner' AS name, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'node', 'Visit', count(*) FROM orders UNION ALL SELECT 'node', 'Provider', count(*) FROM supplier
UNION ALL SELECT 'node', 'Medication', count(*) FROM part UNION ALL SELECT 'node', 'Condition', count(DISTINCT p_type) FROM part UNION ALL SELECT 'edge', 'HAD', count(*) FROM orders UNION ALL SELECT 'edge', 'TREATS', count(*) FROM part
UNION ALL SELECT 'edge', 'GAVE', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'edge', 'BY', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)""")
def graph_counts(spark, sf_dir):
    return G.graph_counts(*_graph(spark, sf_dir))


def _record_tables(spark, sf_dir):
    """All ten tables of a record: suppliers' nations are departments, return flags tests, line states procedures, market segments allergies."""
    text = lambda *c: F.concat_ws("-", *c)
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("scope"))
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("encounter_id"), "l_linenumber", F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("lab_id"), "l_linestatus")
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("condition_id"))
    # ten tables are made of these rows, for nodes and for edges
    rows = written(lines.join(orders, "encounter_id").join(parts, "id"), "records")
    line = text("encounter_id", "l_linenumber").alias("id")
    customers, suppliers = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    first = F.when(F.col("id") % 10 > 0, F.concat(F.lit("T"), F.col("id") % 5))
    return {
        "patients": customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "departments": load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "providers": suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("department_id")),
        "encounters": S.encounters(spark, sf_dir).withColumn("condition_id", first),
        "conditions": rows.select("scope", F.col("condition_id").alias("id"), F.col("condition_id").alias("name")),
        "medications": rows,
        "lab_results": rows.select("scope", "encounter_id", line, "lab_id"),
        "procedures": rows.select("scope", "encounter_id", text("encounter_id", "l_linestatus").alias("id"), F.col("l_linestatus").alias("name")),
        "allergies": customers.select(F.col("c_custkey").alias("scope"), F.col("c_mktsegment").alias("id"), F.col("c_mktsegment").alias("name")),
        "diagnoses": rows.select("scope", "encounter_id", text("encounter_id", "condition_id").alias("id"), "condition_id"),
    }


_RECORDS = """WITH l AS (SELECT l_orderkey AS e, l_linenumber AS n, l_partkey AS m, l_returnflag AS lab, l_linestatus AS ship, o_custkey AS s, p_type AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
f AS (SELECT o_orderkey AS e, CASE WHEN o_orderkey % 10 > 0 THEN 'T' || o_orderkey % 5 END AS c, p FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_COUNTS = {
    ("node", "Patient"): "count(*) FROM customer",
    ("node", "Provider"): "count(*) FROM supplier",
    ("node", "Encounter"): "count(*) FROM orders",
    ("node", "Condition"): "count(DISTINCT c) FROM l",
    ("node", "Medication"): "count(DISTINCT m) FROM l",
    ("node", "Lab"): "count(DISTINCT lab) FROM l",
    ("node", "LabResult"): "count(*) FROM (SELECT DISTINCT e, n FROM l)",
    ("node", "Department"): "count(*) FROM nation",
    ("node", "Procedure"): "count(*) FROM (SELECT DISTINCT e, ship FROM l)",
    ("node", "Allergy"): "count(DISTINCT c_mktsegment) FROM customer",
    ("node", "Diagnosis"): "count(*) FROM (SELECT DISTINCT e, c FROM l)",
    ("edge", "HAD_ENCOUNTER"): "count(*) FROM orders",
    ("edge", "WITH_PROVIDER"): "count(p) FROM f",
    ("edge", "FOR_CONDITION"): "count(c) FROM f",
    ("edge", "IN_DEPARTMENT"): "count(*) FROM supplier",
    ("edge", "HAS_CONDITION"): "count(*) FROM (SELECT DISTINCT s, c FROM l)",
    ("edge", "TAKES"): "count(*) FROM (SELECT DISTINCT s, m FROM l)",
    ("edge", "PRESCRIBED"): "count(*) FROM (SELECT DISTINCT e, m FROM l)",
    ("edge", "TREATS"): "count(*) FROM (SELECT DISTINCT m, c FROM l)",
    ("edge", "HAS_LAB_RESULT"): "count(*) FROM (SELECT DISTINCT s, e, n FROM l)",
    ("edge", "ORDERED"): "count(*) FROM (SELECT DISTINCT e, n FROM l)",
    ("edge", "OF_LAB"): "count(*) FROM (SELECT DISTINCT e, n, lab FROM l)",
    ("edge", "HAD_PROCEDURE"): "count(*) FROM (SELECT DISTINCT s, e, ship FROM l)",
    ("edge", "PERFORMED"): "count(*) FROM (SELECT DISTINCT e, ship FROM l)",
    ("edge", "HAS_ALLERGY"): "count(*) FROM customer",
    ("edge", "DIAGNOSED"): "count(*) FROM (SELECT DISTINCT s, e, c FROM l)",
    ("edge", "MADE_DIAGNOSIS"): "count(*) FROM (SELECT DISTINCT e, c FROM l)",
    ("edge", "OF_CONDITION"): "count(*) FROM (SELECT DISTINCT e, c FROM l)",
}


@query(_RECORDS + " UNION ALL ".join(f" SELECT '{kind}' AS kind, '{name}' AS name, ({'SELECT ' + count})::BIGINT AS n" for (kind, name), count in _COUNTS.items()))
def graph_projection(spark, sf_dir):
    """All eleven labels and seventeen relations."""
    tables = _record_tables(spark, sf_dir)
    return G.graph_counts(G.project_nodes(tables), G.project_edges(tables))


def _drifted(spark, sf_dir):
    """The graph with visits of every 50th owner also hung on the next owner."""
    nodes, edges = _graph(spark, sf_dir)
    moved = edges.where("rel = 'HAD' and src_id % 50 = 0").withColumn("src_id", (F.col("src_id").cast("long") + 1).cast("string"))
    return nodes, edges.unionByName(moved)


@query("SELECT 'Visit' AS dst_label, o_orderkey::VARCHAR AS dst_id, 2::BIGINT AS n_owners FROM orders WHERE o_custkey % 50 = 0")
def ownership_violations(spark, sf_dir):
    return G.ownership_violations(_drifted(spark, sf_dir)[1], "Owner")


@query("SELECT 'HAD' AS rel, (SELECT count(*) FROM orders)::BIGINT AS n UNION ALL SELECT 'TREATS', count(*) FROM part UNION ALL SELECT 'GAVE', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'BY', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")
def reconcile(spark, sf_dir):
    nodes, edges = _drifted(spark, sf_dir)
    return G.reconcile(edges, nodes, "Owner").groupBy("rel").agg(F.count("*").alias("n"))


@query("""SELECT rel, count(*)::BIGINT AS n FROM (SELECT 'HAD' AS rel FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT 'TREATS' FROM part UNION ALL SELECT 'GAVE' FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 3 > 0) UNION ALL SELECT 'BY' FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 3 > 0)) GROUP BY 1""")
def sweep(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    kept = nodes.where("label <> 'Visit' or id % 3 > 0")
    return G.sweep(nodes, edges, kept)[1].groupBy("rel").agg(F.count("*").alias("n"))


@query("SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 10 = 0 THEN 'renamed' ELSE c_name END AS name FROM customer UNION ALL SELECT '-5', 'new'")
def merge_graph(spark, sf_dir):
    current = _graph(spark, sf_dir)[0].where("label = 'Owner'")
    incoming = current.where("id % 10 = 0").withColumn("name", F.lit("renamed")).unionByName(spark.createDataFrame([("Owner", "-5", -5, "new")], current.schema))
    return G.merge(G.merge(current, incoming, ["label", "id"]), incoming, ["label", "id"]).select("id", "name")


@query("SELECT l_partkey::VARCHAR AS dst_id, (count(DISTINCT l_orderkey) * (count(DISTINCT l_orderkey) - 1) // 2)::BIGINT AS n_pairs FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def shared_pairs(spark, sf_dir):
    return G.shared_pairs(_graph(spark, sf_dir)[1], "GAVE")


@query("SELECT o_custkey::VARCHAR AS owner, count(DISTINCT p_type)::BIGINT AS n_conditions FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def owner_conditions_by_hops(spark, sf_dir):
    _, edges = _graph(spark, sf_dir)
    start = edges.where("rel = 'HAD'").select(F.col("src_id").alias("owner"), F.col("dst_id").alias("visit"))
    return G.hop(G.hop(start, "visit", edges, "GAVE", "medication"), "medication", edges, "TREATS", "condition").groupBy("owner").agg(F.count_distinct("condition").alias("n_conditions"))


@query(f"SELECT scope, condition, min(start_date) AS onset, row_number() OVER (PARTITION BY scope ORDER BY min(start_date), condition)::INTEGER AS rank FROM {M} GROUP BY scope, condition QUALIFY rank <= 100")
def t_conditions(spark, sf_dir):
    return G.t_conditions(S.medications(spark, sf_dir))


@query(f"SELECT scope, term, condition, name, min(start_date) AS since, row_number() OVER (PARTITION BY scope ORDER BY min(start_date), name, condition, term)::INTEGER AS rank FROM {M} JOIN (VALUES ('econ'), ('SMALL')) t(term) ON contains(lower(condition), lower(term)) GROUP BY scope, term, condition, name QUALIFY rank <= 100")
def t_meds_for(spark, sf_dir):
    terms = spark.createDataFrame([("econ",), ("SMALL",)], "term string")
    conditions = load(spark, sf_dir, "part").select(F.col("p_type").alias("condition")).distinct()
    return G.t_medications_for(S.medications(spark, sf_dir), conditions, terms)


@query(f"SELECT m.scope, m.name, condition, min(o_orderdate::DATE) AS first_visit, min(s_name) AS provider, bool_or(end_date IS NULL) AS in_force, row_number() OVER (PARTITION BY m.scope ORDER BY min(o_orderdate::DATE), m.name, condition)::INTEGER AS rank FROM {M} m LEFT JOIN orders ON o_orderkey = encounter_id LEFT JOIN supplier ON s_suppkey = provider_id WHERE contains(lower(m.name), 'brand#1') GROUP BY m.scope, m.name, condition QUALIFY rank <= 100")
def t_why(spark, sf_dir):
    providers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("provider_name"))
    return G.t_why(S.medications(spark, sf_dir), S.encounters(spark, sf_dir), providers, "Brand#1")


@query(f"SELECT scope, condition, min(start_date) AS first_seen, max(start_date) AS last_seen, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM {M} GROUP BY ALL")
def t_timeline(spark, sf_dir):
    return G.t_timeline(S.medications(spark, sf_dir))


@query(f"SELECT l.scope, condition, test_name, count(*)::BIGINT AS n, max(value) AS highest FROM {L} l JOIN (SELECT DISTINCT scope, encounter_id, condition FROM {M}) m ON m.scope = l.scope AND m.encounter_id = l.id GROUP BY ALL")
def t_labs_for(spark, sf_dir):
    return G.t_readings_for(S.readings(spark, sf_dir), S.medications(spark, sf_dir))


@query(f"SELECT scope, provider_id, count(DISTINCT encounter_id)::BIGINT AS n_visits, max(o_orderdate::DATE) AS last_seen, count(DISTINCT condition)::BIGINT AS n_conditions FROM {M} JOIN orders ON o_orderkey = encounter_id GROUP BY scope, provider_id")
def care_team(spark, sf_dir):
    return G.care_team(S.medications(spark, sf_dir), S.encounters(spark, sf_dir))


@query(f"SELECT *, row_number() OVER (PARTITION BY scope ORDER BY start_date, name, dosage, status, end_date NULLS LAST)::INTEGER AS rank FROM (SELECT DISTINCT scope, name, dosage, status, start_date, end_date FROM {M}) QUALIFY rank <= 100")
def medication_history(spark, sf_dir):
    return G.medication_history(S.medications(spark, sf_dir))


@query("SELECT p_partkey % 50 AS scope, p_name AS substance, p_type AS severity, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY CASE p_type WHEN 'LARGE' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END, p_name)::INTEGER AS rank FROM (SELECT DISTINCT p_partkey % 50 AS p_partkey, p_name, CASE WHEN p_type IN ('LARGE', 'MEDIUM', 'SMALL') THEN p_type ELSE 'OTHER' END AS p_type FROM part) QUALIFY rank <= 100")
def allergies(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("scope"), F.col("p_name").alias("substance"), F.when(F.col("p_type").isin("LARGE", "MEDIUM", "SMALL"), F.col("p_type")).otherwise("OTHER").alias("severity")).distinct()
    return G.by_severity(rows, ["LARGE", "MEDIUM", "SMALL"])


@query(f"SELECT DISTINCT scope, name, encounter_date AS performed_date, m.provider_id, s_name AS provider_name, dense_rank() OVER (PARTITION BY scope ORDER BY encounter_date DESC, name, m.provider_id)::INTEGER AS rank FROM (SELECT m.scope, m.name, m.provider_id, o_orderdate::DATE AS encounter_date FROM {M} m JOIN orders ON o_orderkey = encounter_id) m LEFT JOIN supplier ON s_suppkey = m.provider_id QUALIFY rank <= 100")
def procedures(spark, sf_dir):
    visits = S.encounters(spark, sf_dir).select(F.col("id").alias("encounter_id"), F.col("encounter_date").alias("performed_date"))
    rows = S.medications(spark, sf_dir).join(visits, "encounter_id").select("scope", "name", "performed_date", "provider_id").distinct()
    return G.procedures(rows, load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("provider_name")))


@query(f"SELECT scope, condition, min(start_date) AS first_recorded, count(*)::BIGINT AS times, count(DISTINCT provider_id)::BIGINT AS n_providers, array_to_string(list_slice(list_sort(list(DISTINCT provider_id::VARCHAR)), 1, 5), ',') AS providers FROM {M} GROUP BY ALL")
def diagnosis_history(spark, sf_dir):
    """Shows the first five providers, as its SQL does; diagnosis_history_whole shows all."""
    return diagnosis_history_whole(spark, sf_dir).drop("codes").withColumn("providers", F.substring_index("providers", ",", 5))


@query(f"SELECT scope, condition, min(start_date) AS first_recorded, count(*)::BIGINT AS times, count(DISTINCT provider_id)::BIGINT AS n_providers, string_agg(DISTINCT provider_id::VARCHAR, ',' ORDER BY provider_id::VARCHAR) AS providers, string_agg(DISTINCT name, ',' ORDER BY name) AS codes FROM {M} GROUP BY ALL")
def diagnosis_history_whole(spark, sf_dir):
    """The name stands in for the code of a diagnosis."""
    return G.diagnosis_history(S.medications(spark, sf_dir).withColumn("code", F.col("name")))


@query(f"SELECT scope, string_agg(name, '; ' ORDER BY d, name) AS summary FROM (SELECT scope, name, min(start_date) AS d FROM {M} GROUP BY ALL) GROUP BY 1")
def summarise(spark, sf_dir):
    return G.summarise(S.medications(spark, sf_dir), "name", ["start_date"])


@query(f"SELECT e.scope, count(*)::BIGINT AS n FROM {E} e WHERE e.scope IN (SELECT scope FROM {M} WHERE name = 'Brand#12') GROUP BY 1")
def explain_chain(spark, sf_dir):
    found = S.medications(spark, sf_dir).where("name = 'Brand#12'")
    return G.explain(found, S.encounters(spark, sf_dir)).groupBy("scope").agg(F.count("*").alias("n"))
