"""Property graph from tables, its repair and its traversals.

Nodes: (label, id, scope, name); edges: (src_label, src_id, rel, dst_label, dst_id). A null foreign key gives no edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import top

#: Rows of a traversal that one scope may have.
MOST = 100


def nodes(df: DataFrame, label: str, key: str, scope: str | None = None, name: str | None = None) -> DataFrame:
    """G1: the nodes of one label; a key that repeats is one node."""
    rows = df.where(F.col(key).isNotNull()).select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), (F.col(scope) if scope else F.lit(None)).cast("long").alias("scope"), (F.col(name) if name else F.lit(None)).cast("string").alias("name"))
    return rows.dropDuplicates(["label", "id"])


def edges(df: DataFrame, src_label: str, src: str, rel: str, dst_label: str, dst: str) -> DataFrame:
    """The edges of one type."""
    rows = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    return rows.select(F.lit(src_label).alias("src_label"), F.col(src).cast("string").alias("src_id"), F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), F.col(dst).cast("string").alias("dst_id")).distinct()


# Which table gives the nodes of which label (key, scope, name) and the edges of which relation (from column, to column).
NODE_SOURCES = {
    "patients": [("Patient", "id", "id", "name")],
    "providers": [("Provider", "id", None, "name")],
    "encounters": [("Encounter", "id", "scope", None)],
    "conditions": [("Condition", "id", None, "name")],
    "medications": [("Medication", "id", None, "name")],
    "lab_results": [("Lab", "lab_id", None, "lab_id"), ("LabResult", "id", "scope", None)],
    "departments": [("Department", "id", None, "name")],
    "procedures": [("Procedure", "id", "scope", "name")],
    "allergies": [("Allergy", "id", None, "name")],
    "diagnoses": [("Diagnosis", "id", "scope", None)],
}
EDGE_SOURCES = {
    "encounters": [("Patient", "scope", "HAD_ENCOUNTER", "Encounter", "id"), ("Encounter", "id", "WITH_PROVIDER", "Provider", "provider_id"), ("Encounter", "id", "FOR_CONDITION", "Condition", "condition_id")],
    "providers": [("Provider", "id", "IN_DEPARTMENT", "Department", "department_id")],
    "conditions": [("Patient", "scope", "HAS_CONDITION", "Condition", "id")],
    "medications": [("Patient", "scope", "TAKES", "Medication", "id"), ("Encounter", "encounter_id", "PRESCRIBED", "Medication", "id"), ("Medication", "id", "TREATS", "Condition", "condition_id")],
    "lab_results": [("Patient", "scope", "HAS_LAB_RESULT", "LabResult", "id"), ("Encounter", "encounter_id", "ORDERED", "LabResult", "id"), ("LabResult", "id", "OF_LAB", "Lab", "lab_id")],
    "procedures": [("Patient", "scope", "HAD_PROCEDURE", "Procedure", "id"), ("Encounter", "encounter_id", "PERFORMED", "Procedure", "id")],
    "allergies": [("Patient", "scope", "HAS_ALLERGY", "Allergy", "id")],
    "diagnoses": [("Patient", "scope", "DIAGNOSED", "Diagnosis", "id"), ("Encounter", "encounter_id", "MADE_DIAGNOSIS", "Diagnosis", "id"), ("Diagnosis", "id", "OF_CONDITION", "Condition", "condition_id")],
}


def project_nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """G1: the nodes of all labels whose tables are given. A label is of one table, so its keys are told apart before they are text."""
    parts = []
    for table, df in tables.items():
        for label, key, scope, name in NODE_SOURCES[table]:
            value = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
            found = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(value(scope, "long")).alias("scope"), F.min(value(name, "string")).alias("name"))
            parts.append(found.select(F.lit(label).alias("label"), F.col("key").cast("string").alias("id"), "scope", "name"))
    return union_all(parts)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys in as many partitions as the session's shuffles have; adaptive execution doesn't put these together, so a task's memory follows that number."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def project_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """The edges of all relations whose tables are given; a null key gives no edge.

    All relations of a table have its id at one end. Where the id is one scope's own, so that few rows share it, rows are dealt by
    it once and all their edges are told apart in place; edges of shared ids, like medications, are dealt by both ends.
    """
    parts = []
    for table, df in tables.items():
        sources = EDGE_SOURCES.get(table, [])
        if any(key == "id" and scope == "scope" for _, key, scope, _ in NODE_SOURCES[table]):
            ends = [dst if src == "id" else src for _, src, _, _, dst in sources]
            # an id's rows are put together by sorting, which takes less memory than a table of all edges
            rows = dealt(df.select("id", *ends).where("id is not null"), "id").groupBy("id").agg(*[F.collect_set(c).alias(f"of_{i}") for i, c in enumerate(ends)])
            marked = lambda i: F.transform(f"of_{i}", lambda x: F.struct(F.lit(i).alias("source"), x.cast("string").alias("other")))
            found = rows.select("id", F.inline(F.concat(*[marked(i) for i in range(len(ends))])))
            said = lambda at: F.get(F.array(*[F.lit(x[at]) for x in sources]), F.col("source"))
            end = lambda at: F.when(F.get(F.array(*[F.lit(x[at] == "id") for x in sources]), F.col("source")), F.col("id").cast("string")).otherwise(F.col("other"))
            parts.append(found.select(said(0).alias("src_label"), end(1).alias("src_id"), said(2).alias("rel"), said(3).alias("dst_label"), end(4).alias("dst_id")))
        else:
            for src_label, src, rel, dst_label, dst in sources:
                found = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
                parts.append(found.select(F.lit(src_label).alias("src_label"), F.col("src").cast("string").alias("src_id"), F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), F.col("dst").cast("string").alias("dst_id")))
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def merge(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The current rows with the incoming ones of the same keys in their place."""
    return current.join(incoming.select(keys).distinct(), keys, "left_anti").select(current.columns).unionByName(incoming)


def reconcile(edges_: DataFrame, nodes_: DataFrame, owner: str) -> DataFrame:
    """Without edges from an owner to a node whose scope is another's."""
    held = nodes_.where("scope is not null").select(F.col("label").alias("dst_label"), F.col("id").alias("dst_id"), F.col("scope").cast("string").alias("owned_by"))
    wrong = edges_.where(F.col("src_label") == owner).join(held, ["dst_label", "dst_id"]).where("src_id <> owned_by").select(edges_.columns)
    return edges_.join(wrong, edges_.columns, "left_anti")


def sweep(nodes_: DataFrame, edges_: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that still have a source row (label, id), and edges whose ends both stay."""
    left = nodes_.join(kept.select("label", "id").distinct(), ["label", "id"], "left_semi")
    for end in ("src", "dst"):
        edges_ = edges_.join(left.select(F.col("label").alias(f"{end}_label"), F.col("id").alias(f"{end}_id")), [f"{end}_label", f"{end}_id"], "left_semi")
    return left, edges_.select("src_label", "src_id", "rel", "dst_label", "dst_id")


def ownership_violations(edges_: DataFrame, owner: str) -> DataFrame:
    """Nodes with several owners."""
    own = edges_.where(F.col("src_label") == owner)
    return own.groupBy("dst_label", "dst_id").agg(F.count_distinct("src_id").alias("n_owners")).where("n_owners > 1")


def graph_counts(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Nodes of each label and edges of each type."""
    return nodes_.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n")).unionByName(edges_.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count("*").alias("n")))


def hop(frame: DataFrame, at: str, edges_: DataFrame, rel: str, to: str, how: str = "inner") -> DataFrame:
    """One step of a traversal along a relation."""
    return frame.join(edges_.where(F.col("rel") == rel).select(F.col("src_id").alias(at), F.col("dst_id").alias(to)), at, how)


def limited(rows: DataFrame, order: list[Column], most: int = MOST) -> DataFrame:
    """A traversal's rows, each scope's first ones."""
    return top(rows, ["scope"], order, most)


def shared_pairs(edges_: DataFrame, rel: str) -> DataFrame:
    """For each shared node how many pairs of sources meet there."""
    degree = edges_.where(F.col("rel") == rel).groupBy("dst_id").agg(F.count_distinct("src_id").alias("n"))
    return degree.where("n > 1").select("dst_id", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"))


def t_medications_for(courses: DataFrame, conditions: DataFrame, terms: DataFrame) -> DataFrame:
    """A scope's courses whose condition a term names (F12) and that the scope has."""
    named = conditions.join(terms, F.contains(F.lower("condition"), F.lower("term"))).select("condition", "term").distinct()
    has = courses.select("scope", "condition").distinct()
    rows = courses.join(named, "condition").join(has, ["scope", "condition"], "left_semi")
    return limited(rows.groupBy("scope", "term", "condition", "name").agg(F.min("start_date").alias("since")), [F.asc("since"), F.asc("name"), F.asc("condition"), F.asc("term")])


def t_why(courses: DataFrame, encounters: DataFrame, providers: DataFrame, term: str) -> DataFrame:
    """Why a medication: its condition, visit and provider where known, and whether it is still in force."""
    rows = courses.where(F.contains(F.lower("name"), F.lit(term.lower())))
    rows = rows.join(encounters.select(F.col("id").alias("encounter_id"), "encounter_date"), "encounter_id", "left").join(providers, "provider_id", "left")
    grouped = rows.groupBy("scope", "name", "condition").agg(F.min("encounter_date").alias("first_visit"), F.min("provider_name").alias("provider"), F.max(F.col("end_date").isNull()).alias("in_force"))
    return limited(grouped, [F.asc("first_visit"), F.asc("name"), F.asc("condition")])


def t_timeline(courses: DataFrame) -> DataFrame:
    """A scope's conditions with when each was first and last treated and by what."""
    return courses.groupBy("scope", "condition").agg(F.min("start_date").alias("first_seen"), F.max("start_date").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))


def t_conditions(courses: DataFrame) -> DataFrame:
    """A scope's conditions by onset; one without any comes last."""
    rows = courses.groupBy("scope", "condition").agg(F.min("start_date").alias("onset"))
    return limited(rows, [F.coalesce("onset", F.lit("9999-12-31").cast("date")).asc(), F.asc("condition")])


def t_readings_for(readings: DataFrame, courses: DataFrame) -> DataFrame:
    """Readings of visits where a condition was treated."""
    # both are dealt by visit once, and sorted once: a visit's condition counts where it comes first
    again = F.row_number().over(Window.partitionBy("scope", "id", "condition").orderBy("condition"))
    visits = dealt(courses.select("scope", F.col("encounter_id").alias("id"), "condition"), "scope", "id").withColumn("again", again).where("again = 1").drop("again")
    own = dealt(readings.select("scope", "id", "test_name", "value"), "scope", "id")
    return own.join(visits, ["scope", "id"]).groupBy("scope", "condition", "test_name").agg(F.count("*").alias("n"), F.max("value").alias("highest"))


def care_team(courses: DataFrame, encounters: DataFrame) -> DataFrame:
    """A scope's providers: visits, last seen, conditions."""
    seen = courses.select("scope", "encounter_id", "provider_id", "condition").join(encounters.select(F.col("id").alias("encounter_id"), "encounter_date"), "encounter_id")
    # a visit counts at its first condition, so that visits needn't be kept apart any further
    first = F.row_number().over(Window.partitionBy("encounter_id", "scope", "provider_id").orderBy("condition")) == 1
    by_condition = seen.withColumn("visit", first.cast("long")).groupBy("scope", "provider_id", "condition").agg(F.sum("visit").alias("visits"), F.max("encounter_date").alias("last"))
    return by_condition.groupBy("scope", "provider_id").agg(F.sum("visits").alias("n_visits"), F.max("last").alias("last_seen"), F.count("condition").alias("n_conditions"))


def medication_history(courses: DataFrame) -> DataFrame:
    """A scope's courses, oldest first."""
    rows = courses.select("scope", "name", "dosage", "status", "start_date", "end_date").distinct()
    return limited(rows, [F.asc("start_date"), F.asc("name"), F.asc("dosage"), F.asc("status"), F.asc_nulls_last("end_date")])


def by_severity(rows: DataFrame, order: list[str]) -> DataFrame:
    """A scope's rows, the severest first (scope, substance, severity)."""
    place = F.lit(len(order))
    for i, name in enumerate(order):
        place = F.when(F.col("severity") == name, i).otherwise(place)
    return limited(rows.withColumn("place", place), [F.asc("place"), F.asc("substance")]).drop("place")


def diagnosis_history(courses: DataFrame) -> DataFrame:
    """When a condition was first recorded, how often, by whom (all of them), and under which codes."""
    every = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return courses.groupBy("scope", "condition").agg(F.min("start_date").alias("first_recorded"), F.count("*").alias("times"), F.count_distinct("provider_id").alias("n_providers"), every("provider_id").alias("providers"), every("code").alias("codes"))


def procedures(rows: DataFrame, providers: DataFrame) -> DataFrame:
    """A scope's procedures with who did them, newest first (scope, name, performed_date, provider_id)."""
    return limited(rows.join(providers, "provider_id", "left"), [F.desc("performed_date"), F.asc("name"), F.asc("provider_id")])


def summarise(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """A scope's distinct values in the order they come first."""
    first = rows.groupBy("scope", column).agg(F.min(F.struct(*order)).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy("at", column)))
    return ranked.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(column).alias("v")))), lambda x: x["v"]), "; ").alias("summary"))


def explain(found: DataFrame, hits: DataFrame) -> DataFrame:
    """Retrieval hits of the scopes for which a traversal found rows."""
    return hits.join(found.select("scope").distinct(), "scope", "left_semi")
