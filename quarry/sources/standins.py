"""Domain tables made of the star schema: who (scope) had which appointments, readings and courses of medication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load


def _status(column: str, names: tuple[str, str, str]) -> F.Column:
    return F.when(F.col(column) == "O", names[0]).when(F.col(column) == "F", names[1]).otherwise(names[2])


def appointments(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scope"), F.col("o_orderdate").alias("appointment_date"), _status("o_orderstatus", ("scheduled", "completed", "cancelled")).alias("status"), F.col("o_orderpriority").alias("appointment_type"), F.col("o_totalprice").alias("price"))


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as visits; the provider is the supplier of the order's lowest supplier key."""
    lines = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("provider_id"))
    return load(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scope"), F.col("o_orderdate").cast("date").alias("encounter_date")).join(lines, "id", "left")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("scope"))
    return load(spark, folder, "lineitem").join(orders, "l_orderkey").select("scope", F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("test_name"), F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").cast("date").alias("result_date"))


def medications(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("scope"), "o_orderstatus", "o_orderdate")
    parts = load(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"), F.col("p_type").alias("condition"))
    start, end = F.least("o_orderdate", "l_shipdate").cast("date"), F.greatest("o_orderdate", "l_shipdate").cast("date")
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").join(orders, "l_orderkey").join(parts, "l_partkey")
    return lines.select("scope", F.col("l_orderkey").alias("encounter_id"), F.col("l_suppkey").alias("provider_id"), "name", "condition", F.col("l_quantity").alias("dosage"), _status("o_orderstatus", ("active", "completed", "discontinued")).alias("status"), start.alias("start_date"), F.when(F.col("o_orderstatus") != "O", end).alias("end_date"))


#: The same tables in DuckDB SQL, for oracles.
APPOINTMENTS_SQL = "SELECT o_orderkey AS id, o_custkey AS scope, o_orderdate AS appointment_date, CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'F' THEN 'completed' ELSE 'cancelled' END AS status, o_orderpriority AS appointment_type, o_totalprice AS price FROM orders"
ENCOUNTERS_SQL = "SELECT o_orderkey AS id, o_custkey AS scope, o_orderdate::DATE AS encounter_date, provider_id FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS provider_id FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"
READINGS_SQL = "SELECT o_custkey AS scope, l_orderkey AS id, l_returnflag AS test_name, l_quantity AS value, l_extendedprice AS price, l_shipdate::DATE AS result_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
MEDICATIONS_SQL = "SELECT o_custkey AS scope, l_orderkey AS encounter_id, l_suppkey AS provider_id, p_brand AS name, p_type AS condition, l_quantity AS dosage, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'completed' ELSE 'discontinued' END AS status, least(o_orderdate, l_shipdate)::DATE AS start_date, CASE WHEN o_orderstatus <> 'O' THEN greatest(o_orderdate, l_shipdate)::DATE END AS end_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"
