"""Scans, sinks and checks of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = "id string, category string, patient string, question string, expected_route string, expected_tools array<string>, relevant struct<title_prefix:string,sections:array<string>>, answer_should_mention array<string>, answer_should_not_mention array<string>, requires_llm boolean"
CHAT_SCHEMA = "messages array<struct<role:string,content:string>>, task string, template_id string"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of JSON files that hold a ``cases`` array."""
    return spark.read.schema(f"cases array<struct<{CASE_SCHEMA.replace(' string', ':string').replace(' array', ':array').replace(' struct', ':struct').replace(' boolean', ':boolean')}>>").option("multiLine", True).json(path).select(F.inline("cases"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """S3: chat rows of JSON lines."""
    return spark.read.schema(CHAT_SCHEMA).json(path)


def write_split(df: DataFrame, path: str) -> None:
    """JSON lines, a folder for each split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def replace_by_key(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The target with all rows of the updates' keys replaced by the updates. Doing it twice equals once."""
    return target.join(updates.select(key).distinct(), key, "left_anti").select(target.columns).unionByName(updates)


#: Folders of a table that is replaced by key.
BUCKETS = 64


def replace_on_disk(updates: DataFrame, keys: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """On disk: all rows of the given keys go, the updates' rows come; ``keys`` are the updates' at least, and those that have no row any more.

    Rows lie in folders by a hash of their key. Only the folders of the keys are read and written again, by dynamic partition
    overwrite; the files of all others stay as they are. A folder keeps a row without a key, so that one whose last key goes is
    overwritten as well. A null key is none.
    """
    spark = updates.sparkSession
    placed = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    keys = placed(keys.select(key).where(F.col(key).isNotNull()).distinct())
    touched = [r["bucket"] for r in keys.select("bucket").distinct().collect()]
    if not touched:
        return
    rows = placed(updates.where(F.col(key).isNotNull()))
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "bucket" else F.col("bucket") for f in rows.schema.fields])
    try:
        held = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        rows = rows.unionByName(held.where(F.col("bucket").isin(touched) & F.col(key).isNotNull()).join(keys, [key, "bucket"], "left_anti").select(rows.columns))
    rows.unionByName(marks).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_replaced(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of a table that ``replace_on_disk`` wrote."""
    return spark.read.parquet(path).where(F.col(key).isNotNull()).drop("bucket")


def append_audit(df: DataFrame, path: str) -> None:
    """Append rows to an audit log."""
    df.write.mode("append").parquet(path)


def audit_batches(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append each batch exactly once.

    A batch's rows go to a folder of its own, then its number to the manifest. A batch that the manifest has is skipped; one that
    failed before that is written over. ``read_audit`` reads what the manifest has, so half a batch is never seen.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        note = lambda numbers: spark.createDataFrame([(n,) for n in numbers], "batch long").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        try:
            known = spark.read.schema("batch long").parquet(f"{path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            note([])
            known = spark.read.schema("batch long").parquet(f"{path}/manifest")
        if known.where(F.col("batch") == number).isEmpty():
            batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            note([number])

    return write


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that were finished."""
    done = spark.read.schema("batch long").parquet(f"{path}/manifest").distinct()
    return spark.read.parquet(f"{path}/rows").join(F.broadcast(done), "batch", "left_semi").drop("batch")


def write_report(metrics: DataFrame, path: str) -> None:
    """A metric report as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()])


def empty_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, is_empty) by looking for one row of each table."""
    return reduce(DataFrame.unionByName, [df.limit(1).agg((F.count("*") == 0).alias("is_empty")).select(F.lit(n).alias("table_name"), "is_empty") for n, df in tables.items()])
