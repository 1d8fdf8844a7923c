"""What the operators of this package share: tables, the shared folder, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to this many ids a side of a join is broadcast (16 bytes each); beyond, both sides are shuffled.
BROADCAST_IDS = 500_000


#: Bytes that go to Python at once, unless one row alone has more.
BATCH_BYTES = 4 << 20
#: Folders to delete, for each block of ``scratch`` that is open.
_OPEN: list[list[str]] = []


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int = BATCH_BYTES) -> Iterator[None]:
    """At most this many rows and bytes go to Python at once while the block runs; whole texts are long. The session's own settings come back after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, when the block ends, the tables that ``written`` made in it, but for those to be kept: they go with the block around it, if there is one."""
    _OPEN.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _OPEN.pop():
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset and there is but one machine, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str, keep: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: executors may be lost later without any of it computed anew.

    It goes when the ``scratch`` block around it ends; with ``keep``, one block later.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    for folders in _OPEN[::-1][int(keep) : int(keep) + 1]:
        folders.append(path)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Empty the folder of a table that ``written`` made and nothing reads any more, by writing no rows over it."""
    folder = df.select(F.input_file_name()).first()
    if folder:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder[0].rsplit("/", 1)[0])


def sized_broadcast(ids: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it is small enough; it must be a written one, of a few numbers a row."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str = "size") -> DataFrame:
    """Inner join of rows with a written table of their groups: one row a key, with ``size``, how many rows it has at most.

    A small table of groups is broadcast. Of a larger one only the groups are that hold more than a share 1 / BROADCAST_IDS of all
    rows; there can be no more than BROADCAST_IDS of them, and no task gets more than such a share of one key by the shuffle.
    """
    n, total = groups.agg(F.count("*"), F.sum(size)).first()
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(groups), key)
    large = groups.where(F.col(size) > total / BROADCAST_IDS)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.where(F.col(size) <= total / BROADCAST_IDS), key)
    return rows.join(F.broadcast(large), key).unionByName(rest)
