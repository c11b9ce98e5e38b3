"""Cutting lineage between the rounds of an iterative plan, by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without one (as in tests) gets a temporary folder, any other is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: How many folders a task may write to at once; a task with more values of the column sorts its rows first.
OPEN_FOLDERS = 32


def _written_by(df: DataFrame, by: str, path: str) -> None:
    """A folder for each value, without a sort of a task's rows by the column, which holds all of them at once or spills."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    conf = df.sparkSession.conf
    before = conf.get(name)
    conf.set(name, OPEN_FOLDERS)
    try:
        df.write.partitionBy(by).parquet(path)
    finally:
        conf.set(name, before)


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """df, computed once, written as Parquet into the shared folder and read back.

    The files survive lost executors and go when the driver ends. Their size is known to the planner: a small frontier is
    broadcast and leaves the large side where it is, one beyond spark.sql.autoBroadcastJoinThreshold is shuffled. With
    `by` there is a folder for each of its few values, so that filters on it prune files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    if by:
        _written_by(df, by, path)
    else:
        df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


#: Rows of a task that groups or orders rows: so tables that grow make more tasks, not larger ones.
PER_TASK = 500_000
#: Rows of a table that every executor may hold whole, as they pass through the driver.
FEW = 200_000


def dealt(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """rows in as many parts by their keys as PER_TASK asks for."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // PER_TASK)), *keys)


def held(rows: DataFrame, key: str, beside: int = 0) -> DataFrame:
    """rows, few of any one key, as the side of an equi join that is held in memory while the other side streams by unsorted.

    They are counted: up to FEW are broadcast, more are dealt by the key, in parts for `beside` rows if those are more.
    """
    n = rows.count()
    return F.broadcast(rows) if n <= FEW else dealt(rows, max(n, beside), key).hint("shuffle_hash")
