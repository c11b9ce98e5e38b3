"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session (as in tests) gets a temporary folder, and any other is refused: executors could
    not read what is written to a folder of the driver's machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it back, which cuts its lineage.

    The files survive the loss of executors. They are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(keep: list[str], made: list[str]) -> list[str]:
    """keep without the names of what an operator makes itself: there the operator's own column stands."""
    return [c for c in keep if c.lower() not in {m.lower() for m in made}]


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def map_rows(df: DataFrame, fn: Callable[[list], Iterator[list]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow over lists of columns.

    fn gets each batch as one list per column, at most `rows` rows at a time (which bounds Python's
    memory whatever the batch size of Arrow), and yields output columns in the order of schema.
    """
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                for columns in fn([c.to_pylist() for c in part.columns]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=arrow.field(k).type) for k, c in zip(names, columns, strict=True)], schema=arrow
                    )

    return df.mapInArrow(run, out)
