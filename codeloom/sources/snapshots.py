"""Versions of a table of files, and the changes between them as a stream.

A version is written whole and then gets a numbered pointer that must not exist yet, so of two writers that start from one
version only one wins, and readers see all of a version or nothing of it. The stream's offsets are the numbers of versions:
a replay from an old offset compares the same versions and gives the same rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Parts of a version by the hash of a path: a part is compared with the same part of another version.
BUCKETS = 16
CHANGES = "version long, path string, type string, sha256 string"


class Conflict(Exception):
    """Another writer published the version first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all published versions, in order."""
    fs, p = _fs(spark, f"{root}/pointers/*")
    found = fs.globStatus(p) or []
    return sorted(int(s.getPath().getName()) for s in found if s.getLen() > 0)


def publish(files: DataFrame, root: str, expected: int | None = None, buckets: int = BUCKETS) -> int:
    """Writes files (path, sha256, and whatever else) as the next version and returns its number.

    expected: the version that the writer started from (0: none), by default the last one. If another writer published a
    version after it, nothing becomes current and Conflict is raised.
    """
    spark = files.sparkSession
    last = versions(spark, root)[-1:] or [0]
    before = last[0] if expected is None else expected
    if before != last[0]:
        raise Conflict(f"version {last[0]} came after {before}")
    number, name = before + 1, f"{before + 1}-{uuid.uuid4().hex}"
    files.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")).write.mode("errorifexists").partitionBy("bucket").parquet(f"{root}/versions/{name}")
    fs, pointer = _fs(spark, f"{root}/pointers/{number}")
    try:
        out = fs.create(pointer, False)
    except Exception as e:
        data = _fs(spark, f"{root}/versions/{name}")[1]
        fs.delete(data, True)  # what this call wrote
        raise Conflict(f"version {number} exists already") from e
    out.write(bytearray(json.dumps({"name": name, "buckets": buckets}).encode()))
    out.close()
    return number


def _pointer(spark: SparkSession, root: str, number: int) -> dict:
    text = spark.read.text(f"{root}/pointers/{number}").first()
    return json.loads(text[0])


def at(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The files of a version, by default of the last one."""
    numbers = versions(spark, root)
    if not numbers or number is not None and number not in numbers:
        raise ValueError(f"no version {number or ''} under {root}")
    return spark.read.parquet(f"{root}/versions/{_pointer(spark, root, number or numbers[-1])['name']}").drop("bucket")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, type, sha256 of what differs between two tables of files: CREATE, MODIFY or DELETE."""
    b, a = before.select("path", F.col("sha256").alias("old"), F.lit(1).alias("b")), after.select("path", "sha256", F.lit(1).alias("a"))
    kind = F.when(F.col("b").isNull(), "CREATE").when(F.col("a").isNull(), "DELETE").when(~F.col("old").eqNullSafe(F.col("sha256")), "MODIFY")
    return b.join(a, "path", "full").select("path", kind.alias("type"), "sha256").where("type is not null")


class Part(InputPartition):
    def __init__(self, version: int, before: str | None, after: str, bucket: int):
        self.version, self.before, self.after, self.bucket = version, before, after, bucket


class ChangeReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def _pointers(self) -> dict[int, dict]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        found = system.get_file_info(fs.FileSelector(f"{path}/pointers", allow_not_found=True))
        return {int(f.base_name): json.loads(system.open_input_file(f.path).readall()) for f in found if f.base_name.isdigit() and f.size}

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": max(self._pointers(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        known = self._pointers()
        out = []
        for n in range(start["version"] + 1, end["version"] + 1):
            before = known.get(n - 1)
            out += [Part(n, before and before["name"], known[n]["name"], b) for b in range(known[n]["buckets"])]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        old, new = self._files(part.before, part.bucket), self._files(part.after, part.bucket)
        rows = [(part.version, p, "MODIFY" if p in old else "CREATE", h) for p, h in new.items() if p not in old or old[p] != h]
        rows += [(part.version, p, "DELETE", None) for p in old if p not in new]
        rows.sort(key=lambda r: r[1])
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["version", "path", "type", "sha256"])

    def _files(self, name: str | None, bucket: int) -> dict[str, str | None]:
        from pyarrow import dataset, fs

        if name is None:
            return {}
        system, path = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        at_ = f"{path}/versions/{name}/bucket={bucket}"
        if system.get_file_info(at_).type == fs.FileType.NotFound:
            return {}
        t = dataset.dataset(at_, filesystem=system, format="parquet").to_table(columns=["path", "sha256"])
        return dict(zip(t["path"].to_pylist(), t["sha256"].to_pylist(), strict=True))


class SnapshotChanges(DataSource):
    """A stream of version, path, type (CREATE, MODIFY or DELETE) and sha256, from the option path: the root of the versions.

    Versions of one number of buckets are compared part by part, each part by one task that holds its paths.
    """

    @classmethod
    def name(cls) -> str:
        return "snapshot_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options["path"])


def change_stream(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(SnapshotChanges)
    return spark.readStream.format("snapshot_changes").option("path", root).load()
