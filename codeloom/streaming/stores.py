"""A sink that keeps good rows and sets bad ones apart, and a store of windows whose entries expire."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from codeloom.plans.staging import staged

#: Ranges of hashed keys that a failing batch may be cut into, as a logarithm: rows that share the last range go together.
HALVINGS = 40


def halving_sink(target: str, key: str, prepare: Callable[[DataFrame], DataFrame], retries: int = 2, most_bad: int = 1_000):
    """A foreachBatch function: prepare(rows) of each batch is written under target/good, rows for which it fails under target/bad.

    A part of a batch is tried retries + 1 times. One that still fails is halved by the hash of the key until the rows that
    make it fail are alone; after most_bad of these the failing parts that are left go to the bad rows whole. Every part has
    a folder of its own under the batch's and is overwritten by a batch that runs again; a batch that has its mark is done.
    `kept` and `refused` read what marked batches left.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/done/{batch_id}")
        fs = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(mark):
            return
        for part in ("good", "bad"):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{part}/batch={batch_id}"), True)  # of a run that broke off
        rows = staged(batch.withColumn("__at", F.shiftrightunsigned(F.xxhash64(key), 64 - HALVINGS)))
        todo, bad = [(0, 1 << HALVINGS)], 0
        while todo:
            low, high = todo.pop()
            part = rows.where((F.col("__at") >= low) & (F.col("__at") < high)).drop("__at")
            if low and part.isEmpty():
                continue
            error = _tried(lambda part=part, low=low, high=high: prepare(part).write.mode("overwrite").parquet(f"{target}/good/batch={batch_id}/part={low}-{high}"), retries)
            if error is None:
                continue
            alone = high - low == 1 or len(part.take(2)) < 2
            if alone or bad >= most_bad:
                part.withColumn("error", F.lit(error)).write.mode("overwrite").parquet(f"{target}/bad/batch={batch_id}/part={low}-{high}")
                bad += 1
            else:
                middle = (low + high) // 2
                todo += [(middle, high), (low, middle)]
        fs.create(mark, True).close()

    return apply


def _tried(write: Callable[[], None], retries: int) -> str | None:
    """None once write() has ended well, else its last error in short."""
    error = None
    for _ in range(retries + 1):
        try:
            write()
            return None
        except Exception as e:  # noqa: BLE001 - whatever the rows or the sink raise is told beside the rows
            error = (str(e).strip().splitlines() or [type(e).__name__])[0][:300]
    return error


def written(spark, target: str, part: str, schema: str) -> DataFrame:
    """The rows under target/good or target/bad of the batches that have their mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/done/*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = []
    for s in fs.globStatus(path) or []:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{part}/batch={s.getPath().getName()}/*")
        folders += [x.getPath().toString() for x in fs.globStatus(at) or [] if x.isDirectory()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


class WindowStore(StatefulProcessor):
    """A key's count in its current window; an entry that is not written for ttl_ms is gone."""

    def __init__(self, limit: int, window_ms: int, ttl_ms: int):
        self.limit, self.window_ms, self.ttl_ms = limit, window_ms, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("window", "start long, n long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        start, n = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for e in pd.concat(list(rows)).sort_values(["ts_ms", "id"]).itertuples():
            at = int(e.ts_ms) // self.window_ms * self.window_ms
            if start is None or at > start:
                start, n = at, 0
            n += 1
            out.append((key[0], e.id, n, n <= self.limit))
        self.state.update((start, n))
        yield pd.DataFrame(out, columns=["key", "id", "n", "allowed"])

    def close(self) -> None:
        pass


def window_verdicts(requests: DataFrame, limit: int = 120, window_ms: int = 60_000, ttl_ms: int = 180_000) -> DataFrame:
    """key, id, n, allowed of a stream of requests (key, id, ts_ms): the request's number in its key's window, and whether it is within the limit.

    Keys of idle clients leave the store after ttl_ms; the number of keys has no other bound.
    """
    return requests.groupBy("key").transformWithStateInPandas(WindowStore(limit, window_ms, ttl_ms), "key string, id long, n long, allowed boolean", "Append", "ProcessingTime")
