"""Structured Streaming over change and request events.

Windows and debouncing go by the events' own times, under a watermark, so a replay gives the same result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from codeloom.plans.staging import staged

#: Folders that a watcher leaves out, and endings of the files that it watches.
IGNORED_FOLDERS = ("target", "build", ".git", ".idea", "node_modules")
WATCHED = (".java",)


def stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that come to a folder."""
    return spark.readStream.schema(schema).parquet(path)


def watched(changes: DataFrame, ignored: tuple[str, ...] = IGNORED_FOLDERS, endings: tuple[str, ...] = WATCHED) -> DataFrame:
    """Changes of watched files that lie in no ignored folder, at whatever depth."""
    parts = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    inside = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*ignored))
    return changes.where(~inside & F.coalesce(*[F.when(F.endswith("path", F.lit(e)), F.lit(True)) for e in endings], F.lit(False)))


class Debounce(StatefulProcessor):
    """The open burst of a project: the last change of each path, until no change has come for the gap in event time."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "first_ms long, last_ms long")
        self.last = handle.getMapState("last", "path string", "ts_ms long, type string")

    def burst(self, key, span):
        rows = [(key[0], span[0], span[1] + self.gap_ms, path, value[1]) for (path,), value in self.last.iterator()]
        self.last.clear()
        self.span.clear()
        return pd.DataFrame(rows, columns=["project", "first_ms", "end_ms", "path", "type"])

    def handleInputRows(self, key, rows, timerValues):
        span = self.span.get() if self.span.exists() else None
        for e in pd.concat(list(rows)).sort_values(["ts_ms", "path", "type"]).itertuples():
            if span is not None and e.ts_ms >= span[1] + self.gap_ms:
                yield self.burst(key, span)
                span = None
            span = (e.ts_ms if span is None else min(span[0], e.ts_ms), e.ts_ms if span is None else max(span[1], e.ts_ms))
            held = self.last.getValue((e.path,)) if self.last.containsKey((e.path,)) else None
            if held is None or (held[0], held[1]) <= (e.ts_ms, e.type):
                self.last.updateValue((e.path,), (int(e.ts_ms), e.type))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.span.update((int(span[0]), int(span[1])))
        self.handle.registerTimer(int(span[1] + self.gap_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.span.exists():
            yield self.burst(key, self.span.get())

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """project, session_start, session_end, path, type: the last change of each path within a burst of a project's changes.

    A burst ends when no change follows within the gap. Its state is one row for each path, however often a path changes.
    """
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    rows = changes.withWatermark("ts", late).withColumn("ts_ms", F.unix_millis("ts"))
    out = rows.groupBy("project").transformWithStateInPandas(Debounce(gap_ms), "project string, first_ms long, end_ms long, path string, type string", "Append", "EventTime")
    return out.select("project", F.timestamp_millis("first_ms").alias("session_start"), F.timestamp_millis("end_ms").alias("session_end"), "path", "type")


def debounced_rows(changes: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """The same for a table at rest, its last bursts included: bursts are told apart by the gaps before changes, then each path keeps its last."""
    w = Window.partitionBy("project").orderBy("ts")
    apart = F.coalesce(F.col("ts") >= F.lag("ts").over(w) + F.expr(f"interval {gap}"), F.lit(True))
    nth = changes.withColumn("apart", apart.cast("int")).withColumn("burst", F.sum("apart").over(w))
    each = nth.groupBy("project", "burst", "path").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max(F.struct("ts", "type")).alias("c"))
    span = each.groupBy("project", "burst").agg(F.min("first").alias("session_start"), (F.max("last") + F.expr(f"interval {gap}")).alias("session_end"))
    return each.join(span, ["project", "burst"]).select("project", "session_start", "session_end", "path", "c.type")


def bursts(changes: DataFrame, key: str, gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """key, session_start, n of each burst."""
    w = F.session_window("ts", gap)
    g = changes.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), "n")


def per_window(events: DataFrame, key: str, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """key, window_start, n: events of each key in fixed windows, for limits on their rate."""
    g = events.withWatermark("ts", late).groupBy(key, F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("window_start"), "n")


def deduplicated(events: DataFrame, key: str, late: str = "1 minute") -> DataFrame:
    """Events once a key, as long as copies come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def online_series(samples: DataFrame, late: str = "1 minute") -> DataFrame:
    """minute, value: the last sample of each minute; the reader keeps the last ten."""
    g = samples.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w")).agg(F.max_by("value", "ts").alias("value"))
    return g.select(F.col("w.start").alias("minute"), "value")


def unblocked(events: DataFrame, blocks: DataFrame, now) -> DataFrame:
    """A stream without events from addresses that are blocked now: active, and without an end or with one still to come."""
    active = blocks.where(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).select("ip_address")
    return events.join(active, "ip_address", "left_anti")


class LoginThrottle(StatefulProcessor):
    """Verdicts on logins of a key: so many failures lock it, each lock twice as long as the one before; a success forgets all."""

    def __init__(self, failures: int = 5, lock_ms: int = 60_000, longest_ms: int = 3_600_000):
        self.failures, self.lock_ms, self.longest_ms = failures, lock_ms, longest_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "failed int, locks int, until long")

    def handleInputRows(self, key, rows, timerValues):
        failed, locks, until = self.state.get() if self.state.exists() else (0, 0, 0)
        out = []
        events = pd.concat(list(rows)).sort_values(["ts_ms", "id"])
        for e in events.itertuples():
            allowed = e.ts_ms >= until
            if allowed and e.success:
                failed, locks, until = 0, 0, 0
            elif allowed:
                failed += 1
                if failed >= self.failures:
                    until = e.ts_ms + min(self.lock_ms * 2**locks, self.longest_ms)
                    failed, locks = 0, locks + 1
            out.append((key[0], e.id, allowed))
        self.state.update((failed, locks, until))
        yield pd.DataFrame(out, columns=["key", "id", "allowed"])

    def close(self) -> None:
        pass


def throttled(logins: DataFrame, **limits: int) -> DataFrame:
    """key, id, allowed of logins (key, id, ts_ms, success), in a stream or at rest."""
    return logins.groupBy("key").transformWithStateInPandas(LoginThrottle(**limits), "key string, id long, allowed boolean", "Append", "None")


def throttled_rows(logins: DataFrame, failures: int = 5, lock_ms: int = 60_000, longest_ms: int = 3_600_000) -> DataFrame:
    """The same verdicts for a table at rest: each key's logins stream by in order, so a key may have any number of them."""
    import pyarrow as pa

    key_type = logins.schema["key"].dataType.simpleString()

    def run(batches):
        at, state = None, None
        for batch in batches:
            keys, ids, allowed_ = [], [], []
            for key, ts, id_, success in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or key != at:
                    at, state = key, (0, 0, 0)
                failed, locks, until = state
                allowed = ts >= until
                if allowed and success:
                    failed, locks, until = 0, 0, 0
                elif allowed:
                    failed += 1
                    if failed >= failures:
                        until, failed, locks = ts + min(lock_ms * 2 ** min(locks, 60), longest_ms), 0, locks + 1
                state = failed, locks, until
                keys.append(key), ids.append(id_), allowed_.append(allowed)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(ids, pa.int64()), pa.array(allowed_, pa.bool_())], names=["key", "id", "allowed"])

    ordered = logins.repartition("key").sortWithinPartitions("key", "ts_ms", "id").select("key", F.col("ts_ms").cast("long"), F.col("id").cast("long"), "success")
    return ordered.mapInArrow(run, f"key {key_type}, id long, allowed boolean")


KEY_BUCKETS = 32


def upsert_latest(target: str, key: str, at: str, buckets: int = KEY_BUCKETS):
    """A foreachBatch function that keeps the latest row of each key; `latest_of` reads them.

    Keys are dealt over buckets, and a batch writes only the buckets that it has rows of, each as the version of the batch. A
    batch that runs again starts from the versions before it and writes the same, so nothing is counted twice.
    """
    from codeloom.operators.telemetry import latest_rows

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        before = _versions(batch.sparkSession, target, batch_id)
        held = {b: v for b, v in before.items() if b in touched}
        if held:
            old = batch.sparkSession.read.schema(batch.schema).parquet(*[f"{target}/bucket={b}/{v}" for b, v in held.items()])
            rows = rows.drop("bucket").unionByName(old).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        kept = staged(latest_rows(rows, key, at), "bucket")
        for b in touched:
            kept.where(F.col("bucket") == b).select(batch.columns).coalesce(1).write.mode("overwrite").parquet(f"{target}/bucket={b}/{batch_id}")

    return apply


def _versions(spark: SparkSession, target: str, before: int) -> dict[int, int]:
    """The last version of each bucket that was written by a batch before the given one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket=*/*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    out: dict[int, int] = {}
    for status in found:
        at = status.getPath()
        version, bucket = at.getName(), at.getParent().getName().partition("=")[2]
        if version.isdigit() and int(version) < before:
            out[int(bucket)] = max(out.get(int(bucket), -1), int(version))
    return out


def latest_of(spark: SparkSession, target: str, schema: str, before: int = 1 << 62) -> DataFrame:
    """What upsert_latest keeps: the latest row of each key."""
    paths = [f"{target}/bucket={b}/{v}" for b, v in _versions(spark, target, before).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
