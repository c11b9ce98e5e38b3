"""Versions and their changes as a stream, the halving sink and the store of windows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codeloom.sources import snapshots
from codeloom.streaming import stores


def files(spark, names):
    return spark.createDataFrame([(p, h, 1) for p, h in names.items()], "path string, sha256 string, size int")


def test_versions_are_published_once_and_read_whole(spark, tmp_path):
    root = f"file://{tmp_path}"
    for k in range(1, 12):  # v10 comes after v9
        assert snapshots.publish(files(spark, {"a": str(k)}), root) == k
    assert snapshots.versions(spark, root) == list(range(1, 12)) and snapshots.at(spark, root).first().sha256 == "11" and snapshots.at(spark, root, 9).first().sha256 == "9"
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(files(spark, {"a": "x"}), root, expected=10)
    (tmp_path / "pointers" / "12").write_text("")  # another writer that has its pointer but not yet its name
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(files(spark, {"a": "x"}), root, expected=11)
    assert snapshots.at(spark, root).first().sha256 == "11" and len(list((tmp_path / "versions").iterdir())) == 11
    with pytest.raises(ValueError):
        snapshots.at(spark, root, 40)


def test_changes_stream_by_version_and_replay(spark, tmp_path):
    root = str(tmp_path / "s")
    rng = random.Random(1)
    states = [{f"p{k}": str(rng.randint(0, 2)) for k in rng.sample(range(60), 40)} for _ in range(4)]
    want, before = set(), {}
    for n, s in enumerate(states, 1):
        want |= {(n, p, "CREATE" if p not in before else "MODIFY", h) for p, h in s.items() if before.get(p) != h} | {(n, p, "DELETE", None) for p in before if p not in s}
        before = s
    assert {(r.path, r.type) for r in snapshots.changes(files(spark, states[0]), files(spark, states[1])).collect()} == {(p, t) for n, p, t, _ in want if n == 2}

    def run(name):
        q = snapshots.change_stream(spark, root).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {tuple(r) for r in spark.read.schema(snapshots.CHANGES).parquet(str(tmp_path / name)).collect()}

    for s in states[:2]:
        snapshots.publish(files(spark, s), root)
    assert run("one") == {w for w in want if w[0] <= 2}
    for s in states[2:]:
        snapshots.publish(files(spark, s), root)
    assert run("one") == want and run("again") == want


def test_bad_rows_are_set_apart_and_good_ones_written_once(spark, tmp_path):
    bad = {7, 300, 301}
    rows = spark.range(500).select("id", F.when(F.col("id").isin(*bad), "no number").otherwise(F.col("id").cast("string")).alias("v"))
    calls = []

    def prepare(df):
        calls.append(1)
        return df.select("id", F.expr("if(try_cast(v as int) is null, raise_error('bad value'), cast(v as int))").alias("v"))

    apply = stores.halving_sink(str(tmp_path), "id", prepare, retries=0)
    apply(rows, 0)
    n = len(calls)
    apply(rows, 0)  # a batch that is done changes nothing
    assert len(calls) == n < 80
    apply(spark.range(1000, 1010).select("id", F.col("id").cast("string").alias("v")), 1)
    good = [r.id for r in stores.written(spark, str(tmp_path), "good", "id long, v int").collect()]
    assert sorted(good) == sorted(set(range(500)) - bad | set(range(1000, 1010)))
    refused = stores.written(spark, str(tmp_path), "bad", "id long, v string, error string").collect()
    assert {r.id for r in refused} == bad and all("bad value" in r.error or r.error for r in refused)
    whole = stores.halving_sink(str(tmp_path / "x"), "id", prepare, retries=0, most_bad=0)
    whole(rows, 0)
    assert stores.written(spark, str(tmp_path / "x"), "bad", "id long").count() == 500
    apply(rows.limit(0), 2)
    assert stores.written(spark, str(tmp_path), "good", "id long").count() == len(good)


def test_a_flaky_sink_is_tried_again(spark, tmp_path):
    left = [2]

    def prepare(df):
        if left[0]:
            left[0] -= 1
            raise OSError("not now")
        return df

    stores.halving_sink(str(tmp_path), "id", prepare, retries=2)(spark.range(5), 0)
    assert stores.written(spark, str(tmp_path), "good", "id long").count() == 5 and stores.written(spark, str(tmp_path), "bad", "id long").count() == 0


def _out(spark, tmp_path):
    return spark.read.parquet(str(tmp_path / "out")).collect() if list((tmp_path / "out").glob("*.parquet")) and (tmp_path / "out" / "_spark_metadata" / "0").exists() else []


def test_windows_count_and_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(tmp_path / "in")

    def run(rows, ttl):
        spark.createDataFrame(rows, "key string, id long, ts_ms long").write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, id long, ts_ms long").parquet(source)
        q = stores.window_verdicts(stream, limit=2, ttl_ms=ttl).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        try:
            until = time.time() + 60  # state that expires keeps such a query going, so it is stopped once its rows are out
            while time.time() < until and not {k for _, k, _ in rows} <= {r.id for r in _out(spark, tmp_path)}:
                time.sleep(0.5)
        finally:
            q.stop()
        return {r.id: (r.n, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    got = run([("a", 1, 0), ("a", 2, 10), ("a", 3, 20), ("b", 4, 0), ("a", 5, 60_000)], 4_000)
    assert got == {1: (1, True), 2: (2, True), 3: (3, False), 4: (1, True), 5: (1, True)}
    time.sleep(6)
    got = run([("a", 6, 60_001), ("b", 7, 30)], 4_000)  # the same windows, but the store has forgotten them
    assert (got[6], got[7]) == ((1, True), (1, True))
