"""Sign-in throttling by address and account together.

A login is refused while its address or its account is locked, and a refused login changes nothing. So the verdicts of
an address depend on those of its accounts and the other way round, but each only on earlier logins: there is one
solution. It is found by turns: addresses are folded with the accounts' last verdicts, then accounts with the addresses',
and from the second turn on only keys with a login whose other verdict changed. Each turn is a shuffle by one key, whose
logins stream by in order; no group of connected addresses and accounts has to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.plans.staging import staged

#: The longest lock that any setting gives: 30 days.
MOST_LOCK_MS = 30 * 24 * 3_600_000
STATE = "failed int, locks int, until long, since long"


@dataclass(frozen=True)
class Limits:
    """Failures after which an address or an account is locked; how long, at most how long (only an address's locks double), and how long failures count."""

    per_address: int = 20
    per_account: int = 10
    lock_ms: int = 900_000
    longest_ms: int = 86_400_000
    window_ms: int = 900_000

    def lock(self, nth: int, doubles: bool) -> int:
        base = min(self.lock_ms, MOST_LOCK_MS)
        most = max(min(self.longest_ms, MOST_LOCK_MS), base)
        return min(base << min(nth - 1, 40), most) if doubles else base

    @property
    def kept_ms(self) -> int:
        """A key's failures and locks are forgotten so long after its first failure."""
        return max(self.window_ms, max(min(self.longest_ms, MOST_LOCK_MS), min(self.lock_ms, MOST_LOCK_MS)))


class Fold:
    """The state of one key over its logins in order."""

    def __init__(self, limits: Limits, failures: int, doubles: bool, state: tuple = (0, 0, 0, None)):
        self.limits, self.failures, self.doubles = limits, failures, doubles
        self.failed, self.locks, self.until, self.since = state

    def login(self, ts: int, success: bool, other: bool) -> bool:
        """Whether the key allows a login; other: whether the other key does."""
        if self.since is not None and ts - self.since >= self.limits.kept_ms:
            self.failed, self.locks, self.until, self.since = 0, 0, 0, None
        if ts < self.until:
            return False
        if other and success:
            self.failed, self.locks, self.until, self.since = 0, 0, 0, None
        elif other:
            self.since = ts if self.since is None else self.since
            self.failed += 1
            if self.failed >= self.failures:
                self.failed, self.locks = 0, self.locks + 1
                self.until = ts + self.limits.lock(self.locks, self.doubles)
        return True


def folded(rows: DataFrame, key: str, other: str, limits: Limits, failures: int, doubles: bool) -> DataFrame:
    """id, own (whether the key allows the login), and for each key a row without id that has its last state."""
    names = ["id", "key", "own", "failed", "locks", "until", "since"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, out = None, None, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for id_, k, ts, success, allowed, failed, locks, until, since in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or k != at:
                    if now is not None:
                        out.append((None, at, None, now.failed, now.locks, now.until, now.since))
                    now, at = Fold(limits, failures, doubles), k
                if id_ is None:
                    now = Fold(limits, failures, doubles, (failed, locks, until, since))
                else:
                    out.append((id_, k, now.login(ts, success, allowed), None, None, None, None))
            yield made()
        if now is not None:
            out.append((None, at, None, now.failed, now.locks, now.until, now.since))
        yield made()

    ordered = rows.repartition(key).sortWithinPartitions(key, F.col("ts_ms").asc_nulls_first(), "id").select("id", key, "ts_ms", "success", other, "failed", "locks", "until", "since")
    return ordered.mapInArrow(run, f"id long, key string, own boolean, {STATE}")


def guarded(logins: DataFrame, limits: Limits = Limits(), state: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:  # noqa: B008
    """Verdicts (id, address_allowed, account_allowed, allowed), the keys' last states, and the number of turns.

    logins: id (distinct), address, account, ts_ms, success; of one time, by id. A blank address is `unknown`; an account's
    spaces around it and its capitals don't count. state: kind (address or account), key and what a call before gave.
    """
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    address = F.when(text("address") == "", "unknown").otherwise(F.col("address").cast("string"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in STATE.split(", "))]
    rows = staged(logins.select("id", address.alias("address"), F.lower(text("account")).alias("account"), "ts_ms", "success", F.lit(True).alias("by_address"), F.lit(True).alias("by_account"), *none))
    sides = {"address": ("account", limits.per_address, True), "account": ("address", limits.per_account, False)}
    before = {k: state.where(F.col("kind") == k) if state is not None else None for k in sides}
    last: dict[str, DataFrame] = {}
    turns, side, keys = 0, "address", None
    while True:
        other, failures, doubles = sides[side]
        own = rows if keys is None else rows.join(keys, side, "left_semi")
        if before[side] is not None:
            held = before[side] if keys is None else before[side].join(keys.withColumnRenamed(side, "key"), "key", "left_semi")
            own = own.unionByName(held.select(F.lit(None).cast("long").alias("id"), F.col("key").alias(side), F.lit(None).cast("string").alias(other), F.lit(None).cast("long").alias("ts_ms"), F.lit(None).cast("boolean").alias("success"), F.lit(True).alias("by_address"), F.lit(True).alias("by_account"), "failed", "locks", "until", "since"))
        made = staged(folded(own, side, f"by_{other}", limits, failures, doubles))
        turns += 1
        states = made.where("id is null").select(F.lit(side).alias("kind"), "key", "failed", "locks", "until", "since")
        last[side] = states if side not in last else staged(states.unionByName(last[side].join(states.select("key"), "key", "left_anti").select(states.columns)))
        verdict = made.where("id is not null").select("id", "own")
        joined = rows.join(verdict, "id", "left").withColumn("changed", F.col("own").isNotNull() & (F.col("own") != F.col(f"by_{side}")))
        rows = staged(joined.withColumn(f"by_{side}", F.coalesce("own", f"by_{side}")).drop("own"))
        keys = rows.where("changed").select(other).distinct()
        rows = rows.drop("changed")
        if turns > 1 and keys.isEmpty():
            break
        if turns == 1:
            keys = None
        side = other
    verdicts = rows.select("id", F.col("by_address").alias("address_allowed"), F.col("by_account").alias("account_allowed"), (F.col("by_address") & F.col("by_account")).alias("allowed"))
    return verdicts, last["address"].unionByName(last["account"]), turns


def guard_batches(target: str, limits: Limits = Limits()):  # noqa: B008
    """A foreachBatch function: verdicts of each micro-batch of logins and the states after it, a folder for each batch.

    A batch that runs again starts from the same states and writes the same folders.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        state = batch.sparkSession.read.parquet(f"{target}/state/{batch_id - 1}") if batch_id else None
        verdicts, states, _ = guarded(batch, limits, state)
        if state is not None:
            idle = state.join(states.select("kind", "key"), ["kind", "key"], "left_anti")
            states = states.unionByName(idle.select(states.columns))
        verdicts.write.mode("overwrite").parquet(f"{target}/verdicts/{batch_id}")
        states.write.mode("overwrite").parquet(f"{target}/state/{batch_id}")

    return apply
