"""Accounts: searches of users, life cycles of keys, credits, trash, budgets of sign-ups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.telemetry import accepted_debits, tier_price


def searched_users(users: DataFrame, settings: DataFrame, text: str | None = None, plan: str | None = None, status: str | None = None) -> DataFrame:
    """Users (id, email, display_name, deactivated) with plan and blocked_at of their settings (user_id), filtered; None or an empty text is no filter.

    blocked: blocked_at is set. deactivated: the flag is set. active: neither, users without settings included. Another
    status finds no one. A user can be both blocked and deactivated.
    """
    u = users.join(settings.select(F.col("user_id").alias("id"), "plan", "blocked_at"), "id", "left")
    if text:
        u = u.where(F.contains(F.lower("email"), F.lit(text.lower())) | F.contains(F.lower("display_name"), F.lit(text.lower())))
    if plan:
        u = u.where(F.lower("plan") == plan.lower())
    if status:
        blocked = F.col("blocked_at").isNotNull()
        u = u.where({"blocked": blocked, "deactivated": F.col("deactivated"), "active": ~F.col("deactivated") & ~blocked}.get(status.lower(), F.lit(False)))
    return u


def user_page(users: DataFrame, settings: DataFrame, usage: DataFrame, offset: int, limit: int) -> DataFrame:
    """id, email, plan, storage_bytes of one page of users by id: settings and sums of usage (owner, bytes) are joined to the page alone, 0 without usage."""
    p = users.select("id", "email").orderBy("id").offset(offset).limit(limit)
    ids = p.select(F.col("id").alias("owner"))
    used = usage.join(F.broadcast(ids), "owner", "left_semi").groupBy(F.col("owner").alias("id")).agg(F.sum("bytes").alias("storage_bytes"))  # `limit` rows
    plans = settings.join(F.broadcast(ids), settings.user_id == ids.owner, "left_semi").select(F.col("user_id").alias("id"), "plan")  # `limit` rows
    return p.join(plans, "id", "left").join(used, "id", "left").select("id", "email", "plan", F.coalesce("storage_bytes", F.lit(0)).alias("storage_bytes"))


def live(keys: DataFrame) -> DataFrame:
    return keys.where("deleted_at is null")


def admin_locked_projects(keys: DataFrame) -> DataFrame:
    """project_id of the projects that have a live key which an administrator locked."""
    return live(keys).where("disabled_by = 'ADMIN'").select("project_id").distinct()


def changed_keys(keys: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """keys (id, user_id, disabled_at, disabled_by, deleted_at, ...) after at most one request (id, user_id, action) a key, and `changed`.

    disable, enable and delete are the owner's: each needs a live key of that user; what an administrator locked can't be
    disabled or deleted by its owner, and only what the user disabled can be enabled. lock and unlock are the
    administrator's, whatever the user; only what was locked can be unlocked. A request that may not be done changes nothing.
    """
    r = requests.select("id", F.col("user_id").alias("by"), "action")
    k = keys.join(r, "id", "left")
    own = F.col("by") == F.col("user_id")
    who = F.coalesce("disabled_by", F.lit(""))
    may = F.when(F.col("action").isin("disable", "delete"), own & (who != "ADMIN")).when(F.col("action") == "enable", own & (who == "USER")).when(F.col("action") == "unlock", who == "ADMIN").otherwise(F.col("action") == "lock")
    k = k.withColumn("changed", F.coalesce(F.col("deleted_at").isNull() & may, F.lit(False)))
    done = lambda *actions: F.col("changed") & F.col("action").isin(*actions)
    at = F.when(done("disable", "lock"), now).when(~done("enable", "unlock"), F.col("disabled_at"))
    by = F.when(done("disable"), "USER").when(done("lock"), "ADMIN").when(~done("enable", "unlock"), F.col("disabled_by"))
    gone = F.when(done("delete"), now).otherwise(F.col("deleted_at"))
    return k.withColumns({"disabled_at": at, "disabled_by": by, "deleted_at": gone}).drop("by", "action")


def remaining_credits(limit: Column, adjustment: Column, used: Column) -> Column:
    """limit + adjustment - used, in 64 bits; it may be negative."""
    return limit.cast("long") + adjustment.cast("long") - used.cast("long")


def import_charges(imports: DataFrame, tiers: DataFrame, balances: DataFrame) -> DataFrame:
    """user_id, id, credits, accepted of imports (user_id, id, n files), each charged before it runs by the tier of its files.

    A user's imports go in order of id against what balances (user_id, credits_limit, adjustment, used) leaves; one that
    the rest can't pay is refused and costs nothing. Without a balance or a tier an import is refused.
    """
    left = balances.select("user_id", remaining_credits(F.col("credits_limit"), F.col("adjustment"), F.col("used")).alias("credits_limit"))
    priced = tier_price(imports.select("user_id", "id", "n"), tiers).join(left, "user_id", "left")
    verdict = accepted_debits(priced.select("user_id", "id", F.col("credits").alias("amount"), "credits_limit"))
    return priced.select("user_id", "id", "credits").join(verdict, ["user_id", "id"])


def ledger(charges: DataFrame, operation: str, channel: str = "WEB") -> DataFrame:
    """Rows of the ledger for the charges that were accepted: user_id, id, operation, channel, credits_delta (negative)."""
    return charges.where("accepted").select("user_id", "id", F.lit(operation).alias("operation"), F.lit(channel).alias("channel"), (-F.col("credits")).alias("credits_delta"))


def purged(trash: DataFrame, cutoff: Column, batch: int = 200) -> DataFrame:
    """id of the projects (id, deleted_at, locked) that a sweep purges: those deleted before the cutoff that aren't locked, in batches, the oldest first.

    Locked projects stay at the front, and a batch that holds nothing else ends the sweep: so purged is what comes before
    the batch-th locked one, in order of time and id. That one is found by a top-k, not by walking through the batches.
    """
    expired = trash.where(F.col("deleted_at") < cutoff)
    stuck = expired.where("locked").select("deleted_at", "id").orderBy("deleted_at", "id").limit(batch)
    end = stuck.agg(F.count(F.lit(1)).alias("n_stuck"), F.max(F.struct("deleted_at", "id")).alias("last"))
    rest = expired.where(~F.coalesce("locked", F.lit(False))).crossJoin(F.broadcast(end))  # one row
    return rest.where((F.col("n_stuck") < batch) | (F.struct("deleted_at", "id") < F.col("last"))).select("id")


def sign_up_verdicts(attempts: DataFrame, limit: int, seconds: int) -> DataFrame:
    """id, address, nth, allowed, retry_after of sign-up attempts (id, address, at): the budget of an address in a window that its first attempt opens.

    A window ends `seconds` after it was opened, and the next attempt opens another. Refused attempts count too.
    retry_after is null or the seconds left, rounded up, 1 at least. Null and blank addresses share "unknown". An
    address's attempts stream by in order of time and id, and one window is all that is held.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, opened, n = None, 0, 0
        for b in batches:
            nth, allowed, wait = [], [], []
            for address, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if address != who or at >= opened + seconds * 1_000_000:
                    who, opened, n = address, at, 0
                n += 1
                left = opened + seconds * 1_000_000 - at
                nth.append(n)
                allowed.append(n <= limit)
                wait.append(None if n <= limit else max(1, -(-left // 1_000_000)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nth, pa.int64()), pa.array(allowed, pa.bool_()), pa.array(wait, pa.int64())], ["id", "address", "nth", "allowed", "retry_after"])

    address = F.coalesce(F.when(F.trim("address") != "", F.col("address")), F.lit("unknown"))
    rows = attempts.select(F.col("id").cast("long").alias("id"), address.alias("address"), F.unix_micros(F.col("at").cast("timestamp")).alias("at")).where("at is not null")
    return rows.repartition("address").sortWithinPartitions("address", "at", "id").mapInArrow(fold, "id long, address string, nth long, allowed boolean, retry_after long")
