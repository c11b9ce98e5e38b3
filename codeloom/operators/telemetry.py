"""Reports on request events, ledgers and users."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.scalars import PRIVATE_ADDRESS, period_label
from codeloom.plans.staging import staged

PERIODS = ("day", "month", "quarter", "year")


def top_users(events: DataFrame, since: Column, limit: int) -> DataFrame:
    """user_id, api_key_ref, minute_bucket, request_count: the busiest pairs since a time; a null in one of the two is a group of its own."""
    e = events.where((F.col("occurred_at") >= since) & (F.col("user_id").isNotNull() | F.col("api_key_ref").isNotNull()))
    g = e.groupBy("user_id", "api_key_ref").agg(F.max(F.date_trunc("minute", "occurred_at")).alias("minute_bucket"), F.count(F.lit(1)).alias("request_count"))
    return g.orderBy(F.desc("request_count"), F.asc_nulls_first("user_id"), F.asc_nulls_first("api_key_ref")).limit(limit)


def top_addresses(events: DataFrame, since: Column, limit: int) -> DataFrame:
    g = events.where(F.col("occurred_at") >= since).groupBy("ip_address").agg(F.max(F.date_trunc("minute", "occurred_at")).alias("minute_bucket"), F.count(F.lit(1)).alias("request_count"))
    return g.orderBy(F.desc("request_count"), "ip_address").limit(limit)


def suspicious_networks(events: DataFrame, since: Column, limit: int, health: str = "/actuator/health") -> DataFrame:
    """Busiest public addresses with their distinct users and keys; health checks and unknown addresses don't count."""
    e = events.where((F.col("occurred_at") >= since) & (F.col("ip_address") != "unknown") & (F.col("route") != health) & ~F.col("ip_address").rlike(PRIVATE_ADDRESS))
    g = e.groupBy("ip_address").agg(
        F.max(F.date_trunc("minute", "occurred_at")).alias("minute_bucket"), F.count(F.lit(1)).alias("total_requests"),
        F.countDistinct("user_id").alias("unique_users"), F.countDistinct("api_key_ref").alias("unique_api_keys"),
    )
    return g.orderBy(F.desc("total_requests"), "ip_address").limit(limit)


def network_breakdown(events: DataFrame, since: Column, addresses: DataFrame, health: str = "/actuator/health") -> DataFrame:
    """ip_address, user_id, api_key_ref, requests of the addresses given."""
    e = events.where((F.col("occurred_at") >= since) & (F.col("route") != health)).join(addresses.select("ip_address"), "ip_address", "left_semi")
    return e.groupBy("ip_address", "user_id", "api_key_ref").agg(F.count(F.lit(1)).alias("requests"))


def network_alerts(events: DataFrame, since: Column, users: DataFrame, limit: int) -> DataFrame:
    """ip_address, total_requests, user_id, api_key_ref, requests, email: the busiest public addresses with who asked from them.

    users: id, email. A user that is not known, and requests without one, have no email.
    """
    top = staged(suspicious_networks(events, since, limit))
    rows = network_breakdown(events, since, top).join(F.broadcast(top.select("ip_address", "total_requests")), "ip_address")  # `limit` rows
    known = users.select(F.col("id").alias("user_id"), "email")
    return rows.join(known, "user_id", "left").select("ip_address", "total_requests", "user_id", "api_key_ref", "requests", "email")


def security_summary(events: DataFrame, since: Column) -> DataFrame:
    return events.where(F.col("created_at") >= since).groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at"))


def period_series(rows: DataFrame, at: Column, value: Callable[[], Column], periods: tuple[str, ...] = PERIODS) -> DataFrame:
    """period, label, value: one aggregate at several grains, in one pass over the rows.

    Rows are summed by day first; the coarser grains sum days, so the value must be a sum or a count.
    """
    day = rows.where(at.isNotNull()).groupBy(F.to_date(at).alias("day")).agg(value().alias("value"))
    grains = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), period_label(F.col("day"), p).alias("label")) for p in periods])).alias("g")
    return day.select("value", grains).groupBy("g.period", "g.label").agg(F.sum("value").alias("value"))


def consumption(ledger: DataFrame) -> DataFrame:
    """Credits spent by day, month, quarter and year."""
    return period_series(ledger.where("credits_delta < 0"), F.col("created_at"), lambda: F.sum(F.abs("credits_delta")))


def growth(users: DataFrame) -> DataFrame:
    """New users by month, quarter and year."""
    return period_series(users, F.col("created_at"), lambda: F.count(F.lit(1)), PERIODS[1:])


def dense_series(daily: DataFrame) -> DataFrame:
    """day, value: the days of the latest month that has any, those without a row as 0."""
    last = daily.agg(F.max("day").alias("last"))
    spine = last.select(F.explode(F.sequence(F.trunc("last", "month"), F.last_day("last"))).alias("day"))
    return spine.join(daily, "day", "left").select("day", F.coalesce("value", F.lit(0)).alias("value"))


def dense_months(monthly: DataFrame, months: int = 12) -> DataFrame:
    """month, value: the last `months` months up to the latest that has a row, gaps as 0; monthly has the first day of months."""
    last = monthly.agg(F.max("month").alias("last"))
    spine = last.select(F.explode(F.sequence(F.add_months("last", 1 - months), F.col("last"), F.expr("interval 1 month"))).alias("month"))
    return spine.join(monthly, "month", "left").select("month", F.coalesce("value", F.lit(0)).alias("value"))


def dense_quarters(daily: DataFrame) -> DataFrame:
    """quarter, value: the four quarters of the latest year that has a day, those without a row as 0."""
    last = daily.agg(F.max(F.year("day")).alias("year"))
    spine = last.select("year", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("quarter"))
    sums = daily.groupBy(F.year("day").alias("year"), F.quarter("day").alias("quarter")).agg(F.sum("value").alias("value"))
    return spine.join(sums, ["year", "quarter"], "left").select("quarter", F.coalesce("value", F.lit(0)).alias("value"))


def dense_years(daily: DataFrame, now: Column, years: int = 5) -> DataFrame:
    """year, value: the last `years` years up to that of now, those without a row as 0."""
    spine = daily.sparkSession.range(1).select(F.explode(F.sequence(F.year(now) - years + 1, F.year(now))).alias("year"))
    sums = daily.groupBy(F.year("day").alias("year")).agg(F.sum("value").alias("value"))
    return spine.join(sums, "year", "left").select("year", F.coalesce("value", F.lit(0)).alias("value"))


def storage(projects: DataFrame, limit: int) -> DataFrame:
    """owner, used_bytes, projects: the owners that hold most; null sizes count as 0."""
    g = projects.groupBy("owner").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("used_bytes"), F.count(F.lit(1)).alias("projects"))
    return g.orderBy(F.desc("used_bytes"), "owner").limit(limit)


def storage_of(projects: DataFrame, owners: DataFrame) -> DataFrame:
    """owner, used_bytes of the owners given; those that hold nothing have 0."""
    used = projects.join(owners.select("owner"), "owner", "left_semi").groupBy("owner").agg(F.sum("bytes").alias("used_bytes"))
    return owners.select("owner").distinct().join(used, "owner", "left").select("owner", F.coalesce("used_bytes", F.lit(0)).alias("used_bytes"))


def top_projects(projects: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """project, name, used_bytes: the projects that hold most, then by id; one without a name (project, name), or with a blank one, goes by its id."""
    top = projects.select("project", F.col("bytes").alias("used_bytes")).orderBy(F.desc("used_bytes"), "project").limit(limit)
    return top.join(names, "project", "left").select("project", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("project").cast("string")).alias("name"), "used_bytes")


def latest_events(events: DataFrame, minutes: int, limit: int, now: Column) -> DataFrame:
    """The latest events of the last minutes (1 to 1440), 1 to 200 of them."""
    span = F.make_interval(mins=F.lit(max(1, min(1440, minutes))))
    return events.where(F.col("occurred_at") >= now - span).orderBy(F.desc("occurred_at"), F.desc("id")).limit(max(1, min(200, limit)))


def retained(events: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows whose time is within `days` of now; those at the cutoff stay, those without a time go."""
    return events.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def inserted(target: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a batch that the target lacks, one a key: inserting them again changes nothing."""
    return batch.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def latest_rows(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key; of rows of one time the greatest."""
    others = [c for c in rows.columns if c not in (key, at)]
    return rows.groupBy(key).agg(F.max(F.struct(at, *others)).alias("r")).select(key, f"r.{at}", *[f"r.{c}" for c in others])


def visible_announcements(announcements: DataFrame, dismissed: DataFrame, role: str, now: Column) -> DataFrame:
    """Announcements that are active, meant for the role or for all, within their window, and that the user hasn't dismissed."""
    open_ = F.col("active") & F.col("target").isin("ALL", role) & (F.col("starts_at").isNull() | (F.col("starts_at") <= now)) & (F.col("ends_at").isNull() | (F.col("ends_at") > now))
    return announcements.where(open_).join(dismissed.select("id"), "id", "left_anti")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows and n_total, the number of all rows."""
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_total"))))  # one row


def fold_filters(rows: DataFrame, *, equal: dict | None = None, contains: dict | None = None, between: dict | None = None) -> DataFrame:
    """The conjunction of the filters that are given; a None value is no filter. Times are a closed range, text ignores case."""
    for c, v in (equal or {}).items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    for c, v in (contains or {}).items():
        rows = rows if v is None else rows.where(F.contains(F.lower(c), F.lit(v.lower())))
    for c, (lo, hi) in (between or {}).items():
        rows = rows if lo is None else rows.where(F.col(c) >= lo)
        rows = rows if hi is None else rows.where(F.col(c) <= hi)
    return rows


def tier_price(orders: DataFrame, tiers: DataFrame) -> DataFrame:
    """orders (n and any other columns) with the credits of the tier of the least max_files that is at least n; a null max_files has no end.

    The price list is summed to one sorted array, and each order takes the first tier that holds it: no shuffle of orders,
    and equal orders stay apart. Of tiers with one end the cheapest counts; an order that no tier holds has null credits.
    """
    top = F.coalesce(F.col("max_files"), F.lit(2**63 - 1))
    prices = tiers.agg(F.array_sort(F.collect_list(F.struct(top.alias("top"), "credits"))).alias("__tiers"))
    first = F.try_element_at(F.filter("__tiers", lambda t: t["top"] >= F.col("n")), F.lit(1))
    return orders.crossJoin(F.broadcast(prices)).withColumn("credits", first["credits"]).drop("__tiers")  # one row


def in_period(events: DataFrame, periods: DataFrame, key: str = "user_id") -> DataFrame:
    """events (key, day) with the period_start of the key's period that holds the day, both its ends included."""
    return events.join(periods, key).where(F.col("day").between(F.col("period_start"), F.col("period_end")))


def over_limit(events: DataFrame, key: str, limit: int, window: str = "minute") -> DataFrame:
    """Events beyond the limit of their key in a fixed window, in order of time and id."""
    w = Window.partitionBy(key, F.date_trunc(window, "occurred_at")).orderBy("occurred_at", "id")
    return events.withColumn("nth", F.row_number().over(w)).where(F.col("nth") > limit)


def reconciliation(left: DataFrame, right: DataFrame, at: str, key: str) -> DataFrame:
    """n_left, n_right, first_at, last_at, only_left, only_right, same: two stores by count, bounds, missing keys and an order-free checksum."""
    columns = sorted(left.columns)

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min(at).alias(f"first_{name}"), F.max(at).alias(f"last_{name}"), F.bit_xor(F.xxhash64(*columns)).alias(f"x_{name}"))

    missing = [a.join(b.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias(n)) for a, b, n in ((left, right, "only_left"), (right, left, "only_right"))]
    out = side(left, "left").crossJoin(F.broadcast(side(right, "right")))  # one row each
    for m in missing:
        out = out.crossJoin(F.broadcast(m))
    same = (F.col("n_left") == F.col("n_right")) & (F.coalesce("x_left", F.lit(0)) == F.coalesce("x_right", F.lit(0)))
    return out.withColumn("same", same).drop("x_left", "x_right")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: added, modified or deleted files of two snapshots (path, sha256)."""
    b, a = before.select("path", F.col("sha256").alias("old")), after.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return b.join(a, "path", "full").select("path", change.alias("change")).where("change is not null")


def accepted_debits(debits: DataFrame) -> DataFrame:
    """user_id, id, accepted: debits in order of id and amount against a limit, that of the user's first debit; one that the rest can't pay is refused.

    What is refused leaves the balance to the later ones, which no running sum can tell. The debits stream by, sorted by
    user, and a balance is all that is held, however many debits a user has. A null or negative amount is refused.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, left, first = None, 0, True
        for b in batches:
            out = []
            for who, amount, limit in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if first or who != user:
                    user, left, first = who, limit or 0, False
                ok = amount is not None and 0 < amount <= left
                left -= amount if ok else 0
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["user_id", "id", "accepted"])

    rows = debits.select(*[F.col(c).cast("long").alias(c) for c in ("user_id", "id", "amount", "credits_limit")])
    return rows.repartition("user_id").sortWithinPartitions("user_id", "id", "amount").mapInArrow(fold, "user_id long, id long, accepted boolean")
