"""Scalars, telemetry, texts and streams."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import addresses, scalars
from codeloom.operators import telemetry
from codeloom.sources import text_tables
from codeloom.streaming import events, throttle


def values(spark, column, rows, make):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"i int, x {column}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_routes_are_masked(spark):
    rows = ["/a/1?x", "/u/123e4567-e89b-12d3-a456-426614174000", "/m/a@b.io", "/t/abcdefgh12345678ZZ", "/t/abcdefghijklmnopqrst", "/p/C:x", None, " ", "/" + "/".join("abcdefghijklmn"), "/{id}#f"]
    want = ["/a/{id}", "/u/{id}", "/m/{email}", "/t/{token}", "/t/abcdefghijklmnopqrst", "/p/{path}", "/", "/", "/a/b/c/d/e/f/g/h/i/j/k/l/...", "/{id}"]
    assert values(spark, "string", rows, scalars.normal_route) == want


def test_addresses(spark):
    rows = ["10.1.2.3", "100.64.0.1", "203.0.113.9", "::1", "fe80::1", "2001:db8::1", "224.0.0.1", "300.1.1.1"]
    assert values(spark, "string", rows, addresses.is_public) == [False, False, True, False, False, True, False, False]
    assert values(spark, "string", ["10.255.0.1", "11.0.0.1", "x"], lambda c: addresses.in_networks(c, ["10.0.0.0/8"])) == [True, False, False]
    assert values(spark, "string", ["203.0.113.1, 198.51.100.7, 10.0.0.1", "10.0.0.1"], lambda c: addresses.client_address(c, ["198.51.100.0/24"])) == ["203.0.113.1", None]
    rows = ["ff02::1", "x:y", "::ffff:10.0.0.1", "::ffff:0:1", "fec0::1", "::", "1::2::3", " 2001:DB8::5%eth0 ", "0.1.2.3", "", None, "1:2:3:4:5:6:7:8:9", "::1.2.3.4", "a" * 5000]
    assert values(spark, "string", rows, addresses.is_public) == [False, False, False, True, False, False, False, True, True, False, False, False, True, False]
    assert values(spark, "string", [" 2001:DB8::5%eth0 ", "::ffff:10.0.0.1", "010.1.1.1", "nope"], addresses.canonical) == ["2001:db8:0:0:0:0:0:5", "10.0.0.1", "10.1.1.1", None]
    assert values(spark, "string", ["10.0.0.1, 2001:db8::9, fe80::1, junk, 198.51.100.7"], lambda c: addresses.client_address(c, ["198.51.100.7"])) == ["2001:db8:0:0:0:0:0:9"]


def test_addresses_and_networks_equal_the_library(spark):
    import ipaddress

    rng = random.Random(6)

    def spelled():
        n = ipaddress.ip_address(rng.getrandbits(32)) if rng.random() < 0.4 else ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([(1 << 128) - 1, (1 << 64) - 1, ((1 << 16) - 1) << 112, 0xFFFF]))
        return n, rng.choice([str(n), n.exploded.upper() if n.version == 6 else str(n)])

    made = [spelled() for _ in range(300)]
    broken = ["1.2.3", "1.2.3.4.5", ":1", "1:", ":::", "g::1", "1:2:3:4:5:6:7", "::1.2.3", "1.2.3.4:5", "12345::", "1::2:3:4:5:6:7:8"]
    text = [t for _, t in made] + broken
    got = values(spark, "string", text, addresses.bits)
    want = [format(int(n.ipv4_mapped or n) if n.version == 6 else int(n), f"0{32 if n.version == 4 or n.ipv4_mapped else 128}b") for n, _ in made] + [None] * len(broken)
    assert got == want
    cidrs = [f"{ipaddress.ip_network((int(n) >> (n.max_prefixlen - k) << (n.max_prefixlen - k), k))}" if n.version == 4 else f"{n}/{k}" for n, _ in made[:60] for k in (rng.choice([0, 8, 20, 32]),)]
    table = spark.createDataFrame([(c,) for c in [*cidrs, "junk", "10.0.0.0/99", "1.2.3.4/x"]], "cidr string")
    rows = spark.createDataFrame([(t,) for t in text], "address string")
    got = {r.address: r.network for r in addresses.longest_match(rows, "address", table).collect()}
    for (n, t) in made:
        known = [c for c in cidrs if ipaddress.ip_network(c, strict=False).version == n.version and n in ipaddress.ip_network(c, strict=False)]
        best = max(known, key=lambda c: ipaddress.ip_network(c, strict=False).prefixlen, default=None)
        assert (got[t] is None) == (best is None) and (best is None or int(got[t].split("/")[1]) == int(best.split("/")[1])), t
    assert all(got[t] is None for t in broken) and addresses.longest_match(rows, "address", table.limit(0)).where("network is not null").isEmpty()


def test_sizes_round_ties_to_the_even_digit(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 1075, 1048575, 1310720, 1835008, 28399919104, 1073741824]
    want = ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "1.0 KB", "1024.0 KB", "1.2 MB", "1.8 MB", "27084.3 MB", "1024.0 MB"]
    assert values(spark, "long", sizes, lambda c: scalars.readable_size(c, "MB")) == want
    assert values(spark, "long", sizes, scalars.readable_size) == [*want[:-2], "26.4 GB", "1.0 GB"]
    assert values(spark, "long", (more := [random.Random(8).randrange(1 << 20, 1 << 40) for _ in range(200)]), lambda c: scalars.readable_size(c, "MB")) == [f"{n / 2**20:.1f} MB" for n in more]


def test_credit_periods_clamp_to_short_months(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 31), dt.date(2025, 2, 28)), (dt.date(2024, 2, 29), dt.date(2025, 3, 1))], "r date, t date")
    start, end = scalars.credit_period(F.col("r"), F.col("t"))
    got = [(r.s, r.e) for r in df.select(start.alias("s"), end.alias("e")).collect()]
    assert got == [(dt.date(2025, 2, 28), dt.date(2025, 3, 30)), (dt.date(2025, 2, 28), dt.date(2025, 3, 28))]


def test_prices_round_up_once_and_have_a_floor(spark):
    rate = lambda x: F.lit(x).cast("decimal(12,4)")
    price = lambda c: scalars.credit_price(rate("1"), rate("0.5"), rate("0.25"), F.lit(3), c, F.lit(1048576))
    assert values(spark, "int", [0, 1, 4, 5], price) == [3, 3, 4, 4]


def test_redaction_keeps_line_numbers(spark):
    text = "a\n-----BEGIN RSA PRIVATE KEY-----\nxyz\n-----END RSA PRIVATE KEY-----\npassword = 'hunter2'"
    assert values(spark, "string", [text], scalars.redacted_source) == ["a\n[REDACTED]\n[REDACTED]\n[REDACTED]\npassword = [REDACTED]"]
    got = values(spark, "string", ['{"a": [{"Token": 1}], "b": 2}', "no", None], scalars.redacted_json)
    assert got == ['{"a":[{"Token":"[REDACTED]"}],"b":2}', None, None]
    got = values(spark, "string", ['{"pass-word": [1], "JWT": {"a": 1}, "source_content": "x", "cookie": "kept", "note": ["Bearer abc.def and vbg_0123456789abc", 3]}'], scalars.redacted_json)
    assert got == ['{"JWT":"[REDACTED]","cookie":"kept","note":["Bearer [REDACTED] and [REDACTED]",3],"pass-word":"[REDACTED]","source_content":"[REDACTED]"}']


BEGIN, END = "-----BEGIN EC PRIVATE KEY-----", "-----END EC PRIVATE KEY-----"


def brute_hidden(lines):
    """Whole keys first, then one that is still open, then what is before the first end that is left without a beginning."""
    text = "\n".join(lines)
    many = lambda m: "\n".join(["\0"] * (m.group().count("\n") + 1))
    text = re.sub(f"{BEGIN}[\\s\\S]*?{END}", many, text)
    text = re.sub(f"{BEGIN}[\\s\\S]*$", many, text)
    text = re.sub(f"\\A[\\s\\S]*?{END}", many, text)
    return ["[REDACTED]" if "\0" in x else x for x in text.split("\n")]


def test_private_keys_are_hidden_whole_open_and_orphaned(spark):
    rng = random.Random(4)
    texts = [[rng.choice(["a", "b", BEGIN, END, f"x {BEGIN} MII {END} y", "password=x"]) for _ in range(rng.randint(1, 9))] for _ in range(200)]
    got = values(spark, "array<string>", texts, scalars.redacted_lines)
    for t, g in zip(texts, got, strict=True):
        want = [re.sub("password=x", "password=[REDACTED]", x) for x in brute_hidden(t)]
        assert g == want, t
    body = spark.createDataFrame([("f", f"a\n{BEGIN}\nMII\nQQ\n{END}\nb\ntoken: t")], "file string, text string")
    shown = lambda first, last: [r.text for r in text_tables.line_range(body, "file", first, last).orderBy("line").collect()]
    assert shown(1, 3) == ["a", "[REDACTED]", "[REDACTED]"] and shown(3, 7) == ["[REDACTED]"] * 3 + ["b", "token: [REDACTED]"]
    assert shown(9, 12) == [] and [r.snippet for r in text_tables.search_lines(body, "file", "QQ").collect()] == ["[REDACTED]"]


def test_globs(spark):
    paths = ["src/a.log", "a.log", "build/x/y.java", "src/build.java", "keep.log"]
    assert values(spark, "string", paths, lambda c: scalars.ignored(c, ["*.log", "build", "!keep.log"])) == [True, True, True, False, True]
    paths = ["a/dist/x", "dist/x/y", "a/b.pem", "src/node_modules/x", "node_modules/x", "a/.env", "q/x1.txt"]
    assert values(spark, "string", paths, lambda c: scalars.ignored(c, ["dist/**", "*.pem", "node_modules/", ".env", "q/x?.txt"])) == [False, True, True, False, True, True, True]


def test_words(spark):
    assert values(spark, "string", ["findByUser_id2"], scalars.humanised) == ["Find by user id2"]
    assert values(spark, "string", ["cities", "boxes", "cars", "class"], scalars.singular) == ["city", "box", "car", "class"]
    assert values(spark, "string", ["city", "box", "day"], scalars.plural) == ["cities", "boxes", "days"]
    assert values(spark, "string", ["order line-item"], scalars.pascal) == ["OrderLineItem"]
    assert values(spark, "double", [0.0, 7.0, 12.0, 100.0], scalars.axis_maximum) == [1.0, 10.0, 20.0, 100.0]


def test_fnv(spark):
    def units(text):
        raw, h = text.encode("utf-16-le"), 2166136261
        for k in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[k : k + 2], "little")) * 16777619 % 2**32
        return h

    texts = ["", "a", "é", "𝄞x🙂", "漢字"]
    assert values(spark, "string", texts, scalars.fnv1a) == [units(t) for t in texts] and units("a") == 0xE40C292C


def test_a_null_key_is_a_group(spark):
    at = dt.datetime(2024, 1, 1, 10, 5, 30)
    e = spark.createDataFrame([(1, 7, "k", at), (2, 7, "k", at), (3, 7, None, at), (4, None, None, at)], "id long, user_id long, api_key_ref string, occurred_at timestamp")
    got = telemetry.top_users(e, F.to_timestamp(F.lit("2024-01-01")), 10).collect()
    assert [(r.user_id, r.api_key_ref, r.request_count) for r in got] == [(7, "k", 2), (7, None, 1)]
    assert got[0].minute_bucket == dt.datetime(2024, 1, 1, 10, 5)


def test_series_at_four_grains(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 5, 6), -3), (dt.datetime(2024, 6, 1), -4), (dt.datetime(2024, 6, 1), 9), (None, -1)], "created_at timestamp, credits_delta int")
    got = {(r.period, r.label): r.value for r in telemetry.consumption(rows).collect()}
    assert got == {("day", "2024-05-06"): 3, ("day", "2024-06-01"): 4, ("month", "2024-05"): 3, ("month", "2024-06"): 4, ("quarter", "2024-Q2"): 7, ("year", "2024"): 7}


def test_refused_debits_leave_the_balance(spark):
    rows = [(1, 1, 6, 10), (1, 2, 5, 10), (1, 3, 4, 10), (1, 4, 1, 10)]
    got = telemetry.accepted_debits(spark.createDataFrame(rows, "user_id long, id long, amount long, credits_limit long")).collect()
    assert [r.accepted for r in sorted(got, key=lambda r: r.id)] == [True, False, True, False]


def test_tiers_without_an_end(spark):
    tiers = spark.createDataFrame([(None, 9), (10, 1), (20, 4)], "max_files long, credits int")
    orders = spark.createDataFrame([(1, 10), (2, 11), (3, 999)], "id long, n long")
    assert {(r.id, r.credits) for r in telemetry.tier_price(orders, tiers).collect()} == {(1, 1), (2, 4), (3, 9)}
    again = orders.unionAll(orders).withColumn("note", F.lit("x"))
    assert telemetry.tier_price(again, tiers).where("note = 'x'").count() == 6
    assert telemetry.tier_price(orders, tiers.where("max_files = 10")).where("credits is null").count() == 2


def test_stacks_and_compilers(spark):
    trace = "x\n\tat a.B$1.lambda$run$0(B.java:5)\nCaused by: y\n\tat a.C.<init>(C.java)"
    df = spark.createDataFrame([(1, trace)], "id int, text string")
    assert [(r.cause, r.class_name, r.method, r.at_line) for r in text_tables.stack_frames(df, "id").orderBy("position").collect()] == [(0, "a.B", "run", 5), (1, "a.C", "C", None)]
    out = spark.createDataFrame([(1, "[ERROR] A.java:[3,4] no\n[ERROR] A.java:[3,9] no\nB.java:7: error: x")], "id int, text string")
    assert {(r.file, r.at_line, r.message) for r in text_tables.compiler_errors(out, "id").collect()} == {("A.java", 3, "no"), ("B.java", 7, "x")}


def test_sources_and_archives(spark, tmp_path):
    import io
    import tarfile

    root = tmp_path / "proj"
    (root / "src/com/x").mkdir(parents=True)
    (root / "target").mkdir()
    (root / "src/com/x/A.java").write_text("package com.x;\nclass A {}")
    (root / "target/B.java").write_text("class B {}")
    files = text_tables.java_files(spark, str(root)).select(text_tables.source_root(F.col("path"), F.col("text")).alias("r")).collect()
    assert len(files) == 1 and files[0].r.endswith("/proj/src")
    assert {r.path for r in text_tables.local_snapshot(spark, str(root), ["target"]).collect()} == {"src/com/x/A.java"}
    (root / "big.txt").write_text("x" * 99)
    (root / "b.bin").write_bytes(b"\x00")
    assert {(r.path, r.reason) for r in text_tables.not_in_snapshot(spark, str(root), ["target"], 50).collect()} == {("big.txt", "too large"), ("b.bin", "binary")}
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name in ("ok.txt", "../bad.txt"):
            i = tarfile.TarInfo(name)
            i.size = 2
            t.addfile(i, io.BytesIO(b"hi"))
    assert [(r.path, bytes(r.content)) for r in text_tables.archive_files(spark, str(tmp_path / "a.tar.gz")).collect()] == [("ok.txt", b"hi")]
    (tmp_path / "broken.zip").write_bytes(b"PK no")
    assert {(r.skipped, r.n) for r in text_tables.archive_skips(spark, f"{tmp_path}/*.[tz]*", 1).collect()} == {("unsafe path", 1), ("too large", 1), ("broken: BadZipFile", 1)}


def replay(spark, tmp_path, rows, schema, make, name):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(source)
    q = make(events.stream(spark, source, schema)).writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(target).collect()


def test_a_debounced_stream_keeps_the_last_change_of_a_burst(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    ms = lambda n: t + dt.timedelta(milliseconds=n)
    rows = [("p", "a", "CREATE", ms(0)), ("p", "a", "MODIFY", ms(300)), ("p", "b", "DELETE", ms(600)), ("p", "a", "DELETE", ms(3000)), ("p", "z", "CREATE", ms(999_999))]
    schema = "project string, path string, type string, ts timestamp"
    got = replay(with_state(spark), tmp_path, rows, schema, events.debounced, "d")
    assert sorted((r.path, r.type) for r in got) == [("a", "DELETE"), ("a", "MODIFY"), ("b", "DELETE")]  # the last burst is still open
    closed = {(r.session_start, r.session_end, r.path, r.type) for r in events.debounced_rows(spark.createDataFrame(rows, schema)).collect()}
    assert {tuple(r)[1:] for r in got} == {c for c in closed if c[2] != "z"} and len(closed) == 4


def with_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def test_bursts_equal_brute_force_over_one_busy_project(spark):
    rng = random.Random(2)
    t = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["p", "p", "q"]), rng.choice("abc"), rng.choice(["CREATE", "MODIFY"]), t + dt.timedelta(milliseconds=rng.randint(0, 60_000))) for _ in range(300)]
    want = set()
    for project in ("p", "q"):
        own = sorted((r[3], r[1], r[2]) for r in rows if r[0] == project)
        bursts = [[own[0]]]
        for r in own[1:]:
            bursts.append([]) if r[0] - bursts[-1][-1][0] >= dt.timedelta(milliseconds=500) else None
            bursts[-1].append(r)
        for b in bursts:
            for path in {r[1] for r in b}:
                last = max((r[0], r[2]) for r in b if r[1] == path)
                want.add((project, b[0][0], b[-1][0] + dt.timedelta(milliseconds=500), path, last[1]))
    frame = spark.createDataFrame(rows, "project string, path string, type string, ts timestamp")
    assert {tuple(r) for r in events.debounced_rows(frame).collect()} == want


def test_a_stream_of_logins_has_the_verdicts_of_the_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), k, k * 100 + rng.randint(0, 99), rng.random() < 0.2) for k in range(400)]
    schema = "key string, id long, ts_ms long, success boolean"
    limits = {"failures": 3, "lock_ms": 2_000, "longest_ms": 9_000}
    got = replay(with_state(spark), tmp_path, rows, schema, lambda s: events.throttled(s, **limits), "t")
    want = events.throttled_rows(spark.createDataFrame(rows, schema), **limits).collect()
    assert {(r.key, r.id, r.allowed) for r in got} == {(r.key, r.id, r.allowed) for r in want} and any(not r.allowed for r in want)


def test_duplicates_go_within_the_watermark(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    got = replay(spark, tmp_path, [(1, t), (1, t), (2, t)], "id long, ts timestamp", lambda s: events.deduplicated(s, "id"), "x")
    assert sorted(r.id for r in got) == [1, 2]


def test_lockouts_double_and_a_success_forgets(spark):
    rows = [(0, False), (1, False), (2, True), (10_001, False), (10_002, False), (15_000, True), (30_002, True), (30_003, False)]
    df = spark.createDataFrame([("k", n, at, ok) for n, (at, ok) in enumerate(rows)], "key string, id long, ts_ms long, success boolean")
    got = {r.id: r.allowed for r in events.throttled_rows(df, failures=2, lock_ms=10_000).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True}


def test_upserts_of_a_stream_keep_the_latest(spark, tmp_path):
    apply = events.upsert_latest(str(tmp_path / "s"), "id", "at")
    for k, rows in enumerate([[(1, 1, "a"), (2, 5, "b")], [(1, 3, "c"), (2, 4, "d")], [(1, 3, "c")]]):
        df = spark.createDataFrame(rows, "id long, at long, v string")
        apply(df, k)
        apply(df, k)
    assert {(r.id, r.v) for r in events.latest_of(spark, str(tmp_path / "s"), "id long, at long, v string").collect()} == {(1, "c"), (2, "b")}
    assert {(r.id, r.v) for r in events.latest_of(spark, str(tmp_path / "s"), "id long, at long, v string", before=1).collect()} == {(1, "a"), (2, "b")}
    rows = spark.range(500).selectExpr("id", "0L at", "'x' v")
    events.upsert_latest(str(tmp_path / "m"), "id", "at", 4)(rows, 0)
    events.upsert_latest(str(tmp_path / "m"), "id", "at", 4)(spark.createDataFrame([(3, 1, "new")], "id long, at long, v string"), 1)
    assert len(list((tmp_path / "m").glob("bucket=*/1"))) == 1  # the other buckets stay as they are
    kept = events.latest_of(spark, str(tmp_path / "m"), "id long, at long, v string")
    assert kept.count() == 500 and kept.where("v = 'new'").first().id == 3


@pytest.mark.parametrize("name", ["impact_dependency", "top_users", "dynamic_dispatch"])
def test_registered_queries_run(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_every_sql_belongs_to_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def brute_guard(rows, limits):
    """Verdicts of logins one after another, and how many turns would not do."""
    state, out = {}, {}
    for id_, address, account, ts, success in sorted(rows, key=lambda r: (r[3], r[0])):
        keys = [("ip", (address or "").strip() and address or "unknown"), ("account", (account or "").strip().lower())]
        for k in keys:
            if k in state and ts - state[k]["since"] >= limits.kept_ms:
                del state[k]
        ok = [ts >= state.get(k, {}).get("until", 0) for k in keys]
        out[id_] = tuple(ok)
        if all(ok) and success:
            for k in keys:
                state.pop(k, None)
        elif all(ok):
            for k, most, doubles in zip(keys, (limits.per_address, limits.per_account), (True, False), strict=True):
                s = state.setdefault(k, {"failed": 0, "locks": 0, "until": 0, "since": ts})
                s["failed"] += 1
                if s["failed"] >= most:
                    s["failed"], s["locks"] = 0, s["locks"] + 1
                    s["until"] = ts + limits.lock(s["locks"], doubles)
    return out


LOGINS = "id long, address string, account string, ts_ms long, success boolean"


@pytest.mark.parametrize("seed", range(3))
def test_guarded_logins_equal_a_walk_in_order(spark, seed):
    rng = random.Random(seed)
    limits = throttle.Limits(per_address=4, per_account=3, lock_ms=900, longest_ms=4_000, window_ms=2_000)
    rows = [(k, rng.choice(["a", "a", "b", "c", " ", None]), rng.choice(["X@y", " x@Y ", "z", "w", None]), rng.randint(0, 30_000), rng.random() < 0.15) for k in range(400)]
    verdicts, states, turns = throttle.guarded(spark.createDataFrame(rows, LOGINS), limits)
    want = brute_guard(rows, limits)
    assert {r.id: (r.address_allowed, r.account_allowed) for r in verdicts.collect()} == want and turns >= 2
    assert not all(all(v) for v in want.values()) and states.where("kind = 'account'").count() == 4
    assert throttle.guarded(spark.createDataFrame([], LOGINS), limits)[0].count() == 0


def test_lock_of_an_account_holds_from_every_address_and_stays_flat(spark):
    limits = throttle.Limits(per_address=10, per_account=5, lock_ms=900_000, window_ms=900_000)
    minute = 60_000
    rows = [(k, "ip", "victim", k, False) for k in range(5)] + [(5, "other", "victim", 10, False), (6, "other", "fine", 11, True), (7, "new", "victim", 16 * minute, False)]
    rows += [(20 + k, "spray", f"u{k}", k, False) for k in range(10)] + [(40, "spray", "u99", 20, True), (41, "spray", "u98", 16 * minute, False)]
    rows += [(50 + k, "spray", f"v{k}", 16 * minute + k + 1, False) for k in range(9)] + [(60, "spray", "w", 32 * minute, False), (61, "spray", "w", 47 * minute, False)]
    got = {r.id: r.allowed for r in throttle.guarded(spark.createDataFrame(rows, LOGINS), limits)[0].collect()}
    assert (got[5], got[6], got[7]) == (False, True, True) and (got[40], got[41], got[60], got[61]) == (False, True, False, True)
    assert throttle.Limits(lock_ms=1 << 60, longest_ms=1 << 61).lock(50, True) == throttle.MOST_LOCK_MS


def test_guarded_batches_go_on_where_the_last_one_ended(spark, tmp_path):
    rng = random.Random(9)
    limits = throttle.Limits(per_address=4, per_account=3, lock_ms=2_000, longest_ms=9_000, window_ms=9_000)
    rows = [(k, rng.choice("abc"), rng.choice("xyz"), k * 50, rng.random() < 0.1) for k in range(240)]
    apply = throttle.guard_batches(str(tmp_path), limits)
    for n in range(3):
        batch = spark.createDataFrame(rows[80 * n : 80 * n + 80], LOGINS)
        apply(batch, n)
        if n == 1:
            apply(batch, n)  # again, after a failure
    got = {r.id: (r.address_allowed, r.account_allowed) for r in spark.read.parquet(f"{tmp_path}/verdicts/*").collect()}
    assert got == brute_guard(rows, limits)
