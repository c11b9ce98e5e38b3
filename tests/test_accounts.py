"""Accounts, patches, listings and views on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import accounts, mutations, shaping, telemetry
from codeloom.plans.staging import staged
from codeloom.sources import graph_tables, text_tables
from codeloom.sources.text_tables import write_csv


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sweep_ends_at_a_batch_without_progress(spark):
    rnd = random.Random(7)
    trash = [(k, dt.date(2024, 1, 1 + rnd.randrange(9)), rnd.choice([True, False, False, None])) for k in range(60)]
    for batch in (1, 3, 9, 100):
        left, gone = sorted((at, k, bool(locked)) for k, at, locked in trash if at < dt.date(2024, 1, 8)), []
        while left:
            page = [x for x in left[:batch] if not x[2]]
            if not page:
                break
            gone += [k for _, k, _ in page]
            left = [x for x in left if x not in page]
        df = spark.createDataFrame(trash, "id int, deleted_at date, locked boolean")
        assert rows(accounts.purged(df, F.lit(dt.date(2024, 1, 8)), batch)) == [(k,) for k in sorted(gone)]


def test_sign_up_windows_open_with_the_first_attempt(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 12, 0, s)
    df = spark.createDataFrame([(1, "a", t(0)), (2, "a", t(4)), (3, "a", t(9)), (4, "a", t(10)), (5, None, t(1)), (6, " ", t(2)), (7, "b", None)], "id int, address string, at timestamp")
    assert rows(accounts.sign_up_verdicts(df, 1, 10)) == [(1, "a", 1, True, None), (2, "a", 2, False, 6), (3, "a", 3, False, 1), (4, "a", 1, True, None), (5, "unknown", 1, True, None), (6, "unknown", 2, False, 9)]
    assert rows(accounts.sign_up_verdicts(df.limit(0), 1, 10)) == []


def test_keys_obey_their_locks(spark):
    keys = [(1, 7, None, None, None), (2, 7, None, "ADMIN", None), (3, 7, None, "USER", None), (4, 7, None, None, dt.datetime(2024, 1, 1)), (5, 8, None, None, None)]
    keys = spark.createDataFrame(keys, "id int, user_id int, disabled_at timestamp, disabled_by string, deleted_at timestamp")

    def after(action, user=7):
        asked = spark.createDataFrame([(k, user, action) for k in range(1, 6)], "id int, user_id int, action string")
        return [r.id for r in accounts.changed_keys(keys, asked, F.lit(dt.datetime(2024, 2, 1))).where("changed").orderBy("id").collect()]

    assert (after("disable"), after("enable"), after("delete"), after("lock"), after("unlock"), after("other")) == ([1, 3], [3], [1, 3], [1, 2, 3, 5], [2], [])
    assert rows(accounts.admin_locked_projects(keys.withColumn("project_id", F.col("id")))) == [(2,)]


def test_imports_that_cannot_be_paid_cost_nothing(spark):
    imports = spark.createDataFrame([(1, 1, 3), (1, 2, 30), (1, 3, 3), (2, 1, 1)], "user_id long, id long, n int")
    tiers = spark.createDataFrame([(5, 2), (50, 9)], "max_files long, credits int")
    made = accounts.import_charges(imports, tiers, spark.createDataFrame([(1, 5, 0, 1)], "user_id long, credits_limit int, adjustment int, used int"))
    assert rows(made) == [(1, 1, 2, True), (1, 2, 9, False), (1, 3, 2, True), (2, 1, 2, False)]
    assert rows(accounts.ledger(made, "IMPORT")) == [(1, 1, "IMPORT", "WEB", -2), (1, 3, "IMPORT", "WEB", -2)]


def test_user_search_and_page(spark):
    users = spark.createDataFrame([(1, "A@x", "Ann", False), (2, "b@x", None, True), (3, "c@x", "Cy", False)], "id int, email string, display_name string, deactivated boolean")
    settings = spark.createDataFrame([(1, "PRO", dt.datetime(2024, 1, 1)), (2, "pro", None)], "user_id int, plan string, blocked_at timestamp")
    found = lambda **k: [r.id for r in accounts.searched_users(users, settings, **k).orderBy("id").collect()]
    assert (found(), found(text="ANN"), found(plan="Pro"), found(status="active"), found(status="blocked"), found(status="deactivated"), found(status="x")) == ([1, 2, 3], [1], [1, 2], [3], [1], [2], [])
    usage = spark.createDataFrame([(1, 5), (3, 7), (3, 1)], "owner int, bytes int")
    assert rows(accounts.user_page(users, settings, usage, 1, 2)) == [(2, "b@x", "pro", 0), (3, "c@x", None, 8)]


def test_patches(spark):
    schema = "path string, bytes long, content binary"
    gone = spark.createDataFrame([], "path string")
    check = lambda files, deleted=gone, **k: rows(mutations.patch_problems(spark.createDataFrame(files, schema), deleted, **k).fillna(""))
    assert check([("a/B.java", 3, b"abc")]) == []
    assert check([]) == []
    assert check([("a/B.java", 3, b"a\0c"), ("a/B.java/C.java", 9, b"")], max_file_bytes=5) == [("BINARY_CONTENT", "a/B.java"), ("FILE_TOO_LARGE", "a/B.java/C.java"), ("OVERLAPPING_PATH", "a/B.java")]
    assert check([("a\\B.java", 3, b""), (" ", 1, None)]) == [("BACKSLASH_PATH", "a\\B.java"), ("BLANK_PATH", " "), ("NOT_JAVA_SOURCE", " ")]
    assert check([("x.java", 3, b"")], spark.createDataFrame([("x.java",), ("y",)], "path string"), max_files=1) == [("DUPLICATE_PATH", "x.java"), ("TOO_MANY_FILES", "")]


def test_deletions_wait_for_a_sure_scan(spark):
    df = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    before = [f"d/{k}" for k in range(40)]
    verdict = lambda now, unsafe=(), skipped=None, known=before: mutations.deletion_safety(df(known), df(now), df(unsafe), skipped and df(skipped)).first().verdict
    assert [verdict(before[:k]) for k in (0, 20, 21, 40)] == ["DESTRUCTIVE", "DESTRUCTIVE", "SAFE", "NOTHING"]
    assert (verdict(before, ["q"]), verdict(before, (), ["d/1"]), verdict(before, (), ["new"]), verdict([], known=[])) == ("UNCERTAIN", "UNCERTAIN", "NOTHING", "NOTHING")
    assert mutations.deletion_safety(df(before), df(before), df(["d"])).first().n_uncertain == 41


def test_changed_bytes(spark):
    f = spark.createDataFrame([("a", "1", 5), ("b", "2", 7)], "path string, sha256 string, bytes long")
    assert rows(mutations.changed_bytes(f.limit(0), f, 11)) == [(12, True)]
    assert rows(mutations.changed_bytes(f, f, 11)) == [(0, False)]


def test_a_file_parsed_anew(spark):
    nodes = spark.createDataFrame([("a", "Class", "f", 1), ("b", "Method", "f", 1), ("c", "Class", "g", 1), ("x", "External", None, 1)], "id string, type string, file_path string, hash int")
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "c", "b"), ("3", "b", "x"), ("4", "c", "c")], "id string, source string, target string")
    fresh = spark.createDataFrame([("a", "Class", "f", 2), ("n", "Method", "f", 1)], "id string, type string, file_path string, hash int")
    n, e, changes = mutations.file_change(nodes, edges, "f", fresh, spark.createDataFrame([("5", "a", "n"), ("6", "a", "gone")], edges.schema))
    assert [r[0] for r in rows(n.select("id"))] == ["a", "c", "n"] and [r[0] for r in rows(e.select("id"))] == ["4", "5"]
    assert rows(changes) == [("edge", "1", "removed"), ("edge", "2", "removed"), ("edge", "3", "removed"), ("edge", "5", "added"), ("node", "a", "modified"), ("node", "b", "removed"), ("node", "n", "added")]


def test_changes_at_a_file_equal_those_of_whole_graphs_and_shuffle_no_edges(spark, monkeypatch):
    import random

    from codeloom.plans import staging

    rng = random.Random(7)
    ids = [f"n{k}" for k in range(40)]
    node = lambda i, path, h: (i, rng.choice(["Class", "External"]), path, h)
    old = [node(i, rng.choice(["f", "g", None]), rng.randint(0, 1)) for i in ids[:30]]
    new = [node(i, rng.choice(["f", "f", "g"]), rng.randint(0, 1)) for i in rng.sample(ids, 12)]
    had = [(f"e{k}", rng.choice(ids), rng.choice(ids)) for k in range(60)]
    got = [(f"e{k}", rng.choice(ids), rng.choice(ids)) for k in range(50, 90)] + [("e1", had[1][1], had[1][2])]
    n0, n1 = (spark.createDataFrame(x, "id string, type string, file_path string, hash int") for x in (old, new))
    e0, e1 = (spark.createDataFrame(x, "id string, source string, target string") for x in (had, got))
    for few in (staging.FEW, 3):  # broadcast, and dealt where a file has more
        monkeypatch.setattr(staging, "FEW", few)
        n, e, changes = mutations.file_change(n0, e0, "f", n1, e1)
        left = {i: (p, h) for i, _, p, h in rows(n.select("id", "type", "file_path", "hash"))}
        before, after = {i: h for i, _, p, h in old if p == "f"}, {i: h for i, (p, h) in left.items() if p == "f"}
        at = lambda edges, own: {i: 0 for i, s, t in edges if s in own or t in own}
        want = []
        for kind, b, a in (("node", before, after), ("edge", at(had, before), at(rows(e.select("id", "source", "target")), after))):
            want += [(kind, i, "added" if i not in b else "removed" if i not in a else "modified") for i in b.keys() | a.keys() if b.get(i) != a.get(i)]
        assert rows(changes) == sorted(want) and {w[2] for w in want} == {"added", "removed", "modified"}
    monkeypatch.setattr(staging, "FEW", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        n = spark.range(100).selectExpr("concat('n', id) id", "'Class' type", "if(id < 3, 'f', 'g') file_path", "1 hash")
        e = spark.range(99).selectExpr("concat('e', id) id", "concat('n', id) source", "concat('n', id + 1) target")
        changes = mutations.file_change(n, e, "f", n.where("id = 'n1'"), e.where("id = 'e1'"))[2]
        plan = changes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(source" not in plan and "hashpartitioning(target" not in plan


def test_packages_and_properties_of_methods(spark):
    nodes = spark.createDataFrame([("a", "Class", "f", "f", "A", {"k": "v"}), ("b", "Annotation", "f", "f", "B", None), ("c", "Class", "g", "f", "C", None), ("d", "Route", None, "f", "D", None), ("e", "Class", "h", "h", "E", None)], "id string, type string, file_path string, parsed_from string, full_name string, props map<string,string>")
    out = mutations.with_packages(nodes, spark.createDataFrame([("f", None)], "file string, package string"))
    assert {r.id: r.props for r in out.collect()} == {"a": {"k": "v", "packageName": ""}, "b": {}, "c": {}, "d": {"packageName": ""}, "e": {}}
    out = mutations.with_method_props(nodes, spark.createDataFrame([("A", {"k": "w", "z": "1"})], "full_name string, more map<string,string>"))
    assert {r.id: r.props for r in out.where("id < 'c'").collect()} == {"a": {"k": "w", "z": "1"}, "b": {}}


def test_views_and_included_types(spark):
    nodes = spark.createDataFrame([("a", "Class"), ("p", "Package")], "id string, type string")
    edges = spark.createDataFrame([("p", "a", "CONTAINS", 1, 1)], "source string, target string, type string, weight int, line_number int")
    assert [shaping.view(nodes, edges, *a)[0].count() for a in ((), (" ",), ("BASELINE ",), (" Deep",), ("x", True))] == [1, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        shaping.view(nodes, edges, "x")
    assert [rows(shaping.by_type(nodes, "Class", i).select("id")) for i in (None, " ", "Package")] == [[("a",)], [("a",)], [("p",)]]


def test_storage_and_series(spark):
    p = spark.createDataFrame([(1, "o", 5), (2, "o", 5), (3, "q", 9)], "project int, owner string, bytes long")
    assert rows(telemetry.storage_of(p, spark.createDataFrame([("o",), ("z",)], "owner string"))) == [("o", 10), ("z", 0)]
    assert [tuple(r) for r in telemetry.top_projects(p, spark.createDataFrame([(3, "N")], "project int, name string"), 2).orderBy(F.desc("used_bytes")).collect()] == [(3, "N", 9), (1, "1", 5)]
    d = spark.createDataFrame([(dt.date(2023, 5, 1), 2), (dt.date(2024, 5, 1), 3)], "day date, value long")
    assert rows(telemetry.dense_quarters(d)) == [(1, 0), (2, 3), (3, 0), (4, 0)]
    assert rows(telemetry.dense_years(d, F.lit(dt.date(2025, 1, 1)), 3)) == [(2023, 2), (2024, 3), (2025, 0)]


def test_markdown_to_csv(spark, tmp_path):
    text = "x | y\n| a | b\\|c |\n|:--|--:|\n  | 1 |  |\n"
    found = text_tables.markdown_rows(spark.createDataFrame([("f", text), ("g", None)], "file string, text string"), "file")
    assert rows(found) == [("f", 2, ["a", "b|c"]), ("f", 4, ["1", ""])]
    write_csv(found.select("line", F.get("cells", F.lit(0)).alias("first")), str(tmp_path / "out"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "out"))) == [("2", "a"), ("4", "1")]


def test_stored_graphs_follow_their_sources(spark, tmp_path):
    made = []

    def make(s, d):
        made.append(d)
        return s.createDataFrame([("a", "Class"), ("b", None)], "id string, type string")

    for name in graph_tables.SOURCES:
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    read = lambda: rows(graph_tables.stored(spark, str(tmp_path), "test", make).fillna(""))
    assert read() == read() == [("a", "Class"), ("b", "")] and len(made) == 1
    spark.range(2).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    assert read() and len(made) == 2


def test_staged_tables_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "x", 2)], "b int, type string, a int")
    assert staged(df, "type").columns == df.columns and rows(staged(df, "type")) == [(1, "x", 2)]
    assert rows(staged(df.limit(0))) == []


def test_alerts_name_the_users_of_busy_networks(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from codeloom.operators import telemetry

    t = dt.datetime(2024, 1, 2)
    rows_ = [("203.0.113.1", 1, "k", "/a", t)] * 3 + [("203.0.113.1", None, None, "/a", t), ("203.0.113.1", 9, None, "/a", t), ("10.0.0.1", 1, None, "/a", t), ("203.0.113.2", 1, None, "/a", t), ("203.0.113.1", 1, "k", "/a", t - dt.timedelta(days=9))]
    e = spark.createDataFrame(rows_, "ip_address string, user_id int, api_key_ref string, route string, occurred_at timestamp")
    users = spark.createDataFrame([(1, "a@x")], "id int, email string")
    got = telemetry.network_alerts(e, F.lit(dt.datetime(2024, 1, 1)), users, 1).collect()
    assert {(r.ip_address, r.total_requests, r.user_id, r.api_key_ref, r.requests, r.email) for r in got} == {("203.0.113.1", 5, 1, "k", 3, "a@x"), ("203.0.113.1", 5, None, None, 1, None), ("203.0.113.1", 5, 9, None, 1, None)}
