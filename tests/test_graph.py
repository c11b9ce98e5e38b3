"""Graph operators on small graphs, with the traps of their semantics."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import inference, mutations, shaping, tasks, traversal
from codeloom.plans import staging


def graph(spark, nodes, edges):
    """nodes: (id, type); edges: (source, type, target[, line])."""
    n = spark.createDataFrame([(i, t, i.split(".")[-1], i, "/f/" + i.split(".")[0], 1, 9, "p." + i.split(".")[0]) for i, t in nodes], "id string, type string, name string, full_name string, file_path string, line_number int, end_line int, package_name string")
    rows = [(f"{e[0]}|{e[1]}|{e[2]}", e[0], e[2], e[1], 1, e[3] if len(e) > 3 else 1, k) for k, e in enumerate(edges)]
    return n, spark.createDataFrame(rows, "id string, source string, target string, type string, weight long, line_number int, seq long")


def test_impact_takes_the_least_depth_and_leaves_the_target_out(spark):
    n, e = graph(spark, [(x, "Class") for x in "tabcdz"], [("a", "CALLS", "t"), ("b", "CALLS", "a"), ("b", "CALLS", "t"), ("c", "CALLS", "b"), ("d", "CALLS", "c"), ("t", "CALLS", "d"), ("z", "READS", "t")])
    got = {r.id: r for r in traversal.impact(n, e, "t", 5).collect()}
    assert {i: r.depth for i, r in got.items()} == {"a": 1, "b": 1, "c": 2, "d": 3}
    assert got["a"].direct == 2 and got["a"].total == 4 and got["a"].risk == "LOW" and got["d"].bucket == "mayNeedTesting"


def test_impact_counts_what_the_cap_hides(spark):
    n, e = graph(spark, [("t", "Class")] + [(f"m{k:03}", "Class") for k in range(60)], [(f"m{k:03}", "CALLS", "t") for k in range(60)])
    got = traversal.impact(n, e, "t", 1).collect()
    assert len(got) == 50 and {r.n_at_depth for r in got} == {60} and {r.risk for r in got} == {"CRITICAL"}


def test_structural_impact_goes_both_ways(spark):
    n, e = graph(spark, [(x, "Class") for x in "abc"], [("a", "DEFINES", "b"), ("b", "HAS_METHOD", "c")])
    assert {r.id for r in traversal.impact(n, e, "b", 1, "structural").collect()} == {"a", "c"}


def test_node_detail_returns_the_centre_over_a_cycle(spark):
    n, e = graph(spark, [(x, "Class") for x in "ab"], [("a", "CALLS", "b"), ("a", "READS", "b"), ("b", "CALLS", "a")])
    assert {(r.id, r.edge_type, r.depth) for r in traversal.node_detail(n, e, "a", 2, "out").collect()} == {("b", "CALLS", 1), ("a", "CALLS", 2)}


def test_seeds_count_among_reachable_symbols(spark):
    n, e = graph(spark, [(x, "Class") for x in "abc"], [("b", "CALLS", "a"), ("c", "CALLS", "b"), ("c", "READS", "a")])
    seeds = n.where("id = 'a'").select("id")
    assert [tuple(r) for r in traversal.reachable_symbols(e, seeds, 2, 2).collect()] == [("a", 0), ("b", 1)]


def test_exact_names_beat_partial_ones(spark):
    n, _ = graph(spark, [("x.foo", "Method"), ("y.foo", "Method"), ("foo", "Method"), ("z.barfoo", "Method")], [])
    assert [r.id for r in traversal.resolve(n, "foo").collect()] == ["foo"]
    assert {(r.id, r.status) for r in traversal.resolve(n.where("id <> 'foo'"), "foo").collect()} == {("x.foo", "AMBIGUOUS"), ("y.foo", "AMBIGUOUS"), ("z.barfoo", "AMBIGUOUS")}
    assert traversal.resolve(n, "nothing").count() == 0


def test_flows_prefer_flow_edges_and_calls_stand_in(spark):
    n, e = graph(spark, [(x, "Method") for x in "hab"], [("h", "HANDLES_ROUTE", "r"), ("h", "CALLS", "b", 9), ("h", "CALLS", "a", 3), ("a", "CALLS", "h", 1)])
    assert [(r.id, r.depth) for r in traversal.trace_endpoint(e, "r").collect()] == [("h", 0), ("a", 1), ("b", 1)]


def test_package_prefix_is_plain_text(spark):
    n, _ = graph(spark, [("foo.A", "Class"), ("foobar.B", "Class"), ("x.C", "Class")], [])
    assert {r.id for r in shaping.by_package(n, "p.foo").collect()} == {"foo.A", "foobar.B"}


def test_unknown_types_raise(spark):
    n, _ = graph(spark, [("a", "Class")], [])
    with pytest.raises(ValueError):
        shaping.by_type(n, "Class, Nonsense")


def test_a_cap_ranks_by_the_whole_graph_and_loops_count_twice(spark):
    n, e = graph(spark, [("a", "Method"), ("b", "Method"), ("c", "Method"), ("d", "Field")], [("b", "CALLS", "b"), ("a", "CALLS", "d"), ("c", "CALLS", "d")])
    kept, left = shaping.capped(n, e, 2, 5)
    assert [(r.id, r.degree) for r in kept.collect()] == [("b", 2), ("a", 1)]
    assert [r.source for r in left.collect()] == ["b"]
    assert shaping.capped(n, e, 0, -1)[0].count() == 4  # not a limit of none


def test_an_edge_within_a_file_comes_twice(spark):
    n, e = graph(spark, [("f.a", "Method"), ("f.b", "Method"), ("g.c", "Method")], [("f.a", "CALLS", "f.b"), ("g.c", "CALLS", "f.a")])
    assert sorted(r.id for r in shaping.file_slice(n, e, "/f/f").where("kind = 'edge'").collect()) == ["f.a|CALLS|f.b", "f.a|CALLS|f.b", "g.c|CALLS|f.a"]


def test_isolated_means_without_any_edge_before_hiding(spark):
    n, e = graph(spark, [("a", "Class"), ("b", "Field"), ("c", "Class")], [("a", "HAS_FIELD", "b")])
    assert [r.id for r in shaping.visible(n, e, ("Field",), ("HAS_FIELD",))[0].collect()] == ["a"]


def test_aggregation_keeps_the_first_lines(spark):
    rows = spark.createDataFrame([("a", "CALLS", "b", None if k == 0 else 100 - k, k) for k in range(15)], "source string, type string, target string, line_number int, seq long")
    r = shaping.aggregated(rows).first()
    assert (r.weight, r.line_number, r.occurrences) == (15, 99, list(range(99, 89, -1)))


def test_the_tightest_span_wins(spark):
    n = spark.createDataFrame([("c", "Class", "/f", 1, 100), ("m", "Method", "/f", 10, 20), ("o", "Method", "/f", 30, None)], "id string, type string, file_path string, line_number int, end_line int")
    lines = spark.createDataFrame([("/f", 15), ("/f", 50), ("/f", 30), ("/f", 200)], "file_path string, line int")
    assert {(r.line, r.id) for r in shaping.enclosing_symbol(n, lines).collect()} == {(15, "m"), (50, "c"), (30, "o")}


def test_strongest_edges_need_no_ids_that_follow_from_their_ends(spark):
    import random

    from codeloom.functions.scalars import edge_key

    rng = random.Random(5)
    ids = [f"n{k}" for k in range(12)]
    rows = {(rng.choice(ids), rng.choice(["CALLS", "READS", "WRITES", "EXTENDS"]), rng.choice([*ids, "gone"])) for _ in range(300)}
    n, e = graph(spark, [(i, "Package" if i == "n3" else "Class") for i in ids], sorted(rows))
    key = edge_key(F.col("source"), F.col("type"), F.col("target"))
    e = e.withColumn("id", key)
    best = {}
    for r in e.collect():
        if r.source != r.target and not {r.source, r.target} & {"gone", "n3"}:
            rank = (-shaping.EDGE_PRIORITY.get(r.type, 0), r.id, (r.source, r.target, r.type))
            pair = frozenset((r.source, r.target))
            best[pair] = min(rank, best.get(pair, rank))
    want = sorted(b[2] for b in best.values())
    assert sorted(map(tuple, shaping.strongest_edges(n, e).collect())) == want
    assert sorted(map(tuple, shaping.strongest_edges(n, e.drop("id"), key).collect())) == want and len(want) > 40


def test_dispatch_needs_classes(spark):
    n, e = graph(spark, [("I", "Interface"), ("A", "Class"), ("E", "Enum"), ("I.m()", "Method"), ("A.m()", "Method"), ("E.m()", "Method"), ("A.x()", "Method")], [("A", "IMPLEMENTS", "I"), ("E", "IMPLEMENTS", "I")])
    assert [(r.source, r.target, r.type, r.confidence) for r in inference.dispatch(n, e).collect()] == [("I.m()", "A.m()", "RESOLVES_TO", 1.0)]


def test_triggers_stream_by_and_equal_all_pairs(spark, monkeypatch):
    import random

    rng = random.Random(4)
    side = lambda k: [(rng.randrange(40), f"e{rng.randrange(k)}") for _ in range(500)] + [(None, "e1"), (3, None)]
    monkeypatch.setattr(inference, "BLOCK", 3)
    for most in (1024, 10):  # by bits, and grouped where there are too many events
        monkeypatch.setattr(inference, "BIT_EVENTS", most)
        p, q = side(150), side(150)
        got = inference.triggers(*[spark.createDataFrame(x, "id long, event string") for x in (p, q)])
        want = {}
        for a, e in p:
            for b, f in q:
                if a is not None and b is not None and e is not None and e == f and a != b:
                    want[a, b] = min(e, want.get((a, b), e))
        assert sorted((r.source, r.target, r.event) for r in got.collect()) == sorted((a, b, e) for (a, b), e in want.items())
        assert ("hashpartitioning(source" in got._jdf.queryExecution().executedPlan().toString()) == (most == 10)  # pairs aren't shuffled


def test_triggers_meet_each_pair_once_where_members_share_many_events(spark, monkeypatch):
    import random

    rng = random.Random(6)
    side = lambda kinds: [(rng.randrange(40), f"e{rng.randrange(kinds):03}") for _ in range(900)] + [(None, "e1"), (3, None)]
    monkeypatch.setattr(inference, "CELL", 9)
    for kinds, once in ((63, True), (130, True), (900, False)):  # bits of one word and of three, and pairs that seldom share an event
        p, q = side(kinds), side(kinds)
        got = inference.triggers(*[spark.createDataFrame(x, "id long, event string") for x in (p, q)])
        want = {}
        for a, e in p:
            for b, f in q:
                if a is not None and b is not None and e is not None and e == f and a != b:
                    want[a, b] = min(e, want.get((a, b), e))
        assert sorted((r.source, r.target, r.event) for r in got.collect()) == sorted((a, b, e) for (a, b), e in want.items())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning(__p" in plan) == once and "hashpartitioning(source" not in plan
    none = spark.createDataFrame([], "id long, event string")
    assert inference.triggers(none, none).count() == 0


def test_triggers_keep_one_event_a_pair_and_no_loops(spark):
    side = lambda rows: spark.createDataFrame(rows, "id string, event string")
    got = inference.triggers(side([("p", "e2"), ("p", "e1"), ("q", "e1")]), side([("l", "e1"), ("l", "e2"), ("p", "e1")])).collect()
    assert {(r.source, r.target, r.event) for r in got} == {("p", "l", "e1"), ("q", "l", "e1"), ("q", "p", "e1")}


def test_a_step_belongs_to_the_least_handler_that_reaches_it(spark):
    n, e = graph(spark, [(x, "Method") for x in ("h1", "h2", "a", "b", "x")] + [("k", "Class")], [("b", "CALLS", "k"), ("h2", "HANDLES_ROUTE", "r2"), ("h1", "HANDLES_ROUTE", "r1"), ("h2", "CALLS", "a"), ("a", "CALLS", "b"), ("h1", "CALLS", "b"), ("b", "CALLS", "a"), ("x", "CALLS", "a")])
    assert {(r.source, r.target, r.flow_id) for r in inference.flow_steps(e, n).collect()} == {("h2", "a", "h2"), ("h1", "b", "h1"), ("b", "a", "h1"), ("a", "b", "h1")}


def test_steps_are_numbered_depth_first(spark):
    steps = spark.createDataFrame([("h", "b", "h", 20), ("h", "a", "h", 10), ("a", "c", "h", 1), ("c", "h", "h", 1)], "source string, target string, flow_id string, line_number int")
    got = sorted(inference.step_order(steps).collect(), key=lambda r: r.step_index)
    assert [(r.source, r.target) for r in got] == [("h", "a"), ("a", "c"), ("c", "h"), ("h", "b")]


def test_leaves_go_round_by_round(spark):
    t = spark.createDataFrame([(1, "COMPLETED"), (2, "COMPLETED"), (3, "SUPERSEDED"), (4, "PENDING"), (5, "COMPLETED")], "id long, status string")
    d = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "task long, needs long")
    assert {(r.id, r.round) for r in tasks.pruned(t, d).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_cascades_and_cycles(spark):
    t = spark.createDataFrame([(1, "FAILED_TERMINAL"), (2, "PENDING"), (3, "COMPLETED"), (4, "PENDING"), (5, "BLOCKED_UPSTREAM_ESCALATION")], "id long, status string")
    d = spark.createDataFrame([(2, 1), (3, 1), (4, 3), (5, 3), (5, 2)], "task long, needs long")
    assert {r.id for r in tasks.escalated(t, d, t.where("id = 1").select("id")).collect()} == {2, 5}
    assert tasks.recovered(t, d).count() == 0
    links = spark.createDataFrame([(1, 5), (4, 1), (7, 7)], "task long, needs long")
    assert {(r.task, r.needs): r.cycle for r in tasks.would_cycle(d, links).collect()} == {(1, 5): True, (4, 1): False, (7, 7): True}


def test_upserts_and_patches(spark):
    n = spark.createDataFrame([("a", "x", {"k": "1", "l": "1"}), ("b", "y", None)], "id string, name string, props map<string,string>")
    batch = spark.createDataFrame([("a", None, {"k": "2"}), ("c", "z", None)], "id string, name string, props map<string,string>")
    got = {r.id: (r.name, r.props) for r in mutations.upserted_nodes(n, batch).collect()}
    assert got == {"a": ("x", {"k": "2", "l": "1"}), "b": ("y", {}), "c": ("z", {})}
    n, e = graph(spark, [("a", "Class"), ("b", "Class")], [("a", "CALLS", "b")])
    left, edges = mutations.patched(n, e, n.where("id = 'b'"), e.limit(0), n.where("id = 'b'").select("id"))
    assert [r.id for r in left.collect()] == ["a"] and edges.count() == 0



def test_usage_never_falls_below_nothing(spark):
    rows = [("o", "p", 1, "set", 5), ("o", "p", 2, "delta", -9), ("o", "p", 3, "delta", 4), ("o", "q", 1, "set", 7), ("o", "q", 2, "delete", 0)]
    assert mutations.usage(spark.createDataFrame(rows, "owner string, project string, seq int, kind string, bytes long")).first().used_bytes == 4


def test_usage_equals_a_fold(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("op"), rng.choice("abc"), k, rng.choice(["delta", "delta", "delta", "set", "delete"]), rng.randint(-9, 9)) for k in range(300)]
    size = {}
    for owner, project, _, kind, n in rows:
        size[owner, project] = n if kind == "set" else 0 if kind == "delete" else max(size.get((owner, project), 0) + n, 0)
    want = {o: sum(v for (x, _), v in size.items() if x == o) for o in "op"}
    frame = spark.createDataFrame(rows, "owner string, project string, seq int, kind string, bytes long")
    assert {r.owner: r.used_bytes for r in mutations.usage(frame).collect()} == want
    hot = spark.range(50_000).selectExpr("'o' owner", "'p' project", "id seq", "'delta' kind", "1L bytes")
    assert mutations.usage(hot).first().used_bytes == 50_000


def test_an_edge_of_very_many_rows_keeps_its_first_lines(spark):
    rows = spark.range(60_000).selectExpr("'a' source", "'CALLS' type", "'b' target", "if(id % 3 = 0, null, cast(id as int)) line_number", "-id seq")
    r = shaping.aggregated(rows).first()
    assert (r.weight, r.line_number, r.occurrences) == (60_000, 59_999, [59_999, 59_998, 59_996, 59_995, 59_993, 59_992, 59_990, 59_989, 59_987, 59_986])


def test_evaluation_of_equal_sets_is_perfect(spark):
    a = spark.createDataFrame([("x",), ("y",)], "key string")
    r = inference.evaluation(a, a).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (2, 0, 0, 1.0)
    assert inference.evaluation(a.limit(0), a).agg(F.max("recall")).first()[0] == 0.0


def test_what_a_name_means_in_one_row(spark):
    n, _ = graph(spark, [("a.x()", "Method"), ("b.x()", "Method"), ("c", "Class")], [("c", "CALLS", "c")])
    got = [tuple(traversal.resolution(n, q).first()) for q in ("c", "x()", "none")]
    assert got == [("c", "UNIQUE", 1, "c"), ("x()", "AMBIGUOUS", 2, None), ("none", "NOT_FOUND", 0, None)]


def test_kinds_that_a_cap_hides_are_told(spark):
    n, e = graph(spark, [(x, "Class") for x in "abcd"], [("a", "CALLS", "b"), ("a", "CALLS", "c"), ("a", "CALLS", "d"), ("b", "CALLS", "a")])
    assert [tuple(r) for r in shaping.truncations(shaping.class_context(n, e, "a", 2)).collect()] == [("out:CALLS", 2, 3)]


def test_links_that_close_cycles_equal_a_walk(spark):
    import random

    rng = random.Random(5)
    for cyclic in (False, True):
        deps = {(max(a, b), min(a, b)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if a != b} | ({(3, 40), (9, 9)} if cyclic else set())
        links = {(rng.randrange(70), rng.randrange(70)) for _ in range(200)}

        def reached(at):
            seen, left = {at}, [at]
            while left:
                x = left.pop()
                new = {b for a, b in deps if a == x} - seen
                seen |= new
                left += new
            return seen

        d, l = spark.createDataFrame(sorted(deps), "task long, needs long"), spark.createDataFrame(sorted(links), "task long, needs long")
        got = {(r.task, r.needs): r.cycle for r in tasks.would_cycle(d, l).collect()}
        assert got == {(t, n): t in reached(n) for t, n in links}


def test_ranks_rise_along_steps_and_leave_cycles_out(spark):
    n = spark.createDataFrame([(k,) for k in "abcdxy"], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "d")], "source string, target string")
    assert {(r.id, r["rank"]) for r in tasks.ranks(n, e).collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_the_stored_graph_is_written_without_a_sort(spark):
    from codeloom.plans.staging import OPEN_FOLDERS, staged
    from codeloom.sources.graph_tables import edges

    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    rows = spark.range(3000).select("id", F.concat(F.lit("t"), F.col("id") % 50).alias("type"))  # more folders than are open at once
    assert OPEN_FOLDERS < 50 and {tuple(r) for r in staged(rows, "type").collect()} == {tuple(r) for r in rows.collect()} and spark.conf.get(name) == before
    e = edges(spark, "/root/testdata/sf0.001")
    assert all("id=" not in f and "seq" not in spark.read.parquet(f).columns for f in e.inputFiles()[:3])  # made where they are read
    assert e.where("id <> sha2(concat_ws('|', source, type, target), 256)").isEmpty() and e.columns[0] == "id"


def test_ends_are_looked_up_without_sorting_the_edges(spark, monkeypatch):
    ids = [f"n{k:02}" for k in range(40)]
    n, e = graph(spark, [(i, "Method") for i in ids], [(i, t, j) for i in [*ids, "gone"] for t in ("CALLS", "READS", "WRITES") for j in (ids[3], ids[31], "lost")])
    monkeypatch.setattr(staging, "FEW", 10)
    monkeypatch.setattr(staging, "PER_TASK", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = shaping.edges_by_type(n, e, "calls, reads")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and found.rdd.getNumPartitions() >= 8
        assert {r.id for r in found.collect()} == {f"{i}|{t}|{j}" for i in ids for t in ("CALLS", "READS") for j in (ids[3], ids[31])}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_file_pairs_are_summed_in_parts_by_the_number_of_edges(spark, monkeypatch):
    ids = [f"f{k:02}.m" for k in range(20)]
    n, e = graph(spark, [(i, "Method") for i in ids], [(i, "CALLS", j) for i in ids for j in [*ids[:5], "lost.m"]])
    monkeypatch.setattr(staging, "FEW", 10)
    monkeypatch.setattr(staging, "PER_TASK", 10)
    found = shaping.file_dependencies(n, e)
    assert found.rdd.getNumPartitions() == 12
    assert {(r.source, r.target, r.weight, r.n_edges) for r in found.collect()} == {(f"/f/{i[:3]}", f"/f/{j[:3]}", 1, 1) for i in ids for j in ids[:5] if i != j}


def test_only_small_frontiers_pass_through_the_driver(spark, monkeypatch):
    _, e = graph(spark, [], [(f"n{k:02}", "CALLS", f"n{j:02}") for k in range(30) for j in (k // 2, k // 3) if j < k])
    plans = []

    def noted(df, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staging.staged(df, *by)

    monkeypatch.setattr(traversal, "staged", noted)
    seeds = spark.createDataFrame([("n00",)], "id string")
    few = set(traversal.reach(seeds, e, 5, "in").collect())
    assert any("BroadcastHashJoin" in p for p in plans)
    plans.clear()
    monkeypatch.setattr(staging, "FEW", 0)
    assert set(traversal.reach(seeds, e, 5, "in").collect()) == few
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
