"""Flows, use cases and composite analyses on small graphs."""

from pyspark.sql import functions as F

from codeloom.operators import flows, shaping, use_cases
from codeloom.plans import tools
from codeloom.streaming import events
from test_graph import graph


def test_a_flow_ends_at_the_nearest_model_through_the_implementation(spark):
    n, e = graph(
        spark,
        [("h()", "Method"), ("I.m()", "Method"), ("A.m()", "Method"), ("M", "DBModel"), ("N", "DBModel"), ("z()", "Method")],
        [("h()", "CALLS", "I.m()"), ("A.m()", "OVERRIDES", "I.m()"), ("A.m()", "READS", "M"), ("A.m()", "WRITES", "N"), ("z()", "CALLS", "h()")],
    )
    starts = spark.createDataFrame([("f", "h()"), ("g", "N")], "flow string, id string")
    got = sorted(flows.data_flows(n, e, starts).collect(), key=lambda r: (r.flow, r.step))
    assert [(r.flow, r.id, r.complete) for r in got] == [("f", "h()", True), ("f", "I.m()", True), ("f", "A.m()", True), ("f", "M", True), ("g", "N", False)]


def test_roots_call_and_are_not_called(spark):
    n, e = graph(spark, [("AController", "Class"), ("AController.a()", "Method"), ("AController.b()", "Method"), ("X.c()", "Method")], [("AController.a()", "CALLS", "AController.b()"), ("AController.b()", "CALLS", "X.c()")])
    assert [r.id for r in flows.call_roots(n, e).collect()] == ["AController.a()"]


def test_a_view_takes_in_what_use_cases_include(spark):
    r = spark.createDataFrame([("Admin", "User", "generalization"), ("User", "u1", "association"), ("Guest", "u9", "association"), ("u1", "u2", "include"), ("u2", "u3", "extend")], "source string, target string, type string")
    assert {x.id for x in flows.use_case_view(r, "Admin").collect()} == {"u1", "u2", "u3"}


def test_goals_leave_out_assets_screens_and_pages(spark):
    rows = [("a", "GET", "/a.css", None, None, None), ("b", "GET", "/x/add-new-cards", None, None, None), ("c", "GET", "/shop", None, None, True), ("d", "POST", "/shop", None, None, True), ("e", "GET", "/api/v1/cities/{id}", "UserApi", "ROLE_SELLER", False)]
    got = {r.route: r for r in use_cases.inferred(spark.createDataFrame(rows, "route string, method string, path string, controller string, role string, is_view boolean")).collect()}
    assert set(got) == {"d", "e"}
    paths = ["/actuator/x", "/ERROR", "/", "/home/x", "/a/internal/b", "/api/auth/token", "/auth/login", "/user-apis", "/api/check-deletes/brand/{id}", "/orders/my-page", "/my-page/orders", "/login", None, " "]
    views = spark.createDataFrame([(p, "GET", p, None, None, p == "/login") for p in paths], "route string, method string, path string, controller string, role string, is_view boolean")
    assert {r.route for r in use_cases.goals(views).collect()} == {"/auth/login", "/my-page/orders", "/login"}
    assert (got["e"].actor, got["e"].domain, got["e"].domain_confidence) == ("Seller", "User", 0.9)
    assert (got["d"].actor, got["d"].actor_confidence, got["d"].domain) == ("User", 0.7, "Shop")


def test_tests_that_refer_come_before_those_that_are_named_alike(spark):
    n, e = graph(spark, [("A", "Class"), ("A.m()", "Method"), ("ATest", "Class"), ("BTest", "Class"), ("C", "Class")], [("BTest", "CALLS", "A.m()"), ("C", "CALLS", "A")])
    got = tools.related_tests(n, e, "A").collect()
    assert [(r.id, r.confidence, r.total) for r in got] == [("BTest", "HIGH", 2), ("ATest", "MEDIUM", 2)]
    n, e = graph(spark, [("A", "Class"), ("A.B", "Class"), ("A.B.m(x.Y)", "Method"), ("AB.m()", "Method"), ("DTest", "Class"), ("AITCase", "Class"), ("ETest", "Class")], [("DTest", "RETURNS", "A.B.m(x.Y)"), ("ETest", "CALLS", "AB.m()")])
    assert [r.id for r in tools.related_tests(n, e, "A").collect()] == ["DTest", "AITCase"]  # members of nested types count, names that begin alike don't


def test_a_change_tells_all_routes_that_reach_it(spark):
    routes = [f"GET /{k}" for k in range(60)]
    n, e = graph(spark, [("a.x()", "Method"), ("b.y()", "Method")], [("b.y()", "CALLS", "a.x()"), *[("b.y()", "HANDLES_ROUTE", r) for r in routes]])
    got = [r.id for r in tools.verified_change(n, e, ["/f/a"]).collect() if r.kind == "route"]
    assert sorted(got) == sorted(routes)
    assert tools.verified_change(n, e, ["/f/a"], most_routes=7).where("kind = 'route'").count() == 7


def test_a_change_tells_all_symbols_and_all_that_depends_on_them(spark):
    own, far = [f"a.m{k}()" for k in range(60)], [f"b.n{k}()" for k in range(600)]
    n, e = graph(spark, [(i, "Method") for i in own + far], [(i, "CALLS", own[k % 60]) for k, i in enumerate(far)])
    count = lambda **most: {r.kind: r["count"] for r in tools.verified_change(n, e, ["/f/a"], **most).groupBy("kind").count().collect()}
    assert count() == {"changed": 60, "dependent": 600}
    assert count(most=5) == {"changed": 5, "dependent": 45}


def test_a_report_tells_all_routes_and_the_tests_of_all_types(spark):
    types, names = [f"a.C{k}" for k in range(8)], [f"a.T{k}Test" for k in range(30)]
    n, e = graph(spark, [(i, "Interface" if i == "a.C7" else "Class") for i in types] + [("q.x()", "Method")] + [(i.replace("a.", "t."), "Class") for i in names],
                 [("q.x()", "CALLS", types[0])] + [("q.x()", "HANDLES_ROUTE", f"GET /{k}") for k in range(60)] + [(i.replace("a.", "t."), "TYPE_OF", types[k % 8]) for k, i in enumerate(names)])
    got = tools.change_report(n, e, ["/f/a"]).collect()
    assert {k: sum(r.kind == k for r in got) for k in ("changed", "dependent", "route", "test")} == {"changed": 8, "dependent": 1, "route": 60, "test": 30}
    assert {r.id for r in got if r.kind == "risk"} == {"60 routes can reach the changed symbols", "an interface changed: every implementation is affected"}
    few = tools.change_report(n, e, ["/f/a"], most=50, classes=1, tests=3).collect()
    assert sum(r.kind == "test" for r in few) == 3 and sum(r.kind == "route" for r in few) == 50


def test_changes_errors_and_plans(spark):
    n, e = graph(spark, [("a.x()", "Method"), ("b.y()", "Method")], [("b.y()", "CALLS", "a.x()"), ("b.y()", "HANDLES_ROUTE", "GET /r")])
    assert {(r.kind, r.id) for r in tools.verified_change(n, e, ["/f/a"]).collect()} == {("changed", "a.x()"), ("dependent", "b.y()"), ("route", "GET /r")}
    out = spark.createDataFrame([(1, "/f/a:1: error: x")], "k int, text string")
    assert tools.explained_errors(n, e, out, "k").count() == 0  # no Java file
    sources = spark.createDataFrame([("/f/a", "fetch the order\norder"), ("/f/b", "nothing")], "file string, text string")
    assert [(r.file, r.score, r.n_dependents) for r in tools.planned_change(n, e, sources, "fetch order").collect()] == [("/f/a", 32, 1)]
    assert {(r.line, r.id) for r in tools.found_lines(n, sources, "ORDER").collect()} == {(1, "a.x()"), (2, "a.x()")}
    assert {r.level for r in tools.test_plan(spark.createDataFrame([(1, "Login route")], "id int, text string")).collect()} == {"unit", "mcp-live / api"}
    high = tools.test_plan(spark.createDataFrame([(1, "Login route of the repository", ["a.vue"])], "id int, text string, files array<string>"), "high").collect()
    assert [r.level for r in high] == ["unit", "integration/Testcontainers"]
    assert tools.method_source(n, e, sources, "a.x()").where(F.col("line") == 2).first().text == "order"
    assert tools.method_source(n, e, sources, "no.such()").count() == 0
    hidden = spark.createDataFrame([("/f/a", "x\npassword=hunter2\n-----BEGIN PRIVATE KEY-----\nabc")], "file string, text string")
    assert "hunter2" not in str(tools.method_source(n, e, hidden, "a.x()").collect())
    assert tools.impact_summary(n, e, "a.x()").first().n_routes == 1


def test_watched_paths_titles_and_flow_parts(spark):
    paths = spark.createDataFrame([("a/B.java",), ("target/B.java",), ("a/.git/B.java",), ("a/b.png",), ("out/B.java",), ("a\\build\\B.java",), ("pom.xml",), ("build.java",)], "path string")
    assert [r.path for r in events.watched(paths).collect()] == ["a/B.java", "out/B.java", "build.java"]
    titles = spark.createDataFrame([("/api/order_lines/{id}/items",)], "path string")
    assert titles.select(flows.path_title(F.col("path"))).first()[0] == "Api order lines items"
    n, e = graph(spark, [("a()", "Method"), ("b()", "Method"), ("c()", "Method")], [("a()", "CALLS", "b()"), ("b()", "CALLS", "c()")])
    kept, among = shaping.flow_part(n, e, spark.createDataFrame([("a()",), ("b()",)], "id string"))
    assert {r.id for r in kept.collect()} == {"a()", "b()"} and [(r.source, r.target) for r in among.collect()] == [("a()", "b()")]
    listed = [r.id for r in e.where("target = 'c()'").collect()]
    assert [r.target for r in shaping.flow_part(n, e, kept.select("id"), listed)[1].collect()] == ["c()"]


def test_frames_of_a_trace_are_found_in_the_graph(spark):
    nodes = spark.createDataFrame([("1", "Method", "m", "a.B.m(x.Y)"), ("2", "Class", "B", "a.B"), ("3", "Method", "k", "a.B.k()")], "id string, type string, name string, full_name string")
    traces = spark.createDataFrame([(1, "boom\n at a.B.m(B.java:3)\n at no.Such.m(C.java:1)"), (2, None)], "key int, text string")
    assert [(r.key, r.cause, r.id) for r in tools.explained_failures(nodes, traces, "key").collect()] == [(1, 0, "1")]


def test_reports_on_changes_name_tests_and_risks(spark):
    n, e = graph(
        spark, [("A", "Interface"), ("A.x()", "Method"), ("ATest", "Class"), ("c()", "Method"), ("GET /r", "APIEndpoint")],
        [("c()", "CALLS", "A.x()"), ("c()", "HANDLES_ROUTE", "GET /r"), ("ATest", "TYPE_OF", "A")],
    )
    got = {(r.kind, r.id) for r in tools.change_report(n, e, ["/f/A"]).collect()}
    assert {("test", "ATest"), ("dependent", "c()"), ("route", "GET /r")} <= got
    assert {i for k, i in got if k == "risk"} == {"1 routes can reach the changed symbols", "an interface changed: every implementation is affected"}
    assert tools.change_report(n, e, ["/none"]).count() == 0


def test_meta_of_a_cap_tells_what_is_left_out(spark):
    from codeloom.operators import shaping

    n, e = graph(spark, [("a", "Class"), ("b", "Class"), ("c", "Method")], [("a", "CALLS", "b"), ("b", "CALLS", "c")])
    whole = shaping.cap_meta(n, e, *shaping.capped(n, e, 9, 9)).first()
    assert (whole.truncated, whole.returned_nodes, whole.reason) == (False, 3, None)
    part = shaping.cap_meta(n, e, *shaping.capped(n, e, 2, 9)).first()
    assert (part.truncated, part.total_nodes, part.returned_nodes, part.returned_edges, part.reason) == (True, 3, 2, 1, "GRAPH_TOO_LARGE")


def test_cycles_and_pruning_take_whole_tables(spark):
    import random

    from codeloom.operators import tasks

    rng = random.Random(2)
    dep = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)}
    links = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(80)}

    def reaches(a, b):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            new = {y for s, y in dep if s == x} - seen
            seen |= new
            todo += new
        return b in seen

    d = spark.createDataFrame(sorted(dep), "task long, needs long")
    got = {(r.task, r.needs): r.cycle for r in tasks.would_cycle(d, spark.createDataFrame(sorted(links), "task long, needs long")).collect()}
    assert got == {(t, n): reaches(n, t) for t, n in links}
    assert tasks.would_cycle(d, spark.createDataFrame([], "task long, needs long")).count() == 0
    chain = spark.range(13).selectExpr("id", "'COMPLETED' status")
    gone = tasks.pruned(chain, spark.range(12).selectExpr("id task", "id + 1 needs"))
    assert sorted((r.id, r["round"]) for r in gone.collect()) == [(k, k + 1) for k in range(13)]
