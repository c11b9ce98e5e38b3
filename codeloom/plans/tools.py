"""Composite analyses: each puts operators together and answers one question about a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scalars import keywords, redacted_lines
from codeloom.operators.shaping import enclosing_symbol, related_symbols
from codeloom.operators.traversal import affected_routes, impact, override_counterparts, owner_of, reachable_symbols, resolve
from codeloom.plans.staging import held, staged
from codeloom.sources.text_tables import compiler_errors, file_scores, line_range, lines, stack_frames

#: Endings of tests' names, edges by which a test refers to code, and types that hold members.
TEST_SUFFIXES = ("Test", "Tests", "IT", "ITCase", "IntegrationTest")
REFERENCE_EDGES = ("IMPORTS", "CALLS", "TYPE_OF", "EXTENDS", "INSTANTIATES", "PARAMETER_TYPE", "RETURNS")
CLASS_LIKE = ("Class", "Interface", "Enum", "Record")
#: Words of a change that ask for a level of tests beside the unit tests, and endings of files that do.
PERSISTENCE = ("repository", "neo4j", "cypher", "persist", "database", "entity")
ENDPOINT = ("endpoint", "api", "controller", "route", "mcp")
FRONTEND = ("vue", "frontend", "component")
FRONTEND_FILES = (".vue", ".ts", ".tsx", ".js")
LEVELS = ("unit", "integration/Testcontainers", "mcp-live / api", "frontend-unit", "browser-smoke")


def is_test(nodes: DataFrame) -> Column:
    path = F.coalesce(F.lower("file_path"), F.lit(""))
    return path.rlike("(src/test/|test/java/)") | F.coalesce(F.col("name").rlike(f"({'|'.join(TEST_SUFFIXES)})$"), F.lit(False))


def members_of(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """id of the nodes whose full name begins with that of one of classes (id, full_name) and a dot: members, and those of nested types.

    A name meets each of its own dotted beginnings, as many as it has parts, in an equi join.
    """
    before_call = F.split(F.regexp_extract("full_name", r"^[^(]*", 0), "[.]")
    starts = nodes.select("id", "full_name", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(before_call) - 1, F.lit(1))), lambda k: F.array_join(F.slice(before_call, 1, k), "."))).alias("start"))
    return starts.where("full_name <> start").join(classes.select(F.col("full_name").alias("start")), "start", "left_semi").select("id").distinct()


def tests_of(nodes: DataFrame, edges: DataFrame, classes: DataFrame) -> DataFrame:
    """id, full_name, rank: all tests that refer to one of classes (id, full_name, name) or its members (0) or else are named after one (1), each once."""
    ids = held(classes.select("id").unionAll(members_of(nodes, classes)).distinct(), "id")
    tests = nodes.where(is_test(nodes))
    hit = edges.where(F.col("type").isin(*REFERENCE_EDGES)).join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    by_graph = tests.join(hit, "id", "left_semi").select("id", "full_name", F.lit(0).alias("rank"))
    expected = classes.select(F.explode(F.array(*[F.concat(F.col("name"), F.lit(s)) for s in TEST_SUFFIXES])).alias("name"))
    by_name = tests.where(F.col("type").isin(*CLASS_LIKE)).join(expected, "name", "left_semi").select("id", "full_name", F.lit(1).alias("rank"))
    return by_graph.unionAll(by_name).groupBy("id", "full_name").agg(F.min("rank").alias("rank"))


def related_tests(nodes: DataFrame, edges: DataFrame, target: str, cap: int = 50) -> DataFrame:
    """id, match_type, confidence, total: tests that refer to a class or its members (HIGH), then those named after it (MEDIUM)."""
    cls = nodes.where((F.col("id") == target) & F.col("type").isin(*CLASS_LIKE)).select("id", "full_name", "name")
    all_ = tests_of(nodes, edges, cls)
    total = all_.agg(F.count(F.lit(1)).alias("total"))
    top = all_.orderBy("rank", "full_name", "id").limit(cap).crossJoin(F.broadcast(total))  # one row
    return top.select("id", F.when(F.col("rank") == 0, "GRAPH_REFERENCE").otherwise("NAMING_CONVENTION").alias("match_type"), F.when(F.col("rank") == 0, "HIGH").otherwise("MEDIUM").alias("confidence"), "total")


def verified_change(nodes: DataFrame, edges: DataFrame, files: list[str], depth: int = 2, most: int | None = None, most_routes: int | None = None) -> DataFrame:
    """kind, id, depth: the symbols of changed files, what depends on them, and the routes that reach them.

    All of them, unless `most` says how many symbols (and ten times as many dependents with them) and most_routes how many routes.
    """
    own = nodes.where(F.col("file_path").isin(files) & (F.col("type") != "File"))
    own = (own if most is None else own.orderBy("full_name", "id").limit(most)).select("id")
    near = reachable_symbols(edges, own, depth, None if most is None else 10 * most).where("depth > 0")
    routes = affected_routes(edges, own, depth, most_routes)
    return own.select(F.lit("changed").alias("kind"), "id", F.lit(0).alias("depth")).unionAll(near.select(F.lit("dependent"), "id", "depth")).unionAll(routes.select(F.lit("route"), F.col("route").alias("id"), "depth"))


def change_report(nodes: DataFrame, edges: DataFrame, files: list[str], depth: int = 8, most: int | None = None, classes: int | None = None, tests: int | None = None) -> DataFrame:
    """kind, id, depth: what `verified_change` finds, then the tests of the changed types (test), and what to look out for (risk): routes
    that reach the change, an interface in it, and types without a test.

    All of it, unless `most` says how many symbols and routes, `classes` of how many types the tests are looked for, and `tests` how many are told.
    """
    found = staged(verified_change(nodes, edges, files, depth, most, most))
    changed = held(found.where("kind = 'changed'").select("id"), "id")
    own = nodes.join(changed, "id", "left_semi").where(F.col("type").isin(*CLASS_LIKE)).select("id", "type", "full_name", "name")
    own = staged(own if classes is None else own.orderBy("full_name", "id").limit(classes))
    near = tests_of(nodes, edges, own).select("id").distinct()
    named = staged((near if tests is None else near.orderBy("id").limit(tests)).select(F.lit("test").alias("kind"), "id", F.lit(0).alias("depth")))
    n_routes, n_tests = found.where("kind = 'route'").count(), named.count()
    risks = [f"{n_routes} routes can reach the changed symbols"] if n_routes else []
    risks += ["an interface changed: every implementation is affected"] if not own.where("type = 'Interface'").isEmpty() else []
    risks += ["no related test was found"] if not n_tests and not found.where("kind = 'changed'").isEmpty() else []
    told = nodes.sparkSession.createDataFrame([("risk", r, 0) for r in risks], "kind string, id string, depth int")
    return found.unionAll(named).unionAll(told)


def impact_with_counterparts(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 2, most: int = 100) -> DataFrame:
    """id, depth: dependents of a symbol and of the methods that override it or that it overrides, each at its least depth."""
    other = override_counterparts(nodes, edges).where(F.col("id") == target).select(F.col("counterpart").alias("id")).distinct().orderBy("id").limit(most)
    seeds = other.unionAll(nodes.where(F.col("id") == target).select("id"))
    return reachable_symbols(edges, seeds, depth, 1 << 30).where("depth > 0")


def planned_change(nodes: DataFrame, edges: DataFrame, sources: DataFrame, task: str, top: int = 10) -> DataFrame:
    """file, score, n_dependents: the files that a task's words point to, with how much depends on their symbols.

    sources: file, text.
    """
    spark = sources.sparkSession
    words = spark.range(1).select(keywords(F.lit(task)).alias("w")).first()["w"]
    best = file_scores(sources, "file", words).orderBy(F.desc("score"), "file").limit(top)
    symbols = nodes.select("id", F.col("file_path").alias("file")).join(F.broadcast(best.select("file")), "file")  # `top` rows
    uses = edges.where(F.col("type").isin("CALLS", "IMPLEMENTS", "EXTENDS", "INJECTS", "IMPORTS")).select("source", F.col("target").alias("id"))
    n = symbols.join(uses, "id").groupBy("file").agg(F.countDistinct("source").alias("n_dependents"))
    return best.join(n, "file", "left").select("file", "score", F.coalesce("n_dependents", F.lit(0)).alias("n_dependents"))


def explained_failures(nodes: DataFrame, traces: DataFrame, key: str) -> DataFrame:
    """key, cause, position, id: frames of stack traces that are methods of the graph, found by class and method name; the deepest cause first."""
    m = nodes.where("type = 'Method'").select("id", owner_of(F.col("full_name")).alias("class_name"), F.col("name").alias("method"))
    return stack_frames(traces, key).join(m, ["class_name", "method"]).select(key, "cause", "position", "id").orderBy(key, F.desc("cause"), "position", "id")


def explained_errors(nodes: DataFrame, edges: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """key, file, at_line, message, id, n_callers, hint of compiler errors: the symbol around each and how many call it."""
    found = compiler_errors(outputs, key)
    around = enclosing_symbol(nodes, found.select(F.col("file").alias("file_path"), F.col("at_line").alias("line")).distinct())
    callers = edges.where("type = 'CALLS'").groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n_callers"))
    hint = F.when(F.contains("message", F.lit("cannot find symbol")), "missing import or renamed symbol").when(F.contains("message", F.lit("incompatible types")), "type mismatch").when(F.contains("message", F.lit("does not exist")), "missing dependency").otherwise("see the message")
    j = found.join(around.select(F.col("file_path").alias("file"), F.col("line").alias("at_line"), "id"), ["file", "at_line"], "left").join(callers, "id", "left")
    return j.select(key, "file", "at_line", "message", "id", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), hint.alias("hint"))


def found_lines(nodes: DataFrame, sources: DataFrame, query: str) -> DataFrame:
    """file, line, id: lines of sources (file, text) that hold the query, with the symbol around them."""
    hit = lines(sources, "file").where(F.contains(F.lower("text"), F.lit(query.lower()))).select(F.col("file").alias("file_path"), "line")
    return hit.join(enclosing_symbol(nodes, hit.distinct()), ["file_path", "line"], "left").select(F.col("file_path").alias("file"), "line", "id")


def method_source(nodes: DataFrame, edges: DataFrame, sources: DataFrame, query: str, window: int = 60, most: int = 500) -> DataFrame:
    """kind, id, line, text of the one symbol that a name means: its lines with secrets hidden (source), and the symbols that it
    calls, reads, writes and returns or that call it, 25 of each kind by name; none if the name is ambiguous or unknown.

    Without an end line the `window` lines after the first are shown. sources: file, text.
    """
    one = resolve(nodes, query).where("status = 'UNIQUE'").select("id")
    span = nodes.join(one, "id", "left_semi").select("id", F.col("file_path").alias("file"), F.greatest("line_number", F.lit(1)).alias("first"), F.coalesce("end_line", F.col("line_number") + window).alias("last"))
    part = F.slice(F.split("text", "\r?\n"), F.col("first"), F.greatest(F.lit(1), F.least(F.col("last") - F.col("first") + 1, F.lit(most))))
    shown = sources.join(F.broadcast(span), "file").select("id", "first", F.posexplode(redacted_lines(part)).alias("at", "text"))  # one row
    lines_ = shown.select(F.lit("source").alias("kind"), "id", (F.col("first") + F.col("at")).alias("line"), "text")
    found = one.first()
    if found is None:
        return lines_
    near = related_symbols(nodes, edges, found["id"])
    return lines_.unionAll(near.select("kind", "id", F.col("rank").cast("int"), F.col("full_name")))


def source_file(nodes: DataFrame, sources: DataFrame, first: int, last: int, most: int = 500) -> DataFrame:
    """file, kind, line, text: lines first to last of each of sources (file, text), `most` at most and secrets hidden (line), and the
    symbols whose spans meet the range, by their first line (symbol: id)."""
    end = min(last, first + most - 1)
    shown = line_range(sources, "file", first, last, most).select("file", F.lit("line").alias("kind"), "line", "text")
    spans = nodes.where("line_number is not null and type <> 'File'").select(F.col("file_path").alias("file"), "line_number", F.coalesce("end_line", "line_number").alias("end"), "id")
    own = spans.join(sources.select("file"), "file", "left_semi").where((F.col("line_number") <= end) & (F.col("end") >= first))
    return shown.unionAll(own.select("file", F.lit("symbol"), "line_number", "id"))


def test_plan(changes: DataFrame, tolerance: str = "low") -> DataFrame:
    """id, level: the levels of tests that a change (id, text, and files, an array that may be missing) asks for; a unit test always.

    With a high tolerance of risk a plan is its first two levels.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    files = F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda f: F.lower(f)) if "files" in changes.columns else F.array().cast("array<string>")
    says = lambda words: F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(True)) for w in words], F.lit(False))
    ends = lambda f: F.coalesce(*[F.when(F.endswith(f, F.lit(x)), F.lit(True)) for x in FRONTEND_FILES], F.lit(False))
    front = says(FRONTEND) | F.exists(files, ends)
    asked = (F.lit(True), says(PERSISTENCE), says(ENDPOINT), front, front)
    levels = F.filter(F.array(*[F.when(a, F.lit(name)) for name, a in zip(LEVELS, asked, strict=True)]), lambda x: x.isNotNull())
    return changes.select("id", F.explode(F.slice(levels, 1, 2) if tolerance == "high" else levels).alias("level"))


def impact_summary(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 3) -> DataFrame:
    """direct, total, risk, n_routes of one symbol."""
    i = impact(nodes, edges, target, depth).select("direct", "total", "risk").distinct()
    seeds = nodes.where(F.col("id") == target).select("id")
    routes = affected_routes(edges, seeds, depth).agg(F.count(F.lit(1)).alias("n_routes"))
    return i.crossJoin(F.broadcast(routes))  # one row
