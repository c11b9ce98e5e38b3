"""Filters, projections, caps and statistics of a graph given as nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.traversal import reach
from codeloom.plans.staging import dealt, held

#: Node and edge types of the vocabulary.
NODE_TYPES = ("Project", "Package", "File", "Class", "Interface", "Enum", "Record", "DBModel", "Method", "Constructor", "Field", "Annotation", "LocalVariable", "Route", "APIEndpoint", "External")
EDGE_TYPES = (
    "OWNS", "CONTAINS", "DEFINES", "HAS_METHOD", "HAS_FIELD", "HAS_INNER", "HAS_RELATION", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "IMPORTS", "TYPE_OF", "RETURNS", "PARAMETER_TYPE", "THROWS",
    "CALLS", "INSTANTIATES", "INJECTS", "HANDLES_ROUTE", "ANNOTATED_BY", "READS", "WRITES", "CATCHES", "STEP_IN_FLOW", "PUBLISHES_EVENT", "LISTENS_EVENT", "TRIGGERS", "RESOLVES_TO", "CALLS_DYNAMIC", "DISPATCH_CANDIDATES",
)
#: What the architecture view keeps.
ARCHITECTURE_NODES = ("File", "Class", "Interface", "Enum", "Record", "DBModel", "Method", "Constructor", "APIEndpoint")
ARCHITECTURE_EDGES = ("DEFINES", "HAS_METHOD", "HAS_INNER", "HAS_RELATION", "IMPORTS", "CALLS", "INJECTS", "HANDLES_ROUTE", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "STEP_IN_FLOW", "RESOLVES_TO", "TRIGGERS")
FILE_DEFINED = ("Class", "Interface", "Enum", "Record", "DBModel")
FILE_DEPENDENCIES = ("IMPORTS", "CALLS", "INJECTS", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "HAS_RELATION", "STEP_IN_FLOW", "RESOLVES_TO", "TRIGGERS")
#: Which node types a cap keeps first, and which edge a pair of nodes shows.
CAP_PRIORITY = {
    "Project": 100, "Package": 90, "File": 80, "Class": 70, "Interface": 70, "Enum": 65, "Record": 65, "DBModel": 65, "Route": 60, "APIEndpoint": 60,
    "Method": 40, "Constructor": 40, "Field": 20, "Annotation": 15, "External": 10, "LocalVariable": 5,
}
EDGE_PRIORITY = {"STEP_IN_FLOW": 10, "CONTAINS": 9, "EXTENDS": 8, "IMPLEMENTS": 7, "OVERRIDES": 6, "HAS_RELATION": 6, "DEFINES": 5, "HANDLES_ROUTE": 4, "HAS_METHOD": 3, "CALLS": 2, "IMPORTS": 1}
#: Node types that the client never shows.
HIDDEN_NODES = ("Package", "Field", "LocalVariable")


def ranked(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def parse_types(text: str, known: tuple[str, ...]) -> list[str]:
    """Types of a comma-separated list, trimmed; an unknown one raises."""
    found = [t.strip() for t in text.split(",") if t.strip()]
    if unknown := [t for t in found if t not in known]:
        raise ValueError(f"unknown types: {', '.join(unknown)}")
    return found


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes; dangling ones go."""
    ids = held(nodes.select("id"), "id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def by_type(nodes: DataFrame, node_types: str, include_types: str | None = None) -> DataFrame:
    """Nodes of the types of a list; include_types, where it names any, stands in for node_types."""
    return nodes.where(F.col("type").isin(parse_types(include_types or "", NODE_TYPES) or parse_types(node_types, NODE_TYPES)))


def edges_by_type(nodes: DataFrame, edges: DataFrame, edge_types: str) -> DataFrame:
    return with_both_ends(edges.where(F.col("type").isin(parse_types(edge_types.upper(), EDGE_TYPES))), nodes)


def by_package(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes of packages that start with the prefix, as text: com.foo also takes com.foobar."""
    return nodes.where(F.col("package_name").startswith(prefix) | ((F.col("type") == "Package") & F.col("full_name").startswith(prefix)))


def filtered_graph(nodes: DataFrame, edges: DataFrame, package: str | None = None, depth: int = 0, node_types: str | None = None, edge_types: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Package seeds, grown undirected over every edge type by depth steps, then the node and the edge types."""
    kept = nodes
    if package is not None:
        seeds = by_package(nodes, package)
        kept = nodes.join(reach(seeds, edges, depth, "both").select("id"), "id", "left_semi") if depth else seeds
    if node_types:
        kept = by_type(kept, node_types)
    return kept, edges_by_type(kept, edges, edge_types) if edge_types else with_both_ends(edges, kept)


def architecture(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The types, files and routes of a graph, and the edges among them; DEFINES only from a file to a type."""
    kept = nodes.where(F.col("type").isin(*ARCHITECTURE_NODES))
    kinds = kept.select("id", "type")
    e = edges.where(F.col("type").isin(*ARCHITECTURE_EDGES))
    e = e.join(kinds.select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source").join(kinds.select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target")
    e = e.where((F.col("type") != "DEFINES") | ((F.col("source_type") == "File") & F.col("target_type").isin(*FILE_DEFINED)))
    return kept, merged(e)


def view(nodes: DataFrame, edges: DataFrame, mode: str | None = None, include_deep: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph of a mode: baseline (also none or a blank) is the architecture, deep is all; spaces and case don't matter, another mode raises."""
    name = (mode or "").strip().lower()
    if include_deep or name == "deep":
        return nodes, edges
    if name in ("", "baseline"):
        return architecture(nodes, edges)
    raise ValueError("mode must be baseline or deep")


def merged(edges: DataFrame) -> DataFrame:
    """source, type, target, weight, line_number: one edge for each triple; weights under 1 or null count as 1."""
    return edges.groupBy("source", "type", "target").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1))).alias("weight"), F.min("line_number").alias("line_number"))


def aggregated(rows: DataFrame, first: int = 10) -> DataFrame:
    """source, type, target, weight, line_number, occurrences of raw edge rows (with seq): the first line and the first lines in input order.

    Only an edge's first lines are put in an array, so one edge may have any number of rows.
    """
    key = ["source", "type", "target"]
    total = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("weight"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("seq", "line_number"))
    lines = rows.where("line_number is not null").select(*key, "seq", "line_number").withColumn("nth", nth).where(F.col("nth") <= first)
    own = lines.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line_number"))), lambda x: x["line_number"]).alias("occurrences"))
    both = total.join(own.select(*[F.col(c).alias(f"own_{c}") for c in key], "occurrences"), [total[c].eqNullSafe(F.col(f"own_{c}")) for c in key], "left")
    occurrences = F.coalesce("occurrences", F.array().cast("array<int>"))
    return both.select(*key, "weight", F.try_element_at("occurrences", F.lit(1)).alias("line_number"), occurrences.alias("occurrences"))


def file_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, type, target, weight, n_edges among files: both ends of a dependency mapped to their file; edges within a file go.

    Nearly every pair of files is one of its own, so edges are dealt by it before anything is summed.
    """
    edges = edges.where(F.col("type").isin(*FILE_DEPENDENCIES))
    file = held(nodes.where(F.col("file_path").isNotNull() & F.col("type").isin(*ARCHITECTURE_NODES)).select("id", "file_path"), "id")
    e = edges.join(file.select(F.col("id").alias("source"), F.col("file_path").alias("s")), "source").join(file.select(F.col("id").alias("target"), F.col("file_path").alias("t")), "target")
    pairs = e.where("s <> t").select(F.col("s").alias("source"), "type", F.col("t").alias("target"), "weight")
    return dealt(pairs, edges.count(), "source", "type", "target").groupBy("source", "type", "target").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1))).alias("weight"), F.count(F.lit(1)).alias("n_edges"))


def visible(nodes: DataFrame, edges: DataFrame, hidden_nodes: tuple[str, ...], hidden_edges: tuple[str, ...], drop_isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of types that aren't hidden. Isolated is a node without any edge before hiding."""
    kept = nodes.where(~F.col("type").isin(*hidden_nodes)) if hidden_nodes else nodes
    if drop_isolated:
        ends = edges.select(F.col("source").alias("id")).unionAll(edges.select(F.col("target").alias("id")))
        kept = kept.join(ends, "id", "left_semi")
    return kept, with_both_ends(edges.where(~F.col("type").isin(*hidden_edges)) if hidden_edges else edges, kept)


def sanitised(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(~F.col("type").isin(*HIDDEN_NODES))
    return kept, with_both_ends(edges, kept)


def strongest_edges(nodes: DataFrame, edges: DataFrame, key: Column | None = None) -> DataFrame:
    """source, target, type: for each unordered pair of nodes that aren't packages the edge of the highest priority, then of the least id.

    An id that follows from source, target and type is handed in as their expression (key): then it is made where a pair's edges
    meet, and no shuffle carries it.
    """
    ids = nodes.where("type <> 'Package'").select("id")
    own = [] if key is not None else ["id"]
    e = with_both_ends(edges.select("source", "target", "type", *own), ids).where("source <> target")
    pair = [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.col("source") < F.col("target")).alias("rising")]
    pairs = dealt(e.select(*pair, "type", *own), edges.count(), "a", "b").withColumns({"source": F.when(F.col("rising"), F.col("a")).otherwise(F.col("b")), "target": F.when(F.col("rising"), F.col("b")).otherwise(F.col("a"))})
    best = F.min_by(F.struct("rising", "type"), F.struct(-ranked(F.col("type"), EDGE_PRIORITY), F.col("id") if key is None else key))
    e = pairs.groupBy("a", "b").agg(best.alias("e"))
    return e.select(F.when(F.col("e.rising"), F.col("a")).otherwise(F.col("b")).alias("source"), F.when(F.col("e.rising"), F.col("b")).otherwise(F.col("a")).alias("target"), "e.type")


def focus(nodes: DataFrame, edges: DataFrame, selected: list[str]) -> DataFrame:
    """id, part: focus for the selected nodes and their neighbours, background for the others."""
    picked = nodes.where(F.col("id").isin(selected)).select("id")
    near = edges.where(F.col("source").isin(selected)).select(F.col("target").alias("id")).unionAll(edges.where(F.col("target").isin(selected)).select(F.col("source").alias("id")))
    hit = picked.unionAll(near).distinct().withColumn("hit", F.lit(True))
    return nodes.select("id").join(hit, "id", "left").select("id", F.when(F.col("hit"), "focus").otherwise("background").alias("part"))


def flow_part(nodes: DataFrame, edges: DataFrame, steps: DataFrame, listed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of a flow (steps has their ids), and the edges among them or those listed by id."""
    kept = nodes.join(steps.select("id"), "id", "left_semi")
    return kept, edges.where(F.col("id").isin(listed)) if listed is not None else with_both_ends(edges, kept)


def overlaid(base: DataFrame, over: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both tables, those of `over` instead of those of base with the same key."""
    return over.unionByName(base.join(over.select(key), key, "left_anti"))


def count_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def facets(rows: DataFrame) -> DataFrame:
    """type, n, position: types by falling count, then by name."""
    n = count_by_type(rows)
    return n.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "type")))  # a row for each type of the vocabulary


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: ends of edges at each node; a loop counts twice."""
    return edges.select(F.col("source").alias("id")).unionAll(edges.select(F.col("target").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def capped(nodes: DataFrame, edges: DataFrame, most_nodes: int = 5000, most_edges: int = 15000) -> tuple[DataFrame, DataFrame]:
    """The nodes of the highest type priority, then degree, then least id, and the edges among them of the least ids.

    Degrees are those of the whole graph. A limit under 1 stands for the default, not for no limit.
    """
    most_nodes, most_edges = most_nodes if most_nodes > 0 else 5000, most_edges if most_edges > 0 else 15000
    d = nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = d.orderBy(F.desc(ranked(F.col("type"), CAP_PRIORITY)), F.desc("degree"), "id").limit(most_nodes)
    return kept, with_both_ends(edges, kept).orderBy("id").limit(most_edges)


def cap_meta(nodes: DataFrame, edges: DataFrame, kept_nodes: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """truncated, total_nodes, total_edges, returned_nodes, returned_edges, reason of what `capped` kept: one row."""
    n = lambda rows, name: F.broadcast(rows.agg(F.count(F.lit(1)).alias(name)))  # noqa: E731 - one row
    out = n(nodes, "total_nodes").crossJoin(n(edges, "total_edges")).crossJoin(n(kept_nodes, "returned_nodes")).crossJoin(n(kept_edges, "returned_edges"))
    truncated = (F.col("returned_nodes") < F.col("total_nodes")) | (F.col("returned_edges") < F.col("total_edges"))
    return out.select(truncated.alias("truncated"), *out.columns, F.when(truncated, "GRAPH_TOO_LARGE").alias("reason"))


def file_slice(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """id, kind: a file's nodes and the edges that touch one; an edge within the file comes twice, once for each end."""
    own = nodes.where(F.col("file_path") == path).select("id")
    out = edges.join(own.withColumnRenamed("id", "source"), "source", "left_semi").select("id")
    back = edges.join(own.withColumnRenamed("id", "target"), "target", "left_semi").select("id")
    return own.withColumn("kind", F.lit("node")).unionAll(out.unionAll(back).withColumn("kind", F.lit("edge")))


def best_of_file(nodes: DataFrame) -> DataFrame:
    """file_path, id: the node that stands for a file: of the highest type priority, then the first line, then the least id."""
    key = F.struct(-ranked(F.col("type"), {k: v for k, v in CAP_PRIORITY.items() if k != "File"}), F.col("line_number"), F.col("id"))
    return nodes.where("file_path is not null").groupBy("file_path").agg(F.min_by("id", key).alias("id"))


def search(nodes: DataFrame, text: str, most: int = 8) -> DataFrame:
    """id, name: nodes whose name contains the text, whatever its case, by full name."""
    return nodes.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("full_name", "id").limit(most).select("id", "name")


def token_search(nodes: DataFrame, text: str, most: int = 50) -> DataFrame:
    """id, full_name, score: nodes by how many of the query's words their name or full name has as words; ties by full name.

    The order is ours: relevance values of a full-text index are not reproduced.
    """
    words = [w for w in dict.fromkeys(text.lower().replace(".", " ").split()) if w]
    own = F.split(F.lower(F.concat_ws(".", "name", "full_name")), r"[^a-z0-9]+")
    score = sum((F.array_contains(own, w).cast("int") for w in words), F.lit(0))
    return nodes.select("id", "full_name", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "full_name", "id").limit(most)


def orphans(nodes: DataFrame, edges: DataFrame, node_type: str) -> DataFrame:
    """Nodes of a type at which no edge ends."""
    ends = edges.select(F.col("source").alias("id")).unionAll(edges.select(F.col("target").alias("id")))
    return nodes.where(F.col("type") == node_type).join(ends, "id", "left_anti")


def class_context(nodes: DataFrame, edges: DataFrame, class_id: str, cap: int = 50) -> DataFrame:
    """kind, id, rank, total: a class's members and relations, distinct, each kind by full name and capped."""
    n = nodes.select("id", "full_name")
    out = edges.where((F.col("source") == class_id) & (F.col("type") != "CONTAINS")).select(F.concat(F.lit("out:"), "type").alias("kind"), F.col("target").alias("id"))
    into = edges.where((F.col("target") == class_id) & (F.col("type") != "CONTAINS")).select(F.concat(F.lit("in:"), "type").alias("kind"), F.col("source").alias("id"))
    w = Window.partitionBy("kind")
    all_ = out.unionAll(into).distinct().join(n, "id").withColumns({"rank": F.row_number().over(w.orderBy("full_name", "id")), "total": F.count(F.lit(1)).over(w)})
    return all_.where(F.col("rank") <= cap).select("kind", "id", "rank", "total")


def truncations(context: DataFrame) -> DataFrame:
    """kind, shown, total of the kinds of a `class_context` of which the cap hides some."""
    g = context.groupBy("kind").agg(F.count(F.lit(1)).alias("shown"), F.max("total").alias("total"))
    return g.where("shown < total")


def method_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and counts by kind of relation of each method that has one: calls, reads, writes, type_links, flow_steps, catches."""
    kind = F.when(F.col("type") == "CALLS", "calls").when(F.col("type") == "READS", "reads").when(F.col("type") == "WRITES", "writes")
    kind = kind.when(F.col("type").isin("RETURNS", "PARAMETER_TYPE", "THROWS", "TYPE_OF"), "type_links").when(F.col("type") == "STEP_IN_FLOW", "flow_steps").when(F.col("type") == "CATCHES", "catches")
    kinds = ["calls", "reads", "writes", "type_links", "flow_steps", "catches"]
    methods = nodes.where("type = 'Method'").select(F.col("id").alias("source"))
    own = edges.withColumn("kind", kind).where("kind is not null").join(methods, "source", "left_semi")
    return own.groupBy(F.col("source").alias("id")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def enclosing_symbol(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """file_path, line, id: the symbol with the tightest span around each line of a file, ties by id; none if no span holds it.

    A sweep over each file's starts and lines in order: spans that have begun lie in a heap, the tightest first, and leave it
    when they are met after their end. So a file takes about linear time however many symbols and lines it has, and
    spans may cross. What is held is one file's open spans.
    """
    import heapq

    import pyarrow as pa

    spans = nodes.where("line_number is not null and type <> 'File' and file_path is not null").select("file_path", F.col("line_number").alias("at"), F.lit(0).alias("kind"), F.coalesce("end_line", "line_number").alias("end"), "id")
    asked = lines.where("file_path is not null and line is not null").select("file_path", F.col("line").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("id")).distinct()
    both = spans.select("file_path", F.col("at").cast("int"), "kind", F.col("end").cast("int"), "id").unionAll(asked.select("file_path", F.col("at").cast("int"), "kind", "end", "id"))

    def swept(batches):
        file, heap = None, []
        for batch in batches:
            out = ([], [], [])
            for path, at, kind, end, id_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != file:
                    file, heap = path, []
                if kind == 0:
                    if end >= at:
                        heapq.heappush(heap, (end - at, id_, end))
                    continue
                while heap and heap[0][2] < at:
                    heapq.heappop(heap)
                if heap:
                    for o, x in zip(out, (path, at, heap[0][1]), strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["file_path", "line", "id"])

    ordered = both.repartition("file_path").sortWithinPartitions("file_path", "at", "kind")
    return ordered.mapInArrow(swept, "file_path string, line int, id string")


def project_metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, n_files: counts of a graph; files by distinct paths that aren't empty. The sides are summed apart."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct(F.nullif("file_path", F.lit(""))).alias("n_files"))
    return n.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("n_edges"))))  # one row


def project_list(projects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, total_files, total_nodes, total_edges of projects (id, name), by name and id; nodes (project, type, file_path) and edges (project).

    Each side is counted before the join. Nodes of the type Project don't count, empty paths are no files, and projects
    without an id are left out.
    """
    path = F.when(F.col("file_path") != "", F.col("file_path"))
    n = nodes.where("type <> 'Project'").groupBy(F.col("project").alias("id")).agg(F.countDistinct(path).alias("total_files"), F.count(F.lit(1)).alias("total_nodes"))
    e = edges.groupBy(F.col("project").alias("id")).agg(F.count(F.lit(1)).alias("total_edges"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_files", "total_nodes", "total_edges")]
    return projects.where("id is not null").join(n, "id", "left").join(e, "id", "left").select("id", "name", *zero).orderBy("name", "id")


#: What is listed around a method, by edge type and direction.
RELATED = {"calls": ("CALLS", "out"), "calledBy": ("CALLS", "in"), "reads": ("READS", "out"), "writes": ("WRITES", "out"), "returnsTypes": ("RETURNS", "out")}


def related_symbols(nodes: DataFrame, edges: DataFrame, method: str, cap: int = 25) -> DataFrame:
    """kind, id, full_name, rank: the symbols around a method, distinct and by full name, name and id, at most `cap` of each kind."""
    rows = None
    for kind, (type_, direction) in RELATED.items():
        here, there = ("source", "target") if direction == "out" else ("target", "source")
        part = edges.where((F.col("type") == type_) & (F.col(here) == method)).select(F.lit(kind).alias("kind"), F.col(there).alias("id"))
        rows = part if rows is None else rows.unionAll(part)
    named = rows.distinct().join(nodes.select("id", "full_name", "name"), "id")
    w = Window.partitionBy("kind").orderBy(F.coalesce("full_name", F.lit("")), F.coalesce("name", F.lit("")), "id")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("kind", "id", "full_name", "rank")
