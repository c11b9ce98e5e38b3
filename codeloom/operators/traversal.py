"""Bounded traversal over an edge table.

Each level joins the frontier with the edges, drops what was seen before and is staged. A frontier of few rows is broadcast,
so a level reads the edges where they lie; a larger one shuffles them once and doesn't pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.staging import held, staged

#: What each impact profile follows, and whether both ways.
PROFILES = {
    "dependency": (("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "INJECTS"), False),
    "structural": (("CONTAINS", "DEFINES", "HAS_METHOD", "HAS_FIELD", "HANDLES_ROUTE"), True),
    "type-data-flow": (("TYPE_OF", "PARAMETER_TYPE", "RETURNS", "READS", "WRITES", "CATCHES", "STEP_IN_FLOW"), True),
}
#: Edges that a reverse walk over symbols follows.
SYMBOL_EDGES = ("CALLS", "STEP_IN_FLOW", "EXTENDS", "IMPLEMENTS", "INJECTS", "IMPORTS")


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """at, next: where one step leads; direction is out, in or both."""
    out = edges.select(F.col("source").alias("at"), F.col("target").alias("next"))
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("next"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction]


#: After so many levels what was seen becomes one table again: neither the plan nor the number of files grows with depth.
COMPACT = 8


def reach(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """id, depth: every node within depth steps of a seed (id), at its least number of steps; seeds at depth 0.

    The edges are read anew at each level: hand in a stored table, not a long plan.
    """
    step = steps(edges, direction)
    seen = staged(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        found = step.join(held(frontier.select("id"), "id"), F.col("at") == F.col("id")).select(F.col("next").alias("id")).distinct()
        frontier = staged(found.join(held(seen.select("id"), "id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        if level < depth and frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
        if level % COMPACT == 0:
            seen = staged(seen)
    return seen


def closure(seeds: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """id: everything reachable from the seeds, themselves included; ends when a level finds nothing new."""
    return reach(seeds, edges, 1 << 20, direction).select("id")


def risk(direct: Column) -> Column:
    """CRITICAL from 50 direct dependents, HIGH from 15, MEDIUM from 5, else LOW."""
    return F.when(direct >= 50, "CRITICAL").when(direct >= 15, "HIGH").when(direct >= 5, "MEDIUM").otherwise("LOW")


def impact(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 3, profile: str = "dependency", cap: int = 50) -> DataFrame:
    """id, depth, rank, bucket, n_at_depth, direct, total, risk of the target's dependents; each bucket shows at most `cap`.

    Dependents at one step will break, at two are likely affected, and those beyond, in one bucket, may need testing.
    The counts are those before the cap. The target itself is no dependent. Ranks follow full_name, then id.
    """
    types, both = PROFILES[profile]
    seeds = nodes.where(F.col("id") == target).select("id")
    found = reach(seeds, edges.where(F.col("type").isin(*types)), depth, "both" if both else "in").where("depth > 0")
    named = staged(found.join(nodes.select("id", "full_name"), "id"))
    bucket = F.when(F.col("depth") == 1, "willBreak").when(F.col("depth") == 2, "likelyAffected").otherwise("mayNeedTesting")
    counts = named.groupBy("depth").agg(F.count(F.lit(1)).alias("n_at_depth"))
    totals = named.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("bucket").orderBy("depth", "full_name", "id")
    ranked = named.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    return ranked.join(F.broadcast(counts), "depth").crossJoin(F.broadcast(totals)).select("id", "depth", "rank", "bucket", "n_at_depth", "direct", "total", risk(F.col("direct")).alias("risk"))  # at most `depth` rows, and one


def node_detail(nodes: DataFrame, edges: DataFrame, center: str, hops: int, direction: str, cap: int = 50) -> DataFrame:
    """id, full_name, edge_type, depth: neighbours within hops; the type is that of the path's first edge.

    Of several shortest paths the least first edge type counts. The centre counts as its own neighbour if a cycle of at most
    `hops` edges leads back to it.
    """
    here, there = ("source", "target") if direction == "out" else ("target", "source")
    step = edges.select(F.col(here).alias("at"), F.col(there).alias("next"), F.col("type").alias("edge_type"))
    seen = staged(step.where(F.col("at") == center).groupBy(F.col("next").alias("id")).agg(F.min("edge_type").alias("edge_type")).withColumn("depth", F.lit(1)))
    frontier = seen
    for level in range(2, hops + 1):
        found = frontier.join(step.select("at", "next"), F.col("id") == F.col("at")).groupBy(F.col("next").alias("id")).agg(F.min("edge_type").alias("edge_type"))
        frontier = staged(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionAll(frontier)
    return seen.join(nodes.select("id", "full_name"), "id").orderBy("full_name", "id").limit(cap).select("id", "full_name", "edge_type", "depth")


def neighbours(edges: DataFrame, center: str, cap: int = 500) -> DataFrame:
    """id, type, direction, source, target: the edges of one node, by neighbour, type and direction."""
    out = edges.where(F.col("source") == center).select(F.col("target").alias("id"), "type", F.lit("OUTGOING").alias("direction"))
    back = edges.where(F.col("target") == center).select(F.col("source").alias("id"), "type", F.lit("INCOMING").alias("direction"))
    top = out.unionAll(back).orderBy("id", "type", "direction").limit(cap)
    outgoing = F.col("direction") == "OUTGOING"
    return top.select("id", "type", "direction", F.when(outgoing, F.lit(center)).otherwise(F.col("id")).alias("source"), F.when(outgoing, F.col("id")).otherwise(F.lit(center)).alias("target"))


def reachable_symbols(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None) -> DataFrame:
    """id, depth: symbols that depend on the seeds, the `most` nearest and then by id, None for all; the seeds count towards `most`."""
    found = reach(seeds, edges.where(F.col("type").isin(*SYMBOL_EDGES)), depth, "in")
    return found if most is None else found.orderBy("depth", "id").limit(most)


def affected_routes(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = 100) -> DataFrame:
    """route, depth: endpoints handled by a symbol that reaches a seed through calls, each at its least depth; the nearest `most`, None for all."""
    found = reach(seeds, edges.where(F.col("type").isin("CALLS", "STEP_IN_FLOW")), depth, "in")
    routes = edges.where("type = 'HANDLES_ROUTE'").select(F.col("source").alias("id"), F.col("target").alias("route"))
    least = found.join(held(routes, "id"), "id").groupBy("route").agg(F.min("depth").alias("depth"))
    return least if most is None else least.orderBy("depth", "route").limit(most)


def owner_of(full_name: Column) -> Column:
    """The part before the last dot, parameters left out: a.B of a.B.m(x.Y)."""
    return F.regexp_extract(F.substring_index(full_name, "(", 1), r"^(.*)\.[^.]*$", 1)


def suffix_of(full_name: Column) -> Column:
    """What follows the owner: m(x.Y) of a.B.m(x.Y)."""
    return F.substring(full_name, F.length(owner_of(full_name)) + 2, 1 << 20)


def override_counterparts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, counterpart, relation: methods of equal name and parameters in direct supertypes and subtypes."""
    m = nodes.where("type = 'Method'").select("id", owner_of(F.col("full_name")).alias("owner"), suffix_of(F.col("full_name")).alias("suffix"))
    other = m.select(F.col("id").alias("counterpart"), F.col("owner").alias("other_owner"), "suffix")
    above = edges.where(F.col("type").isin("IMPLEMENTS", "EXTENDS")).select(F.col("source").alias("owner"), F.col("target").alias("other_owner"), F.lit("super").alias("relation"))
    below = above.select(F.col("other_owner").alias("owner"), F.col("owner").alias("other_owner"), F.lit("sub").alias("relation"))
    return m.join(above.unionAll(below).distinct(), "owner").join(other, ["other_owner", "suffix"]).select("id", "counterpart", "relation")


def references(nodes: DataFrame, edges: DataFrame, center: str, direction: str = "both", types: list[str] | None = None, cap: int = 50) -> DataFrame:
    """other, type, direction, total: references of a symbol, by type, full name and direction; total is their number before the cap."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    into = e.where(F.col("target") == center).select(F.col("source").alias("other"), "type", F.lit("INCOMING").alias("direction"))
    out = e.where(F.col("source") == center).select(F.col("target").alias("other"), "type", F.lit("OUTGOING").alias("direction"))
    found = {"in": into, "out": out, "both": into.unionAll(out)}[direction].join(nodes.select(F.col("id").alias("other")), "other", "left_semi")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("type", "other", "direction").limit(cap).crossJoin(F.broadcast(total))  # one row


def resolve(nodes: DataFrame, query: str, types: list[str] | None = None) -> DataFrame:
    """id, full_name, status: nodes that a name may mean. UNIQUE or AMBIGUOUS; no row if none.

    An equal id or full name beats everything. Otherwise all of these count: equal names, full names that end with the
    query (a dot need not stand before it), and full names without parameters that are the query's or end with it after a dot.
    """
    n = nodes.where(F.col("type").isin(types)) if types else nodes
    exact = (F.col("id") == query) | (F.col("full_name") == query)
    bare, short = F.substring_index("full_name", "(", 1), query.split("(", 1)[0]
    partial = (F.col("name") == query) | F.col("full_name").endswith(query) | bare.endswith("." + short) | (bare == short)
    tier = n.select("id", "full_name", "name", F.when(exact, 0).when(partial, 1).alias("tier")).where("tier is not null")
    best = tier.agg(F.min("tier").alias("best"))
    found = tier.crossJoin(F.broadcast(best)).where("tier = best")  # one row
    count = found.agg(F.count(F.lit(1)).alias("n"))
    return found.crossJoin(F.broadcast(count)).select("id", "full_name", F.when(F.col("n") == 1, "UNIQUE").otherwise("AMBIGUOUS").alias("status"))


def resolution(nodes: DataFrame, query: str, types: list[str] | None = None) -> DataFrame:
    """query, status, n, id: one row on what a name means: UNIQUE with its id, AMBIGUOUS or NOT_FOUND; n counts the candidates."""
    found = resolve(nodes, query, types).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    status = F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("n") == 1, "UNIQUE").otherwise("AMBIGUOUS")
    return found.select(F.lit(query).alias("query"), status.alias("status"), "n", F.when(F.col("n") == 1, F.col("id")).alias("id"))


def trace_endpoint(edges: DataFrame, route: str, depth: int = 10, most: int = 100) -> DataFrame:
    """id, depth, parent, line_number: calls below a route's handler in breadth-first order, siblings by line, then id.

    STEP_IN_FLOW edges are followed, or CALLS where there are none from the handler. A step's parent is the least of
    those at the level before, by its line and id.
    """
    handler = edges.where((F.col("type") == "HANDLES_ROUTE") & (F.col("target") == route)).select(F.col("source").alias("id")).distinct()
    flows = edges.where("type = 'STEP_IN_FLOW'").join(handler, edges.source == handler.id, "left_semi")
    kind = "CALLS" if flows.isEmpty() else "STEP_IN_FLOW"
    step = edges.where(F.col("type") == kind).select(F.col("source").alias("parent"), F.col("target").alias("next"), F.col("line_number").alias("line"))
    seen = staged(handler.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("line_number")))
    frontier = seen
    for level in range(1, depth + 1):
        found = frontier.select(F.col("id").alias("parent")).join(step, "parent").groupBy(F.col("next").alias("id")).agg(F.min(F.struct("line", "parent")).alias("m"))
        frontier = staged(found.join(seen, "id", "left_anti").select("id", F.lit(level).alias("depth"), F.col("m.parent").alias("parent"), F.col("m.line").alias("line_number")))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.orderBy("depth", "line_number", "id").limit(most)
