"""Data flows from endpoints to the database, and closures of a use-case model.

Where flows lead is worked out once for all nodes, backwards from what they look for: each node gets its distance, the
nearest target and the next node on the way. A flow then follows these pointers, one row a level, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scalars import humanised
from codeloom.operators.traversal import COMPACT, closure, owner_of
from codeloom.plans.staging import FEW, dealt, held, staged

#: Edges of calls, edges between a method and what implements it (both ways), edges to the model.
CALL_EDGES, RESOLVE_EDGES, MODEL_EDGES = ("CALLS",), ("IMPLEMENTS", "OVERRIDES"), ("RETURNS", "READS", "WRITES", "PARAMETER_TYPE")
MAX_STEPS = 200


def endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """flow, id, method, path: routes with the methods that handle them; the name of a route without a verb is its path."""
    methods = held(nodes.where(F.col("type").isin("Method", "Constructor")).select(F.col("id").alias("handler")), "handler")
    handled = edges.where("type = 'HANDLES_ROUTE'").select(F.col("source").alias("handler"), F.col("target").alias("route")).join(methods, "handler", "left_semi")
    named = handled.groupBy("route").agg(F.max("handler").alias("id")).join(nodes.select(F.col("id").alias("route"), "full_name"), "route")
    verb = F.regexp_extract("full_name", r"^([A-Za-z]+)\s", 1)
    return named.select(F.col("route").alias("flow"), "id", F.upper(verb).alias("method"), F.trim(F.substring("full_name", F.length(verb) + 1, 1 << 20)).alias("path"))


def call_roots(nodes: DataFrame, edges: DataFrame, layers: tuple[str, ...] = ("Controller", "Service", "Component")) -> DataFrame:
    """flow, id of methods that call and that nothing calls, of types whose names end as a layer's do."""
    calls = edges.where("type = 'CALLS'")
    types = nodes.where(F.col("name").rlike(f"({'|'.join(layers)})$")).select(F.col("full_name").alias("owner"))
    m = nodes.where("type = 'Method'").select("id", owner_of(F.col("full_name")).alias("owner")).join(types, "owner", "left_semi")
    roots = m.join(calls.select(F.col("source").alias("id")), "id", "left_semi").join(calls.select(F.col("target").alias("id")), "id", "left_anti")
    return roots.select(F.col("id").alias("flow"), "id")


def is_repository(nodes: DataFrame) -> DataFrame:
    """id of methods of types whose names end in Repository."""
    types = nodes.where(F.endswith("name", F.lit("Repository"))).select(F.col("full_name").alias("owner"))
    return nodes.where("type = 'Method'").select("id", owner_of(F.col("full_name")).alias("owner")).join(types, "owner", "left_semi").select("id")


def flow_edges(edges: DataFrame) -> DataFrame:
    """parent, next, type: the steps that a flow may take, edges between a method and what implements it in both ways. A step may come twice."""
    out = edges.where(F.col("type").isin(*CALL_EDGES, *RESOLVE_EDGES, *MODEL_EDGES)).select(F.col("source").alias("parent"), F.col("target").alias("next"), "type")
    back = edges.where(F.col("type").isin(*RESOLVE_EDGES)).select(F.col("target").alias("parent"), F.col("source").alias("next"), "type")
    return out.unionAll(back)


def nearest(step: DataFrame, targets: DataFrame, depth: int = MAX_STEPS) -> DataFrame:
    """id, distance, target, type, next: the nearest of targets (id) for every node that reaches one within depth steps.

    Of several at one distance the least counts, and of several ways to it the one with the least edge type and next node. One
    row a node; a round of joins with the steps (parent, next, type) for each distance. Steps stream by the nodes of a distance, and
    those found are dealt by parent, in as many parts as all steps ask for.
    """
    n = step.count()
    null = F.lit(None).cast("string")
    frontier = known = staged(targets.select("id").distinct().select("id", F.lit(0).alias("distance"), F.col("id").alias("target"), null.alias("type"), null.alias("next")))
    for level in range(1, depth + 1):
        way = F.min(F.struct("target", "type", "next")).alias("w")
        found = dealt(step.join(held(frontier.select(F.col("id").alias("next"), "target"), "next", n), "next").withColumnRenamed("parent", "id"), n, "id")
        came = found.groupBy("id").agg(way).join(held(known.select("id"), "id", n), "id", "left_anti")
        frontier = staged(came.select("id", F.lit(level).alias("distance"), "w.target", "w.type", "w.next"))
        if frontier.isEmpty():
            break
        known = known.unionAll(frontier)
        if level % COMPACT == 0:
            known = staged(known)
    return staged(known)


def _first(starts: DataFrame, step: DataFrame, labels: DataFrame) -> DataFrame:
    """flow, id, target, type, next, own: the first step of starts (flow, id) to their nearest target; own says that it may be the start itself."""
    n_starts, n = starts.count(), step.count()
    own, step = starts.select("flow", "id"), step.withColumnRenamed("parent", "id")
    own, step = (F.broadcast(own), step) if n_starts <= FEW else (dealt(own, n, "id"), dealt(step, n, "id"))
    at = held(labels.select(F.col("id").alias("next"), "distance", "target"), "next", n)
    each = dealt(own.join(step, "id").join(at, "next").where("next <> id"), max(n, n_starts), "flow", "id")
    best = each.groupBy("flow", "id").agg(F.min(F.struct("distance", "target", "type", "next")).alias("w"), F.bool_or(F.col("target") == F.col("id")).alias("own"))
    return best.select("flow", "id", "w.target", "w.type", "w.next", "own")


def _followed(first: DataFrame, labels: DataFrame) -> DataFrame:
    """flow, step, id, edge_type: the steps after the first, along the labels' pointers."""
    pointers = held(labels.where("next is not null").select("id", F.col("type").alias("t"), F.col("next").alias("n")), "id", first.count())
    at = staged(first.select("flow", F.lit(2).alias("step"), F.col("next").alias("id"), F.col("type").alias("edge_type")))
    path, rounds = at, 0
    while True:
        at = staged(at.join(pointers, "id").select("flow", (F.col("step") + 1).alias("step"), F.col("n").alias("id"), F.col("t").alias("edge_type")))
        if at.isEmpty():
            return path
        path, rounds = path.unionAll(at), rounds + 1
        if rounds % COMPACT == 0:
            path = staged(path)


def data_flows(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = MAX_STEPS) -> DataFrame:
    """flow, step, id, edge_type, complete of starts (flow, id): the path to the nearest DBModel.

    Without one within depth steps the path goes to the nearest method of a repository, else to the farthest node, and isn't
    complete. Of several targets at one distance the least id counts, and of several ways the one whose next step has the
    least edge type and id. Starts are methods; only those that reach neither kind are walked node by node.
    """
    step = staged(flow_edges(edges))
    models = nearest(step, nodes.where("type = 'DBModel'").select("id"), depth)
    stores = nearest(step, is_repository(nodes), depth)
    to_model = staged(_first(starts, step, models))
    rest = starts.select("flow", "id").join(to_model.select("flow"), "flow", "left_anti")
    to_store = staged(_first(rest, step, stores))
    rest = staged(rest.join(to_store.where("not own").select("flow"), "flow", "left_anti"))
    head = lambda rows: rows.select("flow", F.lit(1).alias("step"), "id", F.lit(None).cast("string").alias("edge_type"))
    found = head(to_model).unionAll(_followed(to_model, models)).withColumn("complete", F.lit(True))
    stored = to_store.where("not own")
    found = found.unionAll(head(stored).unionAll(_followed(stored, stores)).withColumn("complete", F.lit(False)))
    return found if rest.isEmpty() else found.unionAll(_walked(nodes, step, rest, depth))


def _walked(nodes: DataFrame, step: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """The same for starts that reach no model: each flow's nodes a level a round, then back from the nearest store or the farthest node."""
    kind = staged(is_repository(nodes).withColumn("tier", F.lit(1)))
    null = F.lit(None).cast("string")
    seen = staged(starts.select("flow", "id", F.lit(0).alias("depth"), null.alias("parent"), null.alias("edge_type")))
    frontier = seen.select("flow", F.col("id").alias("parent"))
    for level in range(1, depth + 1):
        found = frontier.join(step, "parent").groupBy("flow", F.col("next").alias("id")).agg(F.min(F.struct("type", "parent")).alias("m"))
        found = found.join(seen, ["flow", "id"], "left_anti")
        new = staged(found.select("flow", "id", F.lit(level).alias("depth"), F.col("m.parent").alias("parent"), F.col("m.type").alias("edge_type")))
        if new.isEmpty():
            break
        seen = seen.unionAll(new)
        if level % COMPACT == 0:
            seen = staged(seen)
        frontier = new.select("flow", F.col("id").alias("parent"))
    seen = staged(seen)
    tiers = seen.where("depth > 0").join(kind, "id", "left").withColumn("tier", F.coalesce("tier", F.lit(2)))
    order = F.struct("tier", F.when(F.col("tier") < 2, F.col("depth")).otherwise(-F.col("depth")), "id")
    last = tiers.groupBy("flow").agg(F.min(order).alias("o")).select("flow", F.col("o.id").alias("id"))
    alone = starts.select("flow", "id").join(last, "flow", "left_anti")
    at = staged(last.unionByName(alone).join(seen, ["flow", "id"]))
    path = at
    while not at.isEmpty():
        at = staged(at.where("parent is not null").select("flow", F.col("parent").alias("id")).join(seen, ["flow", "id"]))
        path = path.unionByName(at)
    return path.select("flow", (F.col("depth") + 1).alias("step"), "id", "edge_type", F.lit(False).alias("complete"))


def flow_list(nodes: DataFrame, edges: DataFrame, limit: int = 80) -> DataFrame:
    """kind, flow, title, description, n_steps, n_files, domain, complete: flows of endpoints, then of call roots with two steps or more, by title.

    The description names the first and the last step.
    """
    e = endpoints(nodes, edges)
    roots = call_roots(nodes, edges).join(e.select("id"), "id", "left_anti")
    starts = e.select("flow", "id", F.lit("endpoint").alias("kind"), F.concat_ws(" ", "method", "path").alias("title")).unionByName(roots.select("flow", "id", F.lit("method").alias("kind"), humanised(F.regexp_extract("id", r"([^.]*)\(", 1)).alias("title")))
    starts = staged(starts)
    steps = data_flows(nodes, edges, starts).join(nodes.select("id", "name", "file_path", "package_name"), "id", "left")
    g = steps.groupBy("flow").agg(F.count(F.lit(1)).alias("n_steps"), F.countDistinct("file_path").alias("n_files"), F.min_by("package_name", "step").alias("domain"), F.min("complete").alias("complete"), F.min_by("name", "step").alias("begin"), F.max_by("name", "step").alias("end"))
    g = g.withColumn("description", F.when(F.col("n_steps") > 1, F.concat_ws(" to ", "begin", "end")).otherwise(F.col("begin")))
    listed = starts.join(g, "flow").where("kind = 'endpoint' or n_steps >= 2")
    return listed.orderBy("kind", F.lower("title"), "flow").limit(limit).select("kind", "flow", "title", "description", "n_steps", "n_files", "domain", "complete")


def use_case_view(relations: DataFrame, actor: str) -> DataFrame:
    """id of an actor's use cases: associated with it or with an actor that it generalises to, and all that these include or extend."""
    up = closure(relations.sparkSession.createDataFrame([(actor,)], "id string"), relations.where("type = 'generalization'"))
    own = relations.where("type = 'association'").join(up, relations.source == up.id, "left_semi").select(F.col("target").alias("id"))
    return closure(own, relations.where(F.col("type").isin("include", "extend")))


def path_title(path: Column) -> Column:
    """A route's path as words, its variables left out."""
    return humanised(F.trim(F.regexp_replace(F.regexp_replace(path, r"\{[^}]*\}", " "), r"[/.]+", " ")))
