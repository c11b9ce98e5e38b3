"""Edges and layers that follow from a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.traversal import COMPACT, owner_of, suffix_of
from codeloom.plans.staging import staged


#: Up to so many events pairs are told apart by bits, 63 events a column; and so many listeners of an event are met by one block of its publishers.
BIT_EVENTS, BLOCK = 1024, 2000
#: So many publishers at most meet so many listeners in one cell of all pairs; sides of over 500 are cut into more blocks, up to 8, for the sake of all cores.
CELL = 8000


def triggers(publishers: DataFrame, listeners: DataFrame) -> DataFrame:
    """source, target, event, confidence: publishers (id, event) that trigger listeners (id, event).

    One edge a pair, for the least of the events that they share; nothing triggers itself.
    """
    return _linked(publishers.select("id", "event"), listeners.select("id", "event"))


def _linked(publishers: DataFrame, listeners: DataFrame) -> DataFrame:
    """The edges of `triggers`. What comes out grows with the pairs; what is shuffled and held grows with the members.

    Members carry the set of their events as bits in the order of names. Where members have so many events that pairs would meet
    more than once on average, every publisher meets every listener once. Else a pair is met at each event that it shares, and
    stays at the least one: a publisher has the bits below the event at hand, and a pair without a bit in common is met there for the
    first time. So pairs stream by and none is shuffled. An event's listeners are dealt into blocks, each of which its publishers
    meet, so one event's pairs are made by many tasks. With over BIT_EVENTS events the pairs are grouped instead.
    """
    p = staged(publishers.where("event is not null and id is not null").distinct())
    q = staged(listeners.where("event is not null and id is not null").distinct())
    sizes = q.groupBy("event").agg(F.count(F.lit(1)).alias("n_q")).join(p.groupBy("event").agg(F.count(F.lit(1)).alias("n_p")), "event")
    shared = staged(sizes.select("event", "n_p", "n_q", F.ceil(F.col("n_q") / BLOCK).cast("int").alias("blocks")))
    n_events, meetings = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n_p") * F.col("n_q")), F.lit(0))).first()
    if n_events > BIT_EVENTS:
        pairs = p.select(F.col("id").alias("source"), "event").join(q.select(F.col("id").alias("target"), "event"), "event").where("source <> target")
        return pairs.groupBy("source", "target").agg(F.min("event").alias("event")).withColumn("confidence", F.lit(0.95))

    place = F.row_number().over(Window.orderBy("event")) - 1  # of BIT_EVENTS events at most
    events = F.broadcast(staged(shared.select("event", "blocks", place.alias("place"))))
    words = range((n_events + 62) // 63)
    word, bit = F.floor(F.col("place") / 63), F.expr("shiftleft(1L, place % 63)")

    def bits(members: DataFrame, name: str) -> DataFrame:
        own = members.join(events, "event").groupBy("id")
        return staged(own.agg(*[F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"{name}{k}") for k in words]))

    if not n_events:
        return p.select(F.col("id").alias("source"), F.col("id").alias("target"), "event", F.lit(0.95).alias("confidence")).limit(0)
    of_p, of_q = bits(p, "p"), bits(q, "q")
    if of_p.count() * of_q.count() <= meetings:
        return _all_pairs(of_p, of_q, [r["event"] for r in shared.select("event").orderBy("event").collect()])  # BIT_EVENTS at most

    of_p, of_q = p.join(events, "event").join(of_p, "id"), q.join(events, "event").join(of_q, "id")
    before = [F.when(word > k, F.col(f"p{k}")).when(word == k, F.col(f"p{k}").bitwiseAND(bit - 1)).otherwise(F.lit(0).cast("long")).alias(f"p{k}") for k in words]
    of_p = of_p.select(F.col("id").alias("source"), "event", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *before)
    of_q = of_q.select(F.col("id").alias("target"), F.col("event").alias("e"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("b"), *[f"q{k}" for k in words])
    fresh = F.lit(True)
    for k in words:
        fresh = fresh & (F.col(f"p{k}").bitwiseAND(F.col(f"q{k}")) == 0)
    pairs = of_p.join(of_q, (F.col("event") == F.col("e")) & (F.col("block") == F.col("b")) & (F.col("source") != F.col("target")) & fresh)
    return pairs.select("source", "target", "event", F.lit(0.95).alias("confidence"))


def _all_pairs(of_p: DataFrame, of_q: DataFrame, events: list[str]) -> DataFrame:
    """The edges of members with the bits of their events (id, p0.. and id, q0..): each pair is met once, at its least event in common.

    Both sides are cut into blocks, and each block of publishers meets each of listeners in a cell of its own.
    """
    words = range((len(events) + 62) // 63)
    n_p, n_q = [max(-(-n // CELL), min(-(-n // 500), 8)) for n in (of_p.count(), of_q.count())]
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__block")
    known = lambda name: [F.coalesce(f"{name}{k}", F.lit(0).cast("long")).alias(f"{name}{k}") for k in words]  # noqa: E731 - never null, so that pairs aren't asked
    p = of_p.select("*", every(n_q)).select(F.col("id").alias("source"), (block(n_p) * n_q + F.col("__block")).alias("__p"), *known("p"))
    q = of_q.select("*", every(n_p)).select(F.col("id").alias("target"), (F.col("__block") * n_q + block(n_q)).alias("__q"), *known("q"))
    parts = max(of_p.sparkSession.sparkContext.defaultParallelism, 2 * n_p * n_q)
    met, place = F.lit(False), None
    for k in words:
        common = F.col(f"p{k}").bitwiseAND(F.col(f"q{k}"))
        least = F.bit_count(F.bitwise_not(common).bitwiseAND(common - 1)) + 63 * k
        met, place = met | (common != 0), F.when(common != 0, least) if place is None else place.when(common != 0, least)
    pairs = p.repartition(parts, "__p").join(q.repartition(parts, "__q").hint("shuffle_hash"), (F.col("__p") == F.col("__q")) & (F.col("source") != F.col("target")) & met)
    return pairs.select("source", "target", F.get(F.array(*map(F.lit, events)), place).alias("event"), F.lit(0.95).alias("confidence"))


def event_classes(publishers: DataFrame, listeners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triggers of all events without their pairs: classes (event, n_publishers, n_listeners, n_links), and members (event, id, role).

    Every publisher of an event triggers every listener of it but itself, so n_links is the product less those that do both.
    What comes out grows with the members, also where one event has most of them.
    """
    p = publishers.select("event", "id").distinct().withColumn("role", F.lit("publisher"))
    members = p.unionAll(listeners.select("event", "id").distinct().withColumn("role", F.lit("listener")))
    members = staged(members.where("event is not null and id is not null"))
    both = members.groupBy("event", "id").agg(F.count_if(F.col("role") == "publisher").alias("p"), F.count_if(F.col("role") == "listener").alias("q"))
    g = both.groupBy("event").agg(F.sum("p").alias("n_publishers"), F.sum("q").alias("n_listeners"), F.count_if((F.col("p") > 0) & (F.col("q") > 0)).alias("both"))
    return g.select("event", "n_publishers", "n_listeners", (F.col("n_publishers") * F.col("n_listeners") - F.col("both")).alias("n_links")), members


def triggered_by(members: DataFrame, ids: DataFrame) -> DataFrame:
    """source, target, event, confidence: the edges of `triggers` that begin at given nodes (id), from the members of event_classes."""
    own = members.where("role = 'publisher'").join(ids.select("id").distinct(), "id", "left_semi").select("id", "event")
    return _linked(own, members.where("role = 'listener'").select("id", "event"))


def dispatch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, type, confidence: interface methods and the methods of classes that implement them.

    One candidate is RESOLVES_TO with confidence 1, n of them are DISPATCH_CANDIDATES with 1/n. Only nodes of the type
    Class implement, and only directly.
    """
    m = nodes.where("type = 'Method'").select("id", owner_of(F.col("full_name")).alias("owner"), suffix_of(F.col("full_name")).alias("suffix"))
    interfaces = nodes.where("type = 'Interface'").select(F.col("id").alias("interface"))
    classes = nodes.where("type = 'Class'").select(F.col("id").alias("class"))
    implemented = edges.where("type = 'IMPLEMENTS'").select(F.col("source").alias("class"), F.col("target").alias("interface")).distinct()
    implemented = implemented.join(classes, "class", "left_semi").join(interfaces, "interface", "left_semi")
    declared = m.select(F.col("id").alias("source"), F.col("owner").alias("interface"), "suffix")
    made = m.select(F.col("id").alias("target"), F.col("owner").alias("class"), "suffix")
    found = declared.join(implemented, "interface").join(made, ["class", "suffix"]).select("source", "target").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    return found.withColumn("n", n).select("source", "target", F.when(F.col("n") == 1, "RESOLVES_TO").otherwise("DISPATCH_CANDIDATES").alias("type"), F.round(1 / F.col("n"), 6).alias("confidence"))


def flow_steps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, flow_id: calls below route handlers; the flow is the least handler that reaches the call.

    Only calls between methods and constructors among nodes count. The labels of handlers spread along calls: in each round a node takes the least label that came to it, until none
    changes. A round writes its changes alone. Order within a flow needs a depth-first walk; step_order() gives it for one flow at a time.
    """
    methods = nodes.where(F.col("type").isin("Method", "Constructor")).select("id").distinct()
    call = edges.where("type = 'CALLS'").select("source", "target").distinct()
    for end in ("source", "target"):
        call = call.join(methods.withColumnRenamed("id", end), end, "left_semi")
    call = staged(call.select("source", "target"))
    frontier = known = staged(edges.where("type = 'HANDLES_ROUTE'").select(F.col("source").alias("id"), F.col("source").alias("flow_id")).distinct())
    least, rounds = known, 0
    while True:
        came = frontier.join(call, frontier.id == call.source).groupBy(F.col("target").alias("id")).agg(F.min("flow_id").alias("new"))
        frontier = staged(came.join(least, "id", "left").where(F.col("flow_id").isNull() | (F.col("new") < F.col("flow_id"))).select("id", F.col("new").alias("flow_id")))
        if frontier.isEmpty():
            break
        known, rounds = known.unionByName(frontier), rounds + 1
        least = known.groupBy("id").agg(F.min("flow_id").alias("flow_id"))
        if rounds % COMPACT == 0:
            known = least = staged(least)
    known = least
    return call.join(known, call.source == known.id).select("source", "target", "flow_id")


def step_order(steps: DataFrame) -> DataFrame:
    """source, target, flow_id, step_index of steps (with line_number): depth-first from the handler, by line and target.

    A flow is one group and is walked in one task: flows are bounded by what one route calls.
    """

    def walk(pdf):
        import pandas as pd

        flow = pdf["flow_id"].iloc[0]
        out: dict[str, list[tuple[int, str]]] = {}
        for r in pdf.itertuples():
            out.setdefault(r.source, []).append((r.line_number, r.target))
        rows, seen, stack = [], {flow}, [(flow, iter(sorted(out.get(flow, []))))]
        while stack:
            at, left = stack[-1]
            step = next(left, None)
            if step is None:
                stack.pop()
                continue
            rows.append((at, step[1], flow, len(rows)))
            if step[1] not in seen:
                seen.add(step[1])
                stack.append((step[1], iter(sorted(out.get(step[1], [])))))
        return pd.DataFrame(rows, columns=["source", "target", "flow_id", "step_index"])

    return steps.groupBy("flow_id").applyInPandas(walk, "source string, target string, flow_id string, step_index long")


#: Endings of names by layer, in the order in which they are tried, and the layer of each stereotype.
NAME_LAYERS = (
    ("PRESENTATION", ("Controller", "RestController", "Route")),
    ("SERVICE", ("Service", "ServiceImpl")),
    ("DATA_ACCESS", ("Repository", "RepositoryImpl", "Dao", "DAO", "Mapper", "DBModel")),
    ("DOMAIN", ("Entity", "Dto", "DTO", "Model", "Record", "Enum")),
)
STEREOTYPES = {"CONTROLLER": "PRESENTATION", "SERVICE": "SERVICE", "REPOSITORY": "DATA_ACCESS", "ENTITY": "DOMAIN", "CONFIG": "OTHER", "COMPONENT": "OTHER"}
FILE_ORDER = ("PRESENTATION", "SERVICE", "DATA_ACCESS", "DOMAIN", "OTHER")
TYPES = ("Class", "Interface", "Enum", "Record", "DBModel")


def layer_of_name(name: Column) -> Column:
    """The layer that a type's name tells, by its ending, else OTHER."""
    out = F.lit("OTHER")
    for layer, endings in reversed(NAME_LAYERS):
        out = F.when(name.rlike(f"({'|'.join(endings)})$"), layer).otherwise(out)
    return out


def layers(nodes: DataFrame) -> DataFrame:
    """id, layer of types, methods, constructors, fields, endpoints and files.

    A node's own layer comes first: DBModel is DOMAIN, and a stereotype (a column spring_layer, if there is one) tells others.
    A member takes its owner's layer, where the owner is there; an endpoint without one is PRESENTATION, records and enums
    are DOMAIN, other types go by their names, other members are OTHER. A file takes the first of FILE_ORDER among its types.
    """
    name, kind = F.coalesce("name", F.lit("")), F.col("type")
    stereotype = F.coalesce(*[F.when(F.col("spring_layer") == s, layer) for s, layer in STEREOTYPES.items()]) if "spring_layer" in nodes.columns else F.lit(None).cast("string")
    explicit = F.when(kind == "DBModel", "DOMAIN").otherwise(stereotype)
    by_name = F.when(kind.isin("APIEndpoint", "Route"), "PRESENTATION").when(kind.isin("Record", "Enum"), "DOMAIN").when(kind.isin(*TYPES), layer_of_name(name)).otherwise("OTHER")
    known = nodes.where(kind.isin(*TYPES, "Method", "Constructor", "Field", "APIEndpoint", "Route")).select(
        "id", "full_name", "file_path", "type", explicit.alias("explicit"), by_name.alias("by_name"), F.when(~kind.isin(*TYPES), owner_of(F.col("full_name"))).alias("owner")
    )
    types = known.where(kind.isin(*TYPES)).select("id", "full_name", "file_path", F.coalesce("explicit", "by_name").alias("layer"))
    members = known.where(~kind.isin(*TYPES)).join(types.select(F.col("full_name").alias("owner"), F.col("layer").alias("of_owner")), "owner", "left")
    place = F.array_position(F.array(*[F.lit(x) for x in FILE_ORDER]), F.col("layer"))
    of_file = types.where("file_path is not null").groupBy("file_path").agg(F.min(place).cast("int").alias("place"))
    files = nodes.where("type = 'File'").join(of_file, "file_path", "left").select("id", F.coalesce(F.element_at(F.array(*[F.lit(x) for x in FILE_ORDER]), F.coalesce("place", F.lit(5))), F.lit("OTHER")).alias("layer"))
    return types.select("id", "layer").unionAll(members.select("id", F.coalesce("explicit", "of_owner", "by_name"))).unionAll(files)


def layer_profile(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """layer, type, target_layer, n: how layers depend on layers; the `top` most frequent of each layer, ties by type and target."""
    l = layers(nodes)
    e = edges.join(l.select(F.col("id").alias("source"), "layer"), "source").join(l.select(F.col("id").alias("target"), F.col("layer").alias("target_layer")), "target")
    n = e.groupBy("layer", "type", "target_layer").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("layer").orderBy(F.desc("n"), "type", "target_layer")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def architecture_summary(nodes: DataFrame) -> DataFrame:
    """n_controllers, n_services, n_repositories, n_routes, layered: counts by name's ending, and whether all three layers are there."""
    t = nodes.where(F.col("type").isin("Class", "Interface", "DBModel"))
    c = t.agg(*[F.count_if(F.endswith("name", F.lit(s))).alias(f"n_{p}") for s, p in (("Controller", "controllers"), ("Service", "services"), ("Repository", "repositories"))])
    r = nodes.where("type = 'APIEndpoint'").agg(F.count(F.lit(1)).alias("n_routes"))
    return c.crossJoin(F.broadcast(r)).withColumn("layered", (F.col("n_controllers") > 0) & (F.col("n_services") > 0) & (F.col("n_repositories") > 0))  # one row


def flow_ambiguities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """interface, n_implementations: interfaces that more than one type implements."""
    i = nodes.where("type = 'Interface'").select(F.col("id").alias("target"))
    return edges.where("type = 'IMPLEMENTS'").join(i, "target", "left_semi").groupBy(F.col("target").alias("interface")).agg(F.countDistinct("source").alias("n_implementations")).where("n_implementations > 1")


def shared_includes(uses: DataFrame, infrastructure: str = "(?i)(log|util|config|mapper|cache)") -> DataFrame:
    """service, n_use_cases: services that two or more use cases (use_case, service) share, infrastructure left out by name."""
    return uses.where(~F.col("service").rlike(infrastructure)).groupBy("service").agg(F.countDistinct("use_case").alias("n_use_cases")).where("n_use_cases >= 2")


def subsumed_associations(associations: DataFrame) -> DataFrame:
    """actor, use_case without those of the admin that the user has too."""
    user = associations.where("actor = 'User'").select("use_case")
    return associations.where("actor <> 'Admin'").unionByName(associations.where("actor = 'Admin'").join(user, "use_case", "left_anti"))


def domains(endpoints: DataFrame, manage: float = 0.25) -> DataFrame:
    """domain, endpoint_count, mutating_count, actors, manages of endpoints (domain, method, actor): whether writes are at least the share `manage`."""
    write = F.col("method").isin("POST", "PUT", "PATCH", "DELETE")
    g = endpoints.groupBy("domain").agg(F.count(F.lit(1)).alias("endpoint_count"), F.count_if(write).alias("mutating_count"), F.countDistinct("actor").alias("actors"))
    return g.withColumn("manages", F.col("mutating_count") >= manage * F.col("endpoint_count"))


def merged_use_cases(cases: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Use cases (id, title, confidence) merged by title whatever its case, the surest and then least id surviving; relations (source, target, type) follow, once each, none to itself."""
    key = F.lower(F.trim("title"))
    keep = cases.groupBy(key.alias("key")).agg(F.min_by("id", F.struct(-F.col("confidence"), F.col("id"))).alias("survivor"))
    to = cases.select("id", key.alias("key")).join(keep, "key").select("id", "survivor")
    r = relations.join(to.select(F.col("id").alias("source"), F.col("survivor").alias("s")), "source", "left").join(to.select(F.col("id").alias("target"), F.col("survivor").alias("t")), "target", "left")
    moved = r.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "type").distinct().where("source <> target")
    return cases.join(to.select(F.col("survivor").alias("id")).distinct(), "id", "left_semi"), moved


def evaluation(predicted: DataFrame, expected: DataFrame, key: str = "key") -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of a predicted set against the expected one; empty sets agree."""
    p = predicted.select(key).distinct().withColumn("p", F.lit(1))
    e = expected.select(key).distinct().withColumn("e", F.lit(1))
    n = p.join(e, key, "full").agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(1.0)), 6)
    n = n.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})
    return n.withColumn("f1", F.round(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), 6))
