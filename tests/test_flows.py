"""Data flows against a plain walk over random graphs."""

import random

import pytest

from codeloom.operators import flows
from codeloom.plans import staging
from test_graph import graph


def brute_flow(nodes, edges, start):
    """(distance to the nearest model, whether there is one, the target) by breadth-first search; a store, then the farthest node, without."""
    step = {}
    for s, t, d in edges:
        if t in ("CALLS", "READS", "WRITES", "OVERRIDES"):
            step.setdefault(s, set()).add(d)
        if t == "OVERRIDES":
            step.setdefault(d, set()).add(s)
    depth, level = {start: 0}, [start]
    while level:
        following = sorted({y for x in level for y in step.get(x, ())} - set(depth))
        depth |= {y: depth[level[0]] + 1 for y in following}
        level = following
    far = {x: d for x, d in depth.items() if d}
    models = [(d, x) for x, d in far.items() if nodes[x] == "DBModel"]
    if models:
        return (*min(models), True)
    stores = [(d, x) for x, d in far.items() if x.startswith("ARepository.")]
    if stores:
        return (*min(stores), False)
    return (*min(((-d, x) for x, d in far.items()), default=(0, start)), False)


@pytest.mark.parametrize("seed", range(4))
def test_flows_end_where_a_plain_walk_says(spark, seed):
    rng = random.Random(seed)
    methods = [f"{o}.m{k}()" for o in ("AService", "ARepository", "B") for k in range(9)]
    models = [f"M{k}" for k in range(3)]
    types = {m: "Method" for m in methods} | {m: "DBModel" for m in models} | {"AService": "Class", "ARepository": "Class", "B": "Class"}
    edges = {(rng.choice(methods), rng.choice(["CALLS", "CALLS", "OVERRIDES"]), rng.choice(methods)) for _ in range(22)}
    edges |= {(rng.choice(methods), rng.choice(["READS", "WRITES"]), rng.choice(models)) for _ in range(seed * 2)}
    n, e = graph(spark, list(types.items()), sorted(edges))
    starts = spark.createDataFrame([(f"flow of {m}", m) for m in methods], "flow string, id string")
    rows = {}
    for r in flows.data_flows(n, e, starts).collect():
        rows.setdefault(r.flow, []).append(r)
    both = edges | {(d, t, s) for s, t, d in edges if t == "OVERRIDES"}
    for m in methods:
        path = sorted(rows[f"flow of {m}"], key=lambda r: r.step)
        distance, target, complete = brute_flow(types, edges, m)
        assert [r.step for r in path] == list(range(1, abs(distance) + 2)) and (path[0].id, path[0].edge_type) == (m, None)
        assert (path[-1].id, path[-1].complete) == (target, complete)
        assert all((a.id, b.edge_type, b.id) in both for a, b in zip(path, path[1:], strict=False))


def test_labels_of_a_long_chain_are_one_row_a_node(spark):
    n = 30
    step = spark.createDataFrame([(f"k{k:03}", f"k{k + 1:03}", "CALLS") for k in range(n)], "parent string, next string, type string")
    got = {r.id: (r.distance, r.target, r.next) for r in flows.nearest(step, spark.createDataFrame([(f"k{n:03}",)], "id string")).collect()}
    assert got == {f"k{k:03}": (n - k, f"k{n:03}", f"k{k + 1:03}" if k < n else None) for k in range(n + 1)}
    assert flows.nearest(step, spark.createDataFrame([], "id string")).count() == 0


def test_flows_are_dealt_by_the_number_of_steps(spark, monkeypatch):
    rng = random.Random(7)
    methods = [f"{o}.m{k}()" for o in ("AService", "ARepository", "B") for k in range(9)]
    types = {m: "Method" for m in methods} | {f"M{k}": "DBModel" for k in range(3)} | {"AService": "Class", "ARepository": "Class", "B": "Class"}
    edges = {(rng.choice(methods), rng.choice(["CALLS", "OVERRIDES"]), rng.choice(methods)) for _ in range(40)} | {(methods[k], "READS", f"M{k}") for k in range(3)}
    n, e = graph(spark, list(types.items()), sorted(edges))
    starts = n.where("type = 'Method'").selectExpr("id as flow", "id")
    step, models = flows.flow_edges(e).localCheckpoint(), n.where("type = 'DBModel'").select("id")
    labels = flows.nearest(step, models)
    plain, first = set(labels.collect()), set(flows._first(starts, step, labels).collect())
    monkeypatch.setattr(staging, "PER_TASK", 5)
    for module in (staging, flows):
        monkeypatch.setattr(module, "FEW", 0)
    assert set(flows.nearest(step, models).collect()) == plain
    dealt = flows._first(starts, step, labels)
    assert dealt.rdd.getNumPartitions() == -(-step.count() // 5) and set(dealt.collect()) == first
