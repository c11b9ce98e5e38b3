"""Inferred edges after random changes equal those that are worked out anew."""

import random

import pytest

from codeloom.operators import inference, upkeep
from test_graph import graph


def random_graph(rng):
    """Types with methods, and which classes implement which interfaces."""
    types = {f"I{k}": "Interface" for k in range(4) if rng.random() < 0.9} | {f"C{k}": rng.choice(["Class", "Class", "Enum"]) for k in range(8) if rng.random() < 0.9}
    methods = {f"{t}.m{k}()" for t in types for k in range(4) if rng.random() < 0.6}
    implements = {(c, i) for c in types if c[0] == "C" for i in types if i[0] == "I" and rng.random() < 0.4}
    return types, methods, implements


def changed_graph(rng, before):
    """The graph with some types altered, added or gone, and the ids of these."""
    types, methods, implements = (type(x)(x) for x in before)
    after = random_graph(rng)
    touched = set(rng.sample(sorted({*types, *after[0]}), 3))
    keep = lambda t: t not in touched
    new_types = {t: k for t, k in types.items() if keep(t)} | {t: k for t, k in after[0].items() if t in touched}
    new_methods = {m for m in methods if keep(m.split(".")[0])} | {m for m in after[1] if m.split(".")[0] in touched}
    new_implements = {(c, i) for c, i in implements if keep(c)} | {(c, i) for c, i in after[2] if c in touched}
    return (new_types, new_methods, {(c, i) for c, i in new_implements if c in new_types and i in new_types}), touched


def tables(spark, g):
    types, methods, implements = g
    return graph(spark, [*types.items(), *((m, "Method") for m in sorted(methods))] or [("x", "File")], [(c, "IMPLEMENTS", i) for c, i in sorted(implements)] or [("x", "NONE", "x")])


@pytest.mark.parametrize("seed", range(3))
def test_dispatch_after_changes_equals_dispatch_anew(spark, seed):
    rng = random.Random(seed)
    now = random_graph(rng)
    n, e = tables(spark, now)
    known = inference.dispatch(n, e)
    for _ in range(2):
        after, touched = changed_graph(rng, now)
        n2, e2 = tables(spark, after)
        changed = spark.createDataFrame([(t,) for t in sorted(touched)], "id string")
        known = upkeep.staged(upkeep.dispatch_after(known, n2, e, e2, changed))
        want = sorted(map(tuple, inference.dispatch(n2, e2).collect()))
        assert sorted(map(tuple, known.collect())) == want
        now, e = after, e2


def test_event_classes_after_changes_equal_those_anew(spark):
    rng = random.Random(7)
    schema = "event string, id long, role string"
    rows = {(rng.choice("abcd"), rng.randint(1, 20), rng.choice(["publisher", "listener"])) for _ in range(80)}
    removed = set(rng.sample(sorted(rows), 12)) | {("zz", 1, "listener")}
    added = {(rng.choice("de"), rng.randint(1, 30), rng.choice(["publisher", "listener"])) for _ in range(20)}

    def classes(rows):
        f = spark.createDataFrame(sorted(rows), schema)
        return inference.event_classes(f.where("role = 'publisher'"), f.where("role = 'listener'"))

    before, members = classes(rows)
    got, now = upkeep.event_classes_after(before, members, spark.createDataFrame(sorted(removed), schema), spark.createDataFrame(sorted(added), schema))
    want, _ = classes((rows - removed) | added)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {tuple(r) for r in now.select("event", "id", "role").collect()} == (rows - removed) | added
