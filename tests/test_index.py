"""Ranked search, enclosing spans and event classes against plain Python."""

import math
import random
import re
from collections import Counter

from codeloom.operators import inference, shaping, text_index


def brute_scores(texts, terms):
    counts = {i: Counter(t for t in re.split("[^a-z0-9]+", (x or "").lower()) if t) for i, x in texts.items()}
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for i, c in counts.items():
        score = sum(math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in terms if c[t])
        if any(c[t] for t in terms):
            out[i] = round(score, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(text_index, "PER_TASK", 20)
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "al", "alps", "x1", "delta"]
    texts = {i: " ".join(rng.choices(vocabulary, [30, 9, 5, 3, 3, 2, 1], k=rng.randint(0, 20))) for i in range(200)} | {900: None, 901: "", 902: "ALPHA! beta-gamma é"}
    frame = spark.createDataFrame([*texts.items(), (None, "alpha")], "id long, text string")
    index = text_index.build(frame)
    for query, terms in (("beta GAMMA beta", ["beta", "gamma"]), ("alpha", ["alpha"]), ("nothing", ["nothing"]), ("x1 delta alps", ["x1", "delta", "alps"])):
        got = [(r.id, r.score) for r in index.search(query, 300).orderBy("rank").collect()]
        want = brute_scores(texts, terms)
        assert dict(got) == {i: s for i, s in want} and [s for _, s in got] == [s for _, s in want], query
    assert dict((r.id, r.score) for r in index.starting("AL", 300).collect()) == dict(brute_scores(texts, ["alpha", "al", "alps"]))
    assert index.search(" ,;").count() == 0 and index.starting("").count() == 0 and len(index.search("alpha", 7).collect()) == 7
    plan = index.search("delta")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "PartitionFilters: [" in plan
    assert text_index.build(frame.limit(0)).search("alpha").count() == 0
    twice = text_index.build(spark.createDataFrame([(1, "a b"), (1, "b"), (2, "c")], "id long, text string"))
    assert {r.id: r.tf for r in twice.postings.where("term = 'b'").collect()} == {1: 2}


def test_tightest_spans_equal_brute_force(spark):
    rng = random.Random(4)
    spans = [(f"s{k}", rng.choice(["Method", "Class", "File"]), rng.choice(["/a", "/b", None]), s := rng.choice([None, *range(40)]), None if s is None or rng.random() < 0.2 else s + rng.randint(-2, 15)) for k in range(120)]
    nodes = spark.createDataFrame(spans, "id string, type string, file_path string, line_number int, end_line int")
    lines = spark.createDataFrame([(f, k) for f in ("/a", "/b", "/c", None) for k in (*range(60), 7)], "file_path string, line int")
    got = {(r.file_path, r.line): r.id for r in shaping.enclosing_symbol(nodes, lines).collect()}
    want = {}
    for f in ("/a", "/b"):
        for k in range(60):
            around = [((s if e is None else e) - s, i) for i, t, p, s, e in spans if p == f and t != "File" and s is not None and s <= k <= (s if e is None else e)]
            if around:
                want[f, k] = min(around)[1]
    assert got == want and shaping.enclosing_symbol(nodes, lines.limit(0)).count() == 0


def test_a_file_of_many_symbols_takes_linear_time(spark):
    import time

    n = 100_000
    nodes = spark.range(n).selectExpr("concat('s', id) id", "'Method' type", "'/big' file_path", "cast(id as int) line_number", f"cast(least(id + 1 + (id * 7919) % 1000, {n}) as int) end_line")
    began = time.time()
    got = shaping.enclosing_symbol(nodes, spark.range(n).selectExpr("'/big' file_path", "cast(id as int) line"))
    assert got.count() == n and time.time() - began < 60


def test_event_classes_stand_for_all_triggers(spark):
    rng = random.Random(5)
    p = spark.createDataFrame([(rng.randint(1, 30), rng.choice(["a", "b", "c", None])) for _ in range(200)], "id long, event string")
    q = spark.createDataFrame([(rng.randint(20, 60), rng.choice(["a", "a", "d", None])) for _ in range(200)], "id long, event string")
    classes, members = inference.event_classes(p, q)
    pairs = {}
    for source in {(r.id, r.event) for r in p.collect() if r.event}:
        for target in {(r.id, r.event) for r in q.collect() if r.event}:
            if source[1] == target[1] and source[0] != target[0]:
                pairs.setdefault(source[1], set()).add((source[0], target[0]))
    assert {r.event: r.n_links for r in classes.collect() if r.n_links} == {e: len(x) for e, x in pairs.items()}
    ids = spark.createDataFrame([(k,) for k in range(20, 26)], "id long")
    want = sorted((r.source, r.target, r.event) for r in inference.triggers(p, q).collect() if 20 <= r.source < 26)
    assert sorted((r.source, r.target, r.event) for r in inference.triggered_by(members, ids).collect()) == want
    hot = spark.range(20_000).selectExpr("id", "'hot' event")
    assert inference.event_classes(hot, hot)[0].first().n_links == 20_000 * 19_999
