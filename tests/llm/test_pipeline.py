"""Every stage of the pipeline against plain Python, on what the stage before kept, and run() against the stages."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import rule_ensemble, toxicity
from test_operators import brute_components, brute_statistics, check_packing, words

COLUMNS = corpus_pipeline.COLUMNS
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean, shouted (of low quality) and toxic documents, near copies of clean ones, and odd rows."""
    rng, rows, labels = random.Random(200), [], []
    clean = [words(rng, rng.randint(60, 160), "abcdefghijkl") for _ in range(160)]
    for text in clean:
        rows.append((len(rows), text))
        labels.append((len(labels), 1, 0))
    for _ in range(80):
        rows.append((len(rows), words(rng, 60).upper() + " !!! ###"))
        labels.append((len(labels), 0, 0))
    for _ in range(80):
        text = words(rng, 90, "abcdefghijkl").split()
        for _ in range(5):
            text.insert(rng.randrange(len(text)), rng.choice(["zzqux", "zzquxes", "vokkerl"]))
        rows.append((len(rows), " ".join(text)))
        labels.append((len(labels), 1, 1))
    for text in clean[:40]:
        near = text.split()
        if rng.random() < 0.6:
            near[rng.randrange(len(near))] = "other"
        rows.append((len(rows), " ".join(near)))
    rows += [(None, "nobody knows this text " * 9), (2000, clean[5]), (2000, clean[5])]
    full = [(i, t, None if k % 9 == 0 else "xx", [None, "a", "b"][k % 3], len(t)) for k, (i, t) in enumerate(rows)] + [(3000, None, None, None, None), (3001, "", None, "a", 0)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{at}/documents.parquet")
    marks = [*labels[::2], (None, 1, 1), (3, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), full, marks


def key(r):
    return tuple((x is not None, x) for x in r)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_stages_and_run(spark, corpus):
    at, rows, marks = corpus
    labels = spark.read.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "mixture packing"]

    # Quality: the model's rules over statistics by plain Python.
    model = rule_ensemble.train(docs, labels, "quality", F.col("doc_id").isNotNull())
    names = list(rule_ensemble.statistics(F.col("text")))

    def good(text):
        want = brute_statistics(text)
        x = np.array([[want[n] for n in names]], float)
        total = model.intercept + sum(w for (rule, w) in model.rules if rule_ensemble.holds(x, names, [rule])[0, 0])
        return 1 / (1 + math.exp(-total)) >= corpus_pipeline.QUALITY

    kept = corpus_pipeline.quality(spark, docs, at).cache()
    assert kept.columns == COLUMNS and collected(kept) == sorted((r for r in rows if good(r[1])), key=key)
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & set(range(160, 240)) and set(range(160)) <= ids

    # Toxicity: the same models made of dictionaries.
    trained = toxicity.train(kept, labels, "toxic", F.col("doc_id").isNotNull())
    calibrating = {r.doc_id for r in labels.where("toxic is not null and doc_id is not null").where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(4)) == 0).collect()}
    label = {i: t for i, _, t in marks if i is not None and t is not None and i not in calibrating}
    counts, every = {}, Counter()
    stay = kept.collect()
    for r in stay:
        for w in toxicity.WORD.findall((r.text or "").lower()):
            for g in toxicity.grams(w):
                every[g] += 1
                if r.doc_id in label:
                    o, t = counts.get(g, (0, 0))
                    counts[g] = (o + (label[r.doc_id] == 0), t + (label[r.doc_id] == 1))
    whole = toxicity.KneserNey(counts, every)

    def toxic(text):
        found = [sum(map(whole.gram_ratio, toxicity.grams(w))) for w in toxicity.WORD.findall((text or "").lower())]
        total = sum(min(max(v - 2.5, 0), 12) + 0.1 * max(min(v + 2.5, 0), -12) for v in found)
        mean = min(max(total / (len(found) + 240), 0), 0.1)
        z = trained.intercept + trained.weight * math.log(1 + 100 * mean)
        return 1 / (1 + math.exp(-z)) >= corpus_pipeline.TOXIC

    calm = corpus_pipeline.non_toxic(spark, kept, at).cache()
    assert calm.columns == COLUMNS and collected(calm) == sorted((tuple(r) for r in stay if not toxic(r.text)), key=key)
    ids = {r.doc_id for r in calm.collect()}
    assert set(range(160)) <= ids and len(ids & set(range(240, 320))) <= 2

    # Near duplicates: components by all pairs.
    left = [tuple(r) for r in calm.collect()]
    component = {i: c for i, (_, c) in brute_components([(i, t) for i, t, *_ in left if i is not None], 5, 80).items()}
    single = corpus_pipeline.distinct_documents(spark, calm, at).cache()
    want = sorted((r for r in left if r[0] is None or component[r[0]] == r[0]), key=key)
    assert single.columns == COLUMNS and collected(single) == want and len(want) <= len(left) - 30

    # Packing: every id in one piece, and run() as the stages one after another.
    pieces = corpus_pipeline.packed(spark, single, at).collect()
    check_packing(pieces, [(i, t) for i, t, *_ in want])
    assert sorted(map(str, corpus_pipeline.run(spark, at).collect())) == sorted(map(str, pieces))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
