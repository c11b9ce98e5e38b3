"""Language identification by nearest centroid.

Character n-grams (one to three bytes of the lower-cased words, other signs being blanks) are hashed to buckets; counts become
normalised TF-IDF vectors. Each language has several centroids, found by spherical k-means on a bounded sample, and a text takes the
language of the centroid with the largest cosine. A text farther from every centroid of a language than nearly all
of that language's own sample is rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import kept, map_rows

DIM = 4096
LETTER = r"\p{L}"
WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> np.ndarray:
    """Counts of hashed n-grams of one, two and three bytes of the words, with a space before and after each."""
    v = np.frombuffer(b" " + " ".join(WORD.findall(text.lower())).encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    out = np.bincount(v, minlength=DIM)
    two = v[:-1] * np.uint32(257) + v[1:]
    out += np.bincount((two * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=DIM)
    three = two[:-1] * np.uint32(0x85EBCA77) + v[2:] * np.uint32(0xC2B2AE3D)
    three ^= three >> np.uint32(15)
    out += np.bincount((three * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=DIM)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row for each centroid
    owner: np.ndarray  # the language of each centroid
    farthest: np.ndarray  # of each language, the least cosine that is not rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the language, a score from 0 to 1 (the cosine's share over the languages) and whether it is rejected."""
        cos = self.vectors(counts) @ self.centroids.T
        best = np.stack([cos[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        k = best.argmax(axis=1)
        top = best[np.arange(len(best)), k]
        e = np.exp(20 * (best - top[:, None]))
        return k, 1 / e.sum(axis=1), top < self.farthest[k]


def k_means(x: np.ndarray, k: int, rounds: int = 15, odd: float = 0.05) -> np.ndarray:
    """Centroids by cosine, from a start that takes the farthest row each time; equal input gives equal centroids.

    The share `odd` of the rows that is farthest from their mean takes no part, so that no centroid stands for junk.
    """
    mean = x.mean(axis=0)
    near = x @ (mean / max(np.linalg.norm(mean), 1e-9))
    x = x[near >= np.quantile(near, odd)]
    near = near[near >= np.quantile(near, odd)]
    start = [int(near.argmax())]
    for _ in range(1, min(k, len(x))):
        start.append(int((x @ x[start].T).max(axis=1).argmin()))
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(rows: pd.DataFrame, centroids: int = 4, tail: float = 0.002) -> Model:
    """rows: lang, counts (bytes of DIM 32-bit counts). tail: the share of a language's sample beyond its limit."""
    counts = np.stack([np.frombuffer(b, np.int32) for b in rows["counts"]]) if len(rows) else np.zeros((0, DIM), np.int32)
    languages = sorted(rows["lang"].unique())
    model = Model(languages, np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1, np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0))
    x = model.vectors(counts)
    parts = [k_means(x[(rows["lang"] == lang).to_numpy()], centroids) for lang in languages]
    if parts:
        model.centroids, model.owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        model.farthest = np.array([np.quantile((x[(rows["lang"] == lang).to_numpy()] @ p.T).max(axis=1), tail) for lang, p in zip(languages, parts, strict=True)])
    return model


def train(docs: DataFrame, learn: Column, per_language: int = 400, centroids: int = 4) -> Model:
    """A model from at most per_language rows of each language: those for which learn holds, in the order of a hash of doc_id.

    What comes to the driver is one vector of DIM counts for each sampled row. Rows with a null text or lang teach nothing.
    A language's ids with a letter are counted first, and only the share of them that should hold three times its sample is put in
    order, so no task orders a whole language. A model's languages are few enough for the driver, which holds it.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("doc_id", "lang", "text")
    known = usable.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id")).alias("ids"))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    some = usable.select("doc_id", "lang", F.length("text").alias("length")).join(F.broadcast(known), "lang").where(at * F.col("ids") <= 3 * per_language)
    w = Window.partitionBy("lang").orderBy(at, "doc_id", "length")
    ids = some.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language).select("doc_id", "lang").distinct()
    sample = usable.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")  # at most per_language ids of each language

    def rows(columns):
        yield [columns[0], columns[1], [features(t).astype(np.int32).tobytes() for t in columns[2]]]

    made = map_rows(sample, rows, "doc_id long, lang string, counts binary")
    # Ids may repeat, so the rows are bounded too.
    each = Window.partitionBy("lang").orderBy("doc_id", "counts")
    got = made.withColumn("n", F.row_number().over(each)).where(F.col("n") <= per_language).drop("n").toPandas().sort_values(["lang", "doc_id", "counts"])
    return fit(got.reset_index(drop=True), centroids)


def identify(docs: DataFrame, model: Model, keep: list[str], reject: bool = True) -> DataFrame:
    """The columns in keep, lang_pred, score and rejected of each row's whole text.

    A null text and one without a letter get `und` and score 0, as does every text if the model knows no language.
    With reject, so do texts that are too far from every centroid; without, these get the nearest language and
    rejected says so. Of keep, a column with the name of one that is made here is left out.
    """
    spark, keep = docs.sparkSession, kept(keep, ["lang_pred", "score", "rejected"])
    sent = spark.sparkContext.broadcast(model)
    schema = spark.createDataFrame([], docs.select(*keep).schema).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", lang_pred string, score double, rejected boolean"

    def rows(columns):
        m, texts = sent.value, columns[-2]
        n = len(texts)
        pred, score, out = ["und"] * n, [0.0] * n, [False] * n
        at = [i for i in range(n) if columns[-1][i]] if m.languages else []
        if at:
            k, s, far = m.nearest(np.stack([features(texts[i]) for i in at]))
            for j, i in enumerate(at):
                out[i] = bool(far[j])
                if not (reject and far[j]):
                    pred[i], score[i] = m.languages[k[j]], float(s[j])
        yield [*columns[:-2], pred, score, out]

    return map_rows(docs.select(*keep, F.col("text").alias("__text"), F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("letters")), rows, ddl, rows=256)
