"""Toxicity by class-conditional Kneser-Ney models.

Two models of the characters of a word, one of toxic and one of ordinary documents, share the counts that they back off to,
so an expression that neither class has seen often gets the same likelihood from both. A document is judged by one mean
over its words of the difference of the two log-likelihoods, taken from both sides beyond a margin: words that the toxic
model explains better speak for it, words that the ordinary one explains better against it. The mean has a number of
neutral words of its own, so that a word or two of a short text weigh no more than they should, and a logistic map that
rises with the mean makes it a probability. So one more toxic word never lowers a score, however many there are, and one
more ordinary word never raises it.

All documents are counted on Spark, and all labelled ones by class. Where neither class has an n-gram, the shared
probability cancels out of the ratio, which then depends on the context alone. So the ratios of the other n-grams and of
their contexts are the whole model: few enough to be broadcast, or else a table to join with.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import kept, map_rows, materialise
from codeloom.llm.rule_ensemble import lasso_logistic

ORDER = 4
#: A word's log-likelihood ratio counts by what it exceeds this on either side, so that common words of long texts do not add up,
#: and by no more than CAP. The ordinary class is many times larger and knows far more words, so its side counts by a part.
MARGIN, CAP, ORDINARY = 2.5, 12.0, 0.1
#: The neutral words that every text has beside its own, and the mean from which on a text is as toxic as can be.
NEUTRAL, MOST_MEAN = 240, 0.1
WORD = re.compile(r"[^\W\d_]+")
#: Runs of letters over twice as many are no words; they are scored in slices of so many n-grams.
LONGEST = 40
#: What a class discounts of an n-gram's count, and what the shared model does: Kneser-Ney discounts, under 1.
OWN, DISCOUNT = 0.95, 0.75
#: What is measured of a text: the mean of its words' ratios towards toxic, of those towards ordinary (0 or less), and both together, from 0 to MOST_MEAN.
FEATURES = ("toxic_side", "ordinary_side", "mean")
#: Labels are broadcast up to this many, ratios up to that many; beyond it the same joins shuffle.
MOST_LABELS, MOST_RATIOS = 1_000_000, 300_000
#: Distinct words that a task counts before it hands on their n-grams.
MOST_WORDS = 300_000


def words_of(text: str) -> tuple[list[str], list[str]]:
    """The words of a text; and the slices of its longer runs, which overlap so that each n-gram lies in one slice."""
    words = WORD.findall(text.lower())
    if not words or max(map(len, words)) <= 2 * LONGEST:
        return words, []
    runs = [padded(w) for w in words if len(w) > 2 * LONGEST]
    slices = [r[k : k + LONGEST + ORDER - 1] for r in runs for k in range(0, len(r) - ORDER + 1, LONGEST)]
    return [w for w in words if len(w) <= 2 * LONGEST], slices


def padded(word: str) -> str:
    return "^" * (ORDER - 1) + word + "$"


def windows(text: str) -> list[str]:
    return [text[k : k + ORDER] for k in range(len(text) - ORDER + 1)]


def grams(word: str) -> list[str]:
    """The n-grams of ORDER characters that end at each character of the word and at its end."""
    return windows(padded(word))


class KneserNey:
    """The model of counts that fit one dictionary: n-gram -> (in ordinary, in toxic documents); `ratios` makes the same on Spark.

    every: n-gram -> count in all documents, without it the sum of both classes.

    Each class discounts its own counts of the top order by `own` and gives what that frees to a model of both classes
    together, a Kneser-Ney model whose lower orders count types. Under each context the probabilities of all characters
    and of one that was never seen sum to 1, in the shared model and in both classes.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], every: dict[str, int] | None = None, own: float = OWN, discount: float = DISCOUNT):
        self.counts, self.own, self.discount = counts, own, discount
        self.total: dict[str, list[float]] = {}  # by context: tokens and what is freed, of each class
        both: Counter = Counter(every or {g: sum(c) for g, c in counts.items()})
        lower: list[Counter] = [Counter() for _ in range(ORDER + 1)]  # by length; under the top: distinct left extensions
        lower[ORDER] = both
        for g, c in counts.items():
            t = self.total.setdefault(g[:-1], [0, 0, 0.0, 0.0])
            for k in (0, 1):
                t[k] += c[k]
                t[2 + k] += min(c[k], own)
        for n in range(ORDER, 1, -1):
            for g in lower[n]:
                lower[n - 1][g[1:]] += 1
        self.lower = lower
        self.context: list[dict[str, list[int]]] = [{} for _ in range(ORDER + 1)]
        for n in range(1, ORDER + 1):
            for g, k in lower[n].items():
                t = self.context[n].setdefault(g[:-1], [0, 0])
                t[0] += k
                t[1] += 1
        self.floor = 1 / (1 + len(lower[1]))

    def shared(self, g: str) -> float:
        """The probability of the last character after the others, from both classes."""
        p, d = self.floor, self.discount
        for n in range(1, len(g) + 1):
            h = g[len(g) - n :]
            t = self.context[n].get(h[:-1])
            if t is None:
                break
            p = (max(self.lower[n][h] - d, 0) + d * t[1] * p) / t[0]
        return p

    def gram_ratio(self, g: str) -> float:
        """log P(last character | the others, toxic) - log P(the same, ordinary)."""
        t = self.total.get(g[:-1])
        if t is None:
            return 0.0
        p, c = self.shared(g), self.counts.get(g, (0, 0))
        at = [(max(c[k] - self.own, 0) + t[2 + k] * p) / t[k] if t[k] else p for k in (0, 1)]
        return math.log(at[1] / at[0])


@dataclass
class Model:
    ratios: DataFrame
    """gram, ratio: n-grams of ORDER characters, and contexts (one less) whose other n-grams have that ratio; any other n-gram has 0."""
    known: dict[str, float] | None
    """The same as a dictionary, if there are at most MOST_RATIOS."""
    weight: float = 0.0
    """Of evidence(mean), 0 or more."""
    intercept: float = -2.0


def beyond(ratio: float) -> float:
    """What a ratio exceeds MARGIN on its side, CAP at most and ORDINARY times that on the ordinary side; 0 within it."""
    return min(max(ratio - MARGIN, 0.0), CAP) + ORDINARY * max(min(ratio + MARGIN, 0.0), -CAP)


class Words(dict):
    """Words with their ratios beyond MARGIN, each worked out when it is first asked for."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known

    def of(self, text: str) -> float:
        """Of a padded word or a slice of a long run."""
        get, total = self.known.get, 0.0
        for k in range(len(text) - ORDER + 1):
            ratio = get(text[k : k + ORDER])
            if ratio is None:
                ratio = get(text[k : k + ORDER - 1], 0.0)
            total += ratio
        return beyond(total)

    def __missing__(self, word: str) -> float:
        value = self[word] = self.of(padded(word))
        return value


def features(text: str | None, cache: Words) -> tuple[float, ...]:
    """FEATURES of a text, from the words' log-likelihood ratios beyond MARGIN; zeros without a word."""
    words, slices = words_of(text or "")
    n = len(words) + len(slices)
    if not n:
        return (0.0,) * len(FEATURES)
    if len(cache) > 700_000:
        cache.clear()
    values = np.array([*map(cache.__getitem__, words), *map(cache.of, slices)])
    toxic, ordinary = float(values[values > 0].sum()) / (n + NEUTRAL), float(values[values < 0].sum()) / (n + NEUTRAL)
    return toxic, ordinary, min(max(toxic + ordinary, 0.0), MOST_MEAN)


def evidence(mean: Column | np.ndarray) -> Column | np.ndarray:
    """What the logistic map weighs: a logarithm, as the first toxic words of a text tell most."""
    return F.log1p(mean * 100) if isinstance(mean, Column) else np.log1p(mean * 100)


def count_grams(docs: DataFrame) -> DataFrame:
    """gram, ordinary, toxic, every: counts in the rows of docs (y, text) with y = 0, with y = 1 and in all rows, whatever y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[Counter] = [Counter(), Counter(), Counter()]
        pieces: list[Counter] = [Counter(), Counter(), Counter()]

        def handed_on() -> pa.RecordBatch:
            out: dict[str, list[int]] = {}
            for y in range(3):
                for found, split in ((words[y], grams), (pieces[y], windows)):
                    for w, n in found.items():
                        for g in split(w):
                            c = out.get(g)
                            if c is None:
                                c = out[g] = [0, 0, 0]
                            c[2] += n
                            if y < 2:
                                c[y] += n
                    found.clear()
            columns = zip(*out.values(), strict=True) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["gram", "ordinary", "toxic", "every"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = words_of(text or "")
                    for counter, w in zip((words, pieces), found, strict=True):
                        counter[2 if y is None else y].update(w)
                if sum(map(len, words)) + 10 * sum(map(len, pieces)) > MOST_WORDS:
                    yield handed_on()
        yield handed_on()

    found = docs.select("y", "text").mapInArrow(run, "gram string, ordinary long, toxic long, every long")
    return found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("ordinary", "toxic", "every")])


def ratios(counts: DataFrame) -> DataFrame:
    """gram, ratio of counts (gram, ordinary, toxic, every), as KneserNey has them.

    Only n-grams that a class has more than OWN times, and the contexts of these: an n-gram without a row has the ratio
    of its context, and 0 if that has no row either.
    """
    level = {ORDER: counts.select("gram", F.col("every").alias("c"))}
    for n in range(ORDER - 1, 0, -1):
        level[n] = materialise(level[n + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("c")), "grams")
    p, shared = F.lit(1 / (1 + level[1].count())), None
    for n in range(1, ORDER + 1):
        own = level[n].withColumn("h", F.substring("gram", 1, n - 1))
        t = own.groupBy("h").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("types"))
        if n == ORDER:  # the top order is asked for only where a class has something of its own
            own = own.join(counts.where((F.col("ordinary") > OWN) | (F.col("toxic") > OWN)).select("gram"), "gram", "left_semi")
        own = own.join(t, "h")
        if shared is not None:
            own = own.withColumn("shorter", F.expr("substring(gram, 2)")).join(shared, "shorter")
            p = F.col("p")
        shared = own.select(F.col("gram").alias("shorter"), ((F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * p) / F.col("s")).alias("p"))

    h = F.substring("gram", 1, ORDER - 1)
    classes = ("ordinary", "toxic")
    sums = [F.sum(c).alias(f"all_{c}") for c in classes] + [F.sum(F.least(F.col(c).cast("double"), F.lit(OWN))).alias(f"freed_{c}") for c in classes]
    contexts = counts.groupBy(h.alias("h")).agg(*sums).where("freed_ordinary < all_ordinary or freed_toxic < all_toxic")
    rest = [F.when(F.col(f"all_{c}") > 0, F.col(f"freed_{c}") / F.col(f"all_{c}")).otherwise(F.lit(1.0)) for c in classes]
    of_context = contexts.select(F.col("h").alias("gram"), F.log(rest[1] / rest[0]).alias("ratio"))
    top = counts.join(shared.withColumnRenamed("shorter", "gram"), "gram").withColumn("h", h).join(contexts, "h")
    at = [F.when(F.col(f"all_{c}") > 0, (F.greatest(F.col(c) - OWN, F.lit(0.0)) + F.col(f"freed_{c}") * F.col("p")) / F.col(f"all_{c}")).otherwise(F.col("p")) for c in classes]
    return top.select("gram", F.log(at[1] / at[0]).alias("ratio")).unionAll(of_context)


def measured(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep and FEATURES of each row's whole text; of keep without those names."""
    keep = kept(keep, [*FEATURES, "score"])
    if model.known is None:
        return measured_by_join(docs, model.ratios, keep)
    sent = docs.sparkSession.sparkContext.broadcast(model.known)
    schema = docs.select(*keep).schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"{c} double" for c in FEATURES])
    held: list[Words] = []  # one for each task

    def rows(columns):
        if not held:
            held.append(Words(sent.value))
        found = [features(t, held[0]) for t in columns[-1]]
        yield [*columns[:-1], *([f[k] for f in found] for k in range(len(FEATURES)))]

    return map_rows(docs.select(*keep, F.col("text").alias("__text")), rows, ddl)


def measured_by_join(docs: DataFrame, table: DataFrame, keep: list[str]) -> DataFrame:
    """measured by joins: table with the n-grams of each distinct word, and the words beyond MARGIN with the texts that hold them."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.md5(text)).alias("h2"), text.alias("text"))

    def rows(columns):
        out = ([], [], [], [], [])
        for h1, h2, t in zip(*columns, strict=True):
            words, slices = words_of(t)
            for w, n in Counter([*map(padded, words), *slices]).items():
                for o, x in zip(out, (h1, h2, w, n, len(words) + len(slices)), strict=True):
                    o.append(x)
        yield list(out)

    held = materialise(map_rows(keyed.select("h1", "h2", "text"), rows, "h1 long, h2 long, word string, n long, words long", rows=64).distinct(), "words")
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - (ORDER - 1)), lambda k: F.substr("word", k, F.lit(ORDER)))).alias("gram")
    found = held.select("word").distinct().select("word", gram).withColumn("h", F.substring("gram", 1, ORDER - 1))
    own, rest = table.where(F.length("gram") == ORDER), table.where(F.length("gram") < ORDER).select(F.col("gram").alias("h"), F.col("ratio").alias("other"))
    ratio = F.sum(F.coalesce("ratio", "other", F.lit(0.0)))
    value = F.least(F.greatest(ratio - MARGIN, F.lit(0.0)), F.lit(CAP)) + ORDINARY * F.greatest(F.least(ratio + MARGIN, F.lit(0.0)), F.lit(-CAP))
    beyond = found.join(own, "gram", "left").join(rest, "h", "left").groupBy("word").agg(value.alias("value")).where("value <> 0")
    all_words = F.col("words") + NEUTRAL
    sums = [(F.sum(F.col("n") * side("value", F.lit(0.0))) / all_words).alias(c) for c, side in zip(FEATURES, (F.greatest, F.least), strict=False)]
    total = held.join(beyond, "word").groupBy("h1", "h2", "words").agg(*sums)
    toxic, ordinary = F.col("toxic_side"), F.col("ordinary_side")
    per = [toxic, ordinary, F.least(F.greatest(toxic + ordinary, F.lit(0.0)), F.lit(MOST_MEAN))]
    made = [F.coalesce(x, F.lit(0.0)).alias(c) for x, c in zip(per, FEATURES, strict=True)]
    return keyed.drop("text").join(total, ["h1", "h2"], "left").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *made)


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = 4_000) -> Model:
    """A model that counts all rows of docs for what both classes share, and for each class all its labelled rows for which learn holds.

    Only a quarter of the labelled rows, `most` at most and the first in the order of a hash of doc_id, are in no class: they
    set how the mean becomes a probability, which never falls with it. Labels that are null or not 0 or 1 teach nothing; an id with several labels takes
    the largest. With one label only, the score is constant.
    """
    usable = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    quarter = usable.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(4)) == 0)
    chosen = materialise(quarter.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "chosen")
    counted = usable.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")  # at most `most` ids
    few = counted.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    counts = materialise(count_grams(docs.select("doc_id", "text").join(F.broadcast(counted) if few else counted, "doc_id", "left")), "grams")
    table = materialise(ratios(counts), "ratios")
    few = table.limit(MOST_RATIOS + 1).count() <= MOST_RATIOS
    model = Model(table, {r.gram: r.ratio for r in table.toLocalIterator()} if few else None)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Ids may repeat, so the rows are bounded too.
    got = measured(sample, model, ["doc_id", "y"]).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(most).toPandas().sort_values(["y", *FEATURES])
    x, y = evidence(got[["mean"]].to_numpy()), got["y"].to_numpy(float)
    if len(y) and y.min() < y.max():
        w, b = lasso_logistic(x, y, penalty=1e-4, rounds=3000)
        model.weight, model.intercept = max(float(w[0]), 0.0), b
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep, score (0 to 1) and FEATURES of each row's whole text; null and empty texts as without words.

    A word more whose ratio exceeds MARGIN by MOST_MEAN never lowers a score, however long or toxic the text is, and one whose
    ratio is under MARGIN never raises it. Of keep, a column with the name of one that is made here is left out.
    """
    z = F.lit(model.intercept) + evidence(F.col("mean")) * model.weight
    found = measured(docs, model, keep)
    own = found.columns[: -len(FEATURES)]
    return found.select(*own, (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))).alias("score"), *FEATURES)
