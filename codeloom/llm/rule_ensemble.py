"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Boosted shallow trees are grown on a bounded sample of labelled rows; every path from a root is a conjunctive rule
over the statistics; a logistic regression with a lasso penalty weighs the rules, and the few that keep a weight are
compiled into one Spark column expression. Statistics and scores are Spark expressions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WORD_SPLIT, kept

PUNCTUATION = ".,;:?'\"-"
SYMBOLS = "#*$%&|<>=@^~_+/\\{}[]"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text as expressions; a null counts as empty, and an empty text has zeros."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, WORD_SPLIT), lambda w: w != "")
    # Beside words, this holds the word after each. A lookup in words inside a lambda would split the text for every word.
    rest = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def share(chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))) / n

    def ratio(a: Column, b: Column) -> Column:
        return a / F.greatest(b, F.lit(1))

    return {
        "chars": F.length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": ratio(F.length(F.regexp_replace(t, WORD_SPLIT, "")), F.size(words)),
        "symbols": share(SYMBOLS),
        "marks": share("!"),
        "bars": share("|"),
        "punctuation": share(PUNCTUATION),
        "digits": share("0123456789"),
        "upper": (n - F.length(F.regexp_replace(t, r"\p{Lu}", ""))) / n,
        "letters": (n - F.length(F.regexp_replace(t, r"\p{L}", ""))) / n,
        "distinct_words": ratio(F.size(F.array_distinct(words)), F.size(words)),
        "repeats": ratio(F.size(F.filter(F.zip_with(words, rest, lambda w, after: w == after), lambda same: same)), F.size(words)),
        "lines": ratio(F.size(lines), F.size(words)),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)), F.size(lines)),
        "longest_word": F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)).cast("double"),
    }


#: A condition: statistic, whether it must be above the limit (else at most the limit), limit.
Condition = tuple[str, bool, float]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self, stats: dict[str, Column]) -> Column:
        """The probability of label 1 as an expression over columns of statistics."""
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            met = F.lit(True)
            for name, above, limit in conditions:
                met = met & ((stats[name] > limit) if above else (stats[name] <= limit))
            total = total + F.when(met, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, names: list[str], residual: np.ndarray, limits: list[np.ndarray], depth: int, least: int) -> tuple[list, list[bool]]:
    """A regression tree on the residuals: the rule of every node but the root, and whether that node is a leaf."""
    rules, leaves = [], []
    todo = [(np.arange(len(x)), (), depth)]
    while todo:
        rows, path, left = todo.pop()
        r = residual[rows]
        best = (1e-9 + r.sum() ** 2 / len(r), None)
        for j in range(x.shape[1]) if left and len(rows) >= 2 * least else ():
            for limit in limits[j]:
                above = x[rows, j] > limit
                k = int(above.sum())
                if least <= k <= len(rows) - least:
                    s = r[above].sum()
                    gain = s * s / k + (r.sum() - s) ** 2 / (len(rows) - k)
                    if gain > best[0] * (1 + 1e-9):
                        best = gain, (j, limit, above)
        if path:
            rules.append(path)
            leaves.append(best[1] is None)
        if best[1]:
            j, limit, above = best[1]
            todo.append((rows[~above], (*path, (names[j], False, float(limit))), left - 1))
            todo.append((rows[above], (*path, (names[j], True, float(limit))), left - 1))
    return rules, leaves


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept bears no penalty."""
    n, m = z.shape
    step = 4 / max(np.linalg.norm(np.c_[z, np.ones(n)].T @ np.c_[z, np.ones(n)], 2) / n, 1e-9)
    w, b, v, c, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - step * (z.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b, t2 = c - step * g.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, float(b)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, rate: float = 0.3, penalty: float = 0.001, seed: int = 7) -> RuleModel:
    """The ensemble for statistics x (a row each) and labels y of 0 and 1; with one label only, its share as a constant."""
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return RuleModel(float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    limits = [np.unique(np.quantile(col, np.linspace(0.02, 0.98, 25))) for col in x.T]
    score, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), min(len(y), 1500), replace=False))
        residual = y - 1 / (1 + np.exp(-score))
        found, leaves = grow(x[rows], names, residual[rows], limits, depth, least=max(3, len(rows) // 200))
        rules.update(dict.fromkeys(found))
        z = holds(x, names, found)
        for k in np.flatnonzero(leaves):  # each leaf moves the rows that it covers towards their residual
            hit = z[:, k] > 0
            if hit.any():
                score[hit] += rate * 4 * residual[hit].mean()
    kept = list(rules)
    z = holds(x, names, kept)
    w, b = lasso_logistic(z, y, penalty)
    return RuleModel(b, [(r, float(k)) for r, k in zip(kept, w, strict=True) if abs(k) > 1e-3])


def holds(x: np.ndarray, names: list[str], rules: list) -> np.ndarray:
    at, z = {n: j for j, n in enumerate(names)}, np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for name, above, limit in rule:
            z[:, k] *= (x[:, at[name]] > limit) == above
    return z


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = 6000) -> RuleModel:
    """A model from at most `most` labelled rows: those of labels for which learn holds, in the order of a hash of doc_id.

    Labels that are null or not 0 or 1 teach nothing; an id with several labels takes the largest. Only statistics of
    the sampled rows come to the driver, a few numbers a row.
    """
    usable = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    stats = statistics(F.col("text"))
    names = list(stats)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` rows of two numbers
    # Ids may repeat, so the rows are bounded too.
    made = sample.select("doc_id", "y", *[c.alias(n) for n, c in stats.items()]).orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(most)
    got = made.toPandas().sort_values(["doc_id", *names])
    return fit(got[names].to_numpy(float), got["y"].to_numpy(float), names)


def score(docs: DataFrame, model: RuleModel, keep: list[str]) -> DataFrame:
    """The columns in keep and score (0 to 1) of each row's whole text; null and empty texts are scored as empty.

    Of keep, a column named score is left out.
    """
    keep = kept(keep, ["score"])
    stats = statistics(F.col("text"))
    used = sorted({c[0] for rule, _ in model.rules for c in rule})
    held = F.struct(*[stats[n].alias(n) for n in used]) if used else F.struct(F.lit(0).alias("none"))
    # The statistics are put aside under one name of their own, so that no column of keep can clash with them.
    aside = docs.select(*keep, held.alias("__statistics"))
    return aside.select(*keep, model.column({n: F.col("__statistics")[n] for n in used}).alias("score"))
