"""Quality rules: base counts of a text, and lines that too many documents of a host share.

Method: lines are normalised and hashed, the distinct documents of each (host, line) are counted,
lines above the host's limit are removed, and documents that lose too much of their words are rejected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WORD_SPLIT, map_rows, materialise

SYMBOLS = b"#*$%&|<>"
ASCII_SPACE = b" \t\n\v\f\r"


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text (a null has none of them).

    >>> text_counts("a b c\\na b c\\na b c d")
    (10, 10, 0, 1, 10)
    """
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, ASCII_SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.translate(None, ASCII_SPACE):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return n, len(text) - spaces, symbols, dup, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v > 2_000_000:  # three ids would not fit 63 bits
        pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * v + ids[2:]
    else:
        windows = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    _, where, count = np.unique(windows, return_inverse=True, return_counts=True)
    hit = count[where] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, key and the counts of every row's whole text."""

    def rows(columns):
        ids, keys, texts = columns
        yield [ids, keys, *map(list, zip(*map(text_counts, texts), strict=True))]

    schema = "doc_id long, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return map_rows(docs.select("doc_id", "key", "text"), rows, schema)


def normalised(line: Column) -> Column:
    """A line in lower case, runs of white space as one space, digits as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), WORD_SPLIT, " "), "[0-9]", "0"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, key, host, doc, line_hash, words of every line with a word in docs (doc_id, key, host, text), written once.

    doc tells the documents of a line apart: by doc_id, or by the text where that is null.
    """
    doc = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(1), "text")).otherwise(F.xxhash64("doc_id"))
    one = F.transform(F.filter(F.transform(F.split("text", "\n"), normalised), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))
    each = docs.select("doc_id", "key", "host", doc.alias("doc"), F.explode(one).alias("line"))
    return materialise(each.select("doc_id", "key", "host", "doc", F.col("line.h").alias("line_hash"), F.col("line.n").alias("words")), "lines")


def line_frequency(lines: DataFrame, docs: DataFrame, min_docs: int = 3, max_share: float = 0.0) -> DataFrame:
    """host, line_hash, n_docs of the lines above their host's limit: max(min_docs, max_share of the host's documents).

    By default the limit is a number of documents alone, so it is the same at a host of ten documents and at one of millions.
    n_docs are distinct documents: rows that share a doc_id count once for a line, as do rows without one that share a text.
    A line in a third of all documents is dealt out by document before it is counted, and then costs one row a task.
    """
    per_line = lines.select("host", "line_hash", "doc").distinct().groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    if not max_share:
        return per_line
    doc = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5("text")), F.lit("-"))
    per_host = docs.select(F.col("host").alias("h"), doc.alias("doc")).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("host_docs"))
    return per_line.join(per_host, per_line.host.eqNullSafe(per_host.h)).where(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line_hash", "n_docs")


def removed_words(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """doc_id, key, removed_words: words of each document in lines that are too frequent at its host, over all rows that repeat it."""
    f = frequent.select(F.col("host").alias("h"), F.col("line_hash").alias("lh"))
    hit = lines.join(f, lines.host.eqNullSafe(f.h) & (lines.line_hash == f.lh), "left_semi")
    return hit.groupBy("doc_id", "key").agg(F.sum("words").alias("removed_words"))


def keyed(docs: DataFrame, host: str) -> DataFrame:
    return docs.select("doc_id", F.col(host).alias("host"), "text").withColumn("key", F.xxhash64("doc_id", "host", "text"))


def apply_rules(
    docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_pct: int = 50, min_docs: int = 3, max_share: float = 0.0, min_left: float = 0.5
) -> DataFrame:
    """One row per input row: the base counts, base_failed, removed_words, kept.

    kept is false if the base rules fail or if under min_left of the words are left once frequent lines are gone.
    A null or empty text has no words and fails the base rules. A null host is a host of its own. Rows that
    repeat a (doc_id, host, text) get equal verdicts. Other columns are ignored.
    """
    docs = keyed(docs, host)
    base, lines = base_counts(docs), lines_of(docs)
    gone = removed_words(lines, line_frequency(lines, docs, min_docs, max_share))
    copies = docs.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    gone = gone.join(copies, gone.doc_id.eqNullSafe(copies.doc_id) & (gone.key == copies.key)).select(
        gone.doc_id.alias("g_id"), gone.key.alias("g_key"), (F.col("removed_words") / F.col("copies")).cast("long").alias("removed_words")
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    removed = F.coalesce(F.col("removed_words"), F.lit(0))
    return (
        base.join(gone, base.doc_id.eqNullSafe(gone.g_id) & (base.key == gone.g_key), "left")
        .withColumn("base_failed", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.col("n_words") - removed >= min_left * F.col("n_words"))).alias("kept"),
            removed.alias("removed_words"),
        )
    )


def clean_text(docs: DataFrame, host: str = "source", min_docs: int = 3, max_share: float = 0.0) -> DataFrame:
    """doc_id, text without the lines that are too frequent at the host (null stays null)."""
    docs = keyed(docs, host)
    frequent = line_frequency(lines_of(docs), docs, min_docs, max_share)
    lines = docs.select("doc_id", "key", "host", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line_hash", F.xxhash64(normalised(F.col("line"))))
    f = frequent.select(F.col("host").alias("h"), F.col("line_hash").alias("lh"))
    left = lines.join(f, lines.host.eqNullSafe(f.h) & (lines.line_hash == f.lh), "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    kept = left.groupBy("doc_id", "key").agg(text.alias("clean"))
    ids = docs.select(F.col("doc_id").alias("d_id"), F.col("key").alias("d_key"), F.col("text").isNull().alias("no_text"))
    return ids.join(kept, ids.d_id.eqNullSafe(kept.doc_id) & (ids.d_key == kept.key), "left").select(
        F.col("d_id").alias("doc_id"), F.when(~F.col("no_text"), F.coalesce("clean", F.lit(""))).alias("text")
    )
