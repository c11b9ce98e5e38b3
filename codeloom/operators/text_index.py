"""A full-text index stored once: postings by term, a dictionary of terms, and ranked search from the postings alone.

Postings hold a term's frequency in a text and the text's length, so a search reads the folders of its terms' buckets and
nothing of the texts. A term in very many texts is dealt over several files. Scores are BM25.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.plans.staging import staged

K1, B = 1.2, 0.75
#: Folders of postings, and rows of a term's postings in one task when they are written.
BUCKETS, PER_TASK = 64, 1_000_000


def terms_of(text: Column) -> Column:
    """The terms of a text: runs of small letters and digits, capitals made small."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    postings: DataFrame
    """bucket, term, id, tf, length; a folder for each bucket."""
    terms: DataFrame
    """first, term, df: the dictionary; a folder for each first character."""
    n_texts: int
    mean_length: float

    def search(self, query: str, most: int = 50) -> DataFrame:
        """id, score, rank: the texts with the best sums over the query's distinct terms, ties by id; only the terms' folders are read."""
        spark = self.postings.sparkSession
        row = spark.range(1).select(terms_of(F.lit(query)).alias("t")).select(F.array_distinct("t").alias("t"), F.array_distinct(F.transform("t", bucket_of)).alias("b"), F.array_distinct(F.transform("t", lambda t: F.substring(t, 1, 1))).alias("f")).first()
        if not row["t"]:
            return self._ranked(self.postings.limit(0).withColumn("df", F.lit(0).cast("long")), most)
        asked = self.terms.where(F.col("first").isin(row["f"]) & F.col("term").isin(row["t"])).select("term", "df")
        own = self.postings.where(F.col("bucket").isin(row["b"]) & F.col("term").isin(row["t"]))
        return self._ranked(own.join(F.broadcast(asked), "term"), most)  # a row for each word of the query

    def starting(self, prefix: str, most: int = 50) -> DataFrame:
        """The same for all terms that begin with a prefix, found in the dictionary; each counts as a term of its own."""
        low = prefix.lower()
        if not low:
            return self._ranked(self.postings.limit(0).withColumn("df", F.lit(0).cast("long")), most)
        asked = self.terms.where((F.col("first") == low[0]) & F.startswith("term", F.lit(low))).select("term", "df", bucket_of(F.col("term")).alias("bucket"))
        return self._ranked(self.postings.join(asked, ["bucket", "term"]), most)

    def _ranked(self, found: DataFrame, most: int) -> DataFrame:
        idf = F.log(1 + (self.n_texts - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / max(self.mean_length, 1e-9)))
        best = found.groupBy("id").agg(F.round(F.sum(weight), 6).alias("score")).orderBy(F.desc("score"), "id").limit(most)
        return best.select("id", "score", F.row_number().over(_by_score()).alias("rank"))


def _by_score():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("score"), "id")  # over the few rows that are left


def build(texts: DataFrame) -> Index:
    """The index of texts (id, text). Rows with a null id are left out; the texts of one id count as one."""
    each = texts.where("id is not null").select("id", terms_of(F.col("text")).alias("terms"))
    ids = texts.where("id is not null").groupBy("id").count().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()
    each = each.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms")) if ids["most"] > 1 else each
    sized = each.select("id", "terms", F.size("terms").alias("length"))
    rows = staged(sized.select("id", "length", F.explode("terms").alias("term")).groupBy("term", "id", "length").agg(F.count(F.lit(1)).cast("int").alias("tf")))
    total = rows.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")).first()["total"]  # of texts read once
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = staged(df.select(F.substring("term", 1, 1).alias("first"), "term", "df"), "first")
    wide = terms.where(F.col("df") > PER_TASK).select("term", "df")  # a row for each PER_TASK rows at most
    salted = rows.join(F.broadcast(wide), "term", "left").withColumn("bucket", bucket_of(F.col("term")))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("df", F.lit(1)) / PER_TASK))
    dealt = salted.repartition("bucket", part).sortWithinPartitions("bucket", "term").select("bucket", "term", "id", "tf", "length")
    return Index(staged(dealt, "bucket"), terms, ids["n"], total / max(ids["n"], 1))
