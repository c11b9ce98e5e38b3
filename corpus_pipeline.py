"""A pipeline over documents: quality, toxicity, near duplicates, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import jaccard_join, packing, rule_ensemble, toxicity
from codeloom.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents stay at this probability of good quality or more, and go at this probability of being toxic or more.
QUALITY, TOXIC = 0.3, 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score by the sparse rule ensemble is under QUALITY.

    Null and empty texts are scored as empty; rows with a null doc_id teach nothing and are scored; rows that repeat fare alike.
    Without labels all documents stay.
    """
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"), "quality", F.col("doc_id").isNotNull())
    return rule_ensemble.score(docs, model, COLUMNS).where(F.col("score") >= QUALITY).select(*COLUMNS)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score by the class-conditional Kneser-Ney models is TOXIC or more.

    Null and empty texts have no word and stay; rows with a null doc_id are counted for what both classes share, and are
    scored; rows that repeat fare alike. Without labels all documents stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", F.col("doc_id").isNotNull())
    return toxicity.score(docs, model, COLUMNS).where(F.col("score") < TOXIC).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows that share the smallest doc_id of their group, and rows with a null doc_id, all stay.
    """
    near = jaccard_join.join(docs, k=5, pct=80)
    gone = near.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    gone = materialise(gone, "duplicates")
    few = gone.limit(jaccard_join.MOST_BROADCAST + 1).count() <= jaccard_join.MOST_BROADCAST
    return docs.select(*COLUMNS).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens, every window with the sources' shares of all tokens.

    Null texts are the end token alone, null sources a queue of their own, null ids stay null, and rows that repeat are all packed.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("toxicity", non_toxic), ("n-gram Jaccard join", distinct_documents), ("mixture packing", packed)]

#: Trained models and tokens are beyond SQL; tests/llm/test_pipeline.py compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
