"""The corpus pipeline: documents of low quality and toxic ones go, one of each near-duplicate group stays, repeated
passages are cut out, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's
docs. All but the last return the columns that they are given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import jaccard, packing, quality, repeats, toxicity
from tracewell.llm.common import drop, plain, release, shared_folder, table


def _kept(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """The rows of scored, which has the columns of docs and a score, as rows of docs."""
    return scored.drop("score").toDF(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go. The model is that of the labelled documents of sf_dir.

    Null and empty texts score by their statistics, which are zeros. Repeated rows score alike; a tie with the threshold
    stays; texts of any length are read whole; an empty table gives an empty one; other columns may have any names.
    """
    known = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(known, table(spark, sf_dir, "labels"))
    return _kept(docs, quality.score(plain(docs, "doc_id", "text"), model).where(f"score >= {quality.THRESHOLD}"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the threshold or above go. Labels are read for the documents that came in.

    Null and empty texts score as the share of toxic labels alone. Repeated rows score alike; a tie with the threshold
    goes; texts of any length are read whole; an empty table gives an empty one; other columns may have any names.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _kept(docs, toxicity.score(plain(docs, "doc_id", "text"), model).where(f"score < {toxicity.THRESHOLD}"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that with the smallest doc_id; a null one is the smallest, of equal ids the text
    with the smaller hash. Null texts are empty ones, which are copies of each other. An empty table gives an empty one;
    other columns may have any names."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document or place has already are cut out of the texts. All rows stay: a text that is all
    repeated is empty, a null one stays null. Earlier is by doc_id, null first, then by a hash of the text. An empty
    table gives an empty one; other columns may have any names."""
    return repeats.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences. Null and empty texts are one piece of one id; repeated
    rows and rows without a doc_id are packed each for itself; an empty table gives an empty one."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the first stage; the stages are tested against brute force and held-out labels in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's tables, and what it was made from, are deleted once it is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        release(spark)
        if k:
            drop(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
