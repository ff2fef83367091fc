"""A bounded sample of labelled documents, and the contract's hold-out by crc32 of the id as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most. Which ones depends on a hash of the id only.
LABELLED_ROWS = 20_000


def remainder(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(of))


def sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held: int, rows: int = LABELLED_ROWS) -> DataFrame:
    """(text, y) of at most `rows` labelled documents that are not held out; equal texts once (their mean label, >= 0.5)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("labelled_id"), F.col(label).cast("int").alias("y"))
    known = known.where(remainder(F.col("labelled_id"), of) != held).orderBy(F.xxhash64("labelled_id"), "labelled_id", "y").limit(rows)
    got = docs.select(F.col("doc_id").cast("long").alias("labelled_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "labelled_id")
    return got.groupBy("text").agg(F.avg("y").alias("y")).select("text", (F.col("y") >= 0.5).cast("int").alias("y"))
