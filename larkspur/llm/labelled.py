"""A bounded sample of labelled documents, to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo of; -1 if the id is null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(of)), F.lit(-1)).cast("int")


def sample(documents: DataFrame, labels: DataFrame, label: str, bound: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, y) of about bound labelled documents, chosen by a hash of the id, or of all if there are fewer.

    Labels other than 0 and 1, and null ids, are ignored; of several labels of a document the larger counts. The ids
    are sent to every executor: there are at most about bound of them.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, bound / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.col("_id").cast("long"), F.lit(42)), F.lit(1 << 20)) < int(share * (1 << 20)))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.col("doc_id").cast("long"), "text", "y")
