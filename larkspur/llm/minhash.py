"""MinHash near-dedup of documents: word shingles, one-permutation hashing with optimal densification, banded
buckets, star-shaped candidate links, confirmation on full sets, components (see near.py).

Edge cases: null, empty and blank texts have an empty set and are linked with nothing; a text with fewer
words than a shingle has one shingle of all its words; texts of any length are taken whole; a row with a
null id has no class (component_id null) and is kept; rows with the same id are classed each by its text;
an empty table gives no rows; further columns are not looked at, and ``dedup`` leaves them as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import near
from larkspur.llm.lines import key, keyed
from larkspur.llm.session import cut
from larkspur.llm.skew import with_least
from larkspur.llm.units import Spec


def spec(shingle: int, percent: int) -> Spec:
    """42 bands of 6 rows: a pair at 0.8 shares none with a chance of 3 in a million."""
    return Spec("document", "word", shingle, percent, 6, 42)


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id (the smallest id of the class), kept."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    how = (spec(shingle, percent),)
    _, roots = near.classes(docs.where("doc_id IS NOT NULL"), how)
    nodes = cut(near.units(docs, how).join(roots, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "node").alias("root")), free=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    out = with_least(nodes, "root", F.col("doc_id"), "least", "doc_id").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents but those near-duplicate to one with a smaller id (a null id comes last); rows equal in id and text stay or go together."""
    gone = near.repeats(keyed(documents, doc_id, text), spec(shingle, percent), "place").select(F.col("doc_id").alias("_key"))
    return documents.select(F.struct("*").alias("_row"), key(doc_id, text).alias("_key")).join(gone, "_key", "left_anti").select("_row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
