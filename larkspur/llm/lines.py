"""Line dedup and substring dedup: fuzzy lines by character shingles, paragraphs by word shingles.

Both find classes of near-duplicate units over all documents (see near.py) and keep one unit of each class,
that of the smallest (doc_id, place in the text).

Lines are the parts between line feeds; white space at their ends does not count, A-Z are as a-z, blank lines are
left alone. Paragraphs are lines too, compared as a whole by their words first; one of fewer words than a shingle has
one shingle of all its words. Then the lines are cut into pieces at places that their own words decide, so that a passage
is found wherever it stands in a line; pieces of fewer words than a shingle are left alone, as their lines are not.

Edge cases: null and empty texts have no units, a null id comes after all others; rows equal in id and text are
one document, rows with the same id and other texts are several; texts of any length are taken whole; an empty
table gives an empty result; further columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import near
from larkspur.llm.session import cut
from larkspur.llm.units import Spec, blocks, shingled

LAST = 2**63 - 1


def line_spec(size: int = 8, percent: int = 80) -> Spec:
    """20 bands of 5 rows: a pair at 0.8 shares none with a chance of 4 in 10,000."""
    return Spec("line", "char", size, percent, 5, 20, by_content=True)


def whole_spec(size: int = 5, percent: int = 80) -> Spec:
    """Whole paragraphs. 8 bands of 3 rows: a pair at 0.8 shares none with a chance of 3 in 1,000, and equal paragraphs share all."""
    return Spec("line", "word", size, percent, 3, 8, by_content=True)


def paragraph_spec(size: int = 5, percent: int = 80) -> Spec:
    """The pieces of paragraphs, in bands like whole ones."""
    return Spec("piece", "word", size, percent, 3, 8, by_content=True)


def keyed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id: a key of id and text, place: what orders documents, text)"""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return documents.select(key(doc_id, text).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("place"), t.alias("text"))


def key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), F.coalesce(F.col(text).cast("string"), F.lit("")))


def n_lines(text: Column) -> Column:
    """How many lines of text are not blank (long)."""
    return F.size(F.filter(F.split(text, "\n", -1), lambda line: near.trimmed(line) != "")).cast("long")


def counted(documents: DataFrame, spec: Spec, doc_id: str, text: str) -> DataFrame:
    """Per row of documents: doc_id, key, n_units (that are not left alone); of pieces also n_lines (that are not blank)."""
    if spec.unit == "line":
        return documents.select(F.col(doc_id).alias("doc_id"), key(doc_id, text).alias("key"), n_lines(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("n_units"))
    kind = documents.schema[doc_id].dataType

    def task(batches):
        for batch in batches:
            for first, texts in blocks(batch.column(0).to_pylist()):
                s = shingled(texts, spec, names=True)
                n = np.bincount(s.doc[s.count > 0], minlength=len(texts))
                head = np.concatenate([[True], (s.doc[1:] != s.doc[:-1]) | (s.line[1:] != s.line[:-1])])[: len(s.doc)]  # every line with a word has a piece
                lines = np.bincount(s.doc[head], minlength=len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(texts)), batch.column(2).slice(first, len(texts)), pa.array(n), pa.array(lines)], ["doc_id", "key", "n_units", "n_lines"])

    schema = T.StructType().add("doc_id", kind).add("key", T.LongType()).add("n_units", T.LongType()).add("n_lines", T.LongType())
    return documents.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"), key(doc_id, text).alias("key")).mapInArrow(task, schema)


def removals(documents: DataFrame, spec: Spec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of documents: doc_id, n_units, n_removed, removed (the numbers of its units that go, ascending)."""
    gone = near.repeats(keyed(documents, doc_id, text), spec, "place").withColumnRenamed("doc_id", "key")
    none = F.array().cast("array<int>")
    out = counted(documents, spec, doc_id, text).join(gone, "key", "left").withColumn("removed", F.coalesce("removed", none))
    return out.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), "removed")


def paragraph_removals(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of documents: doc_id; n_pieces; n_paragraphs; n_removed (of the next two together); removed_paragraphs, the numbers of its lines
    that repeat an earlier line as a whole; removed_passages, the numbers of its pieces, in lines that stay, that repeat an earlier one in a
    line that stays, so what goes is always kept elsewhere; removed, all pieces that repeat an earlier one, whatever becomes of their lines."""
    docs, none = keyed(documents, doc_id, text), F.array().cast("array<int>")
    both, roots = near.classes(docs, (whole_spec(size, percent), paragraph_spec(size, percent)), "place")  # lines and pieces are classed apart, in one pass
    whole = cut(near.later(both.where("kind = 0"), roots, "place"), free=True).withColumnRenamed("removed", "removed_paragraphs")
    pieces = both.where("kind = 1")
    left = pieces.join(whole, "doc_id", "left").where(~F.coalesce(F.array_contains("removed_paragraphs", F.col("line")), F.lit(False)))
    passages = near.later(left.drop("removed_paragraphs"), roots, "place").withColumnRenamed("removed", "removed_passages")
    gone = near.later(pieces, roots, "place").join(passages, "doc_id", "full").join(whole, "doc_id", "full").withColumnRenamed("doc_id", "key")
    out = counted(documents, paragraph_spec(size, percent), doc_id, text).join(gone, "key", "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("removed_paragraphs", "removed_passages", "removed")})
    n = (F.size("removed_paragraphs") + F.size("removed_passages")).cast("long")
    return out.select("doc_id", F.col("n_units").alias("n_pieces"), F.col("n_lines").alias("n_paragraphs"), n.alias("n_removed"), "removed_paragraphs", "removed_passages", "removed")


def line_dedup(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: Spec | None = None) -> DataFrame:
    """documents without the repeated lines; a document of which no line is left, though it had some, goes."""
    gone = near.repeats(keyed(documents, doc_id, text), spec or line_spec(), "place").select(F.col("doc_id").alias("_key"), F.col("removed").alias("_removed"))
    out = documents.select(F.struct("*").alias("_row"), key(doc_id, text).alias("_key")).join(gone, "_key", "left")  # the columns as one, whatever their names
    whole = F.col("_row")[text]
    out = out.select("_row", "_removed", F.when(F.col("_removed").isNull(), whole).otherwise(_kept(whole, F.col("_removed"))).alias("_left"))
    out = out.where("_removed IS NULL OR _left RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.select(*(F.col("_left").alias(c) if c == text else F.col("_row")[c].alias(c) for c in documents.columns))


def _kept(text: Column, removed: Column) -> Column:
    """The lines of text whose numbers are not in removed."""
    lines = F.split(text, "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.array_join(F.transform(F.arrays_zip(F.array(lines).alias("lines"), F.array(rest).alias("rest")), lambda x: F.array_join(F.transform(x["rest"], lambda i: F.get(x["lines"], i)), "\n")), "")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"), line_spec()).withColumnsRenamed({"n_units": "n_lines"})


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
