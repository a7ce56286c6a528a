"""Toxicity by multiple-instance learning.

A document is toxic if any of its sentences is: with p a sentence's probability, a document's is 1 - prod(1 - p)
(noisy-or). Only documents are labelled; the weights of what sentences contain are trained through that product,
and the trained sentence scores then show which sentence offends.

A sentence contains its words and the first 3 to 8 letters of longer ones. Which of these are looked at is decided on
a bounded sample of labelled documents: the ``features`` that tell toxic documents best by the G-squared statistic.
A sentence with none of them is clean.

Edge cases: null, empty and blank texts score 0 and have no worst sentence; documents of any length are scored
whole; without labels of both kinds every score is 0; repeated rows are scored alike; an empty table gives no rows; further columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.labelled import remainder, sample

#: Labelled documents that are learned from at most, features that are kept, and documents that must have a feature.
BOUND, FEATURES, LEAST = 10_000, 1500, 4
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def names(word: str) -> list[int]:
    """What a word (in lower case) contributes to its sentence, hashed."""
    parts = ["w" + word, *("p" + word[:k] for k in range(3, 9) if len(word) > k)]
    return [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in parts]


def counts(rows: DataFrame) -> DataFrame:
    """(feature, pos, neg): how many toxic and other documents have each feature; summed in each task first."""

    def task(batches):
        cache: dict[str, list[int]] = {}
        for batch in batches:
            found: list[list[np.ndarray]] = [[], []]
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine: set[int] = set()
                for w in set(WORD.findall((text or "").lower())):
                    if (f := cache.get(w)) is None:
                        f = cache[w] = names(w)
                    mine.update(f)
                found[y].append(np.fromiter(mine, np.int64, len(mine)))
                if len(cache) > 300_000:
                    cache.clear()
            for y in (0, 1):
                if found[y]:
                    f, n = np.unique(np.concatenate(found[y]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n * y), pa.array(n * (1 - y))], ["feature", "pos", "neg"])

    return rows.select("text", "y").mapInArrow(task, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def chosen_features(rows: DataFrame, most: int, least: int) -> list[int]:
    """The features with the largest G-squared; at most most, each in least documents or more."""
    total = rows.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).first()
    p, n = total["p"] or 0, total["n"] or 0
    if not p or not n:
        return []
    share = (F.col("pos") + F.col("neg")) / F.lit(p + n)
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g = term(F.col("pos"), p * share) + term(F.col("neg"), n * share) + term(p - F.col("pos"), p * (1 - share)) + term(n - F.col("neg"), n * (1 - share))
    top = counts(rows).where(F.col("pos") + F.col("neg") >= least).orderBy(F.round(g, 6).desc(), "feature").limit(most)
    return [r["feature"] for r in top.select("feature").collect()]


class Sentences:
    """The known features of sentences."""

    def __init__(self, features: list[int]) -> None:
        self.known = {f: k for k, f in enumerate(features)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def of(self, text: str) -> list[tuple[int, int, list[int]]]:
        """Start, end and features (ascending) of each sentence that has any."""
        out, cache = [], self.cache
        if len(cache) > 500_000:
            cache.clear()
        for m in SENTENCE.finditer(text):
            mine: set[int] = set()
            for w in WORD.findall(m[0].lower()):
                f = cache.get(w)
                if f is None:
                    f = cache[w] = tuple(self.known[x] for x in names(w) if x in self.known)
                if f:
                    mine.update(f)
            if mine:
                out.append((m.start(), m.end(), sorted(mine)))
        return out


def trained(y: np.ndarray, doc: np.ndarray, owner: np.ndarray, feature: np.ndarray, size: int, rounds: int = 300, shrink: float = 0.3) -> np.ndarray:
    """size weights and an intercept, from y of each document, the document of each sentence, and sentence and number of each feature that a sentence has."""
    w, b = np.zeros(size), -4.0
    gw, gb = np.full(size, 1e-8), 1e-2
    for _ in range(rounds):
        z = b + np.bincount(owner, w[feature], len(doc))
        clean = np.maximum(np.bincount(doc, np.logaddexp(0, z), len(y)), 1e-9)  # -log of the probability that no sentence offends
        e = np.exp(-clean)
        slope = np.clip((1 - y) - y * e / (1 - e), -50, 50)
        dz = slope[doc] / (1 + np.exp(-z))
        g = np.bincount(feature, dz[owner], size) + shrink * w
        gw += g * g
        w -= 0.3 * g / np.sqrt(gw)
        gb += dz.sum() ** 2
        b -= 0.3 * dz.sum() / np.sqrt(gb)
    return np.append(w, b)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = BOUND, features: int = FEATURES, least: int = LEAST) -> tuple[list[int], list[float]]:
    """The features and their weights, the intercept last. labels: (doc_id, label) of the documents to learn from."""
    rows = sample(documents, labels, label, bound)
    chosen = chosen_features(rows, features, least)
    if not chosen:
        return [], [0.0]

    def encode(batches):
        s = Sentences(chosen)
        for batch in batches:
            found = [s.of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([[f for _, _, f in x] for x in found], pa.list_(pa.list_(pa.int32())))], ["doc_id", "y", "sentences"])

    encoded = rows.mapInArrow(encode, "doc_id long, y int, sentences array<array<int>>")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        found = table.column("sentences").to_pylist()
        doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
        each = [f for x in found for f in x]
        owner = np.repeat(np.arange(len(each)), [len(f) for f in each])
        feature = np.array([k for f in each for k in f], np.int64)
        w = trained(table.column("y").to_numpy().astype(float), doc, owner, feature, len(chosen))
        return pa.table({"weights": pa.array([w.tolist()])})

    # One task, for the bounded sample; what comes back are `features` numbers.
    return chosen, encoded.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "weights array<double>").first()["weights"]


def score(documents: DataFrame, model: tuple[list[int], list[float]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of documents: doc_id, score (0 to 1), worst_start, worst_end (characters; end exclusive) and worst_score of the sentence that offends most; null if no sentence has a feature."""
    kind = documents.schema[doc_id].dataType
    held = documents.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        features, weights = held.value
        s, w, b = Sentences(features), np.array(weights[:-1]), weights[-1]
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                found = s.of(t or "")
                if not found:
                    rows.append((0.0, None, None, None))
                    continue
                z = np.array([b + w[f].sum() for _, _, f in found])
                k = int(z.argmax())
                rows.append((round(float(-np.expm1(-np.logaddexp(0, z).sum())), 6), found[k][0], found[k][1], round(float(1 / (1 + np.exp(-z[k]))), 6)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], schema.names)

    schema = T.StructType().add("doc_id", kind).add("score", T.DoubleType()).add("worst_start", T.IntegerType()).add("worst_end", T.IntegerType()).add("worst_score", T.DoubleType())
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(task, schema)


def clean(documents: DataFrame, model: tuple[list[int], list[float]], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of documents that score below threshold, with their columns as they were."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text)

    def task(batches):
        features, weights = held.value
        s, w, b = Sentences(features), np.array(weights[:-1]), weights[-1]
        for batch in batches:
            keep = []
            for t in batch.column(at).to_pylist():
                z = [b + w[f].sum() for _, _, f in s.of(t or "")]
                keep.append(round(float(-np.expm1(-np.logaddexp(0, z).sum())), 6) < threshold if z else True)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(task, documents.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    out = score(docs, model)
    held_out, predicted = (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted")
    return out.select("doc_id", held_out, "score", predicted, "worst_start", "worst_end", "worst_score")
