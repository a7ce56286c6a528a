"""Quality by nearest-neighbour voting among latent-semantic vectors.

A text's terms are its words in lower case, the shapes of its words (letters by case, digits and marks as they are, whether the word before is
repeated) and pairs of neighbouring shapes, hashed, words apart from shapes. Term counts are weighted by how rare a term is among all documents
and projected on the leading singular directions of the labelled texts' matrix (latent semantic analysis). The labelled
vectors, bounded in number, are sent to every executor; every document is compared with all of them by exact blocked
cosine products, and its nearest neighbours vote with their similarity as weight.

Edge cases: null, empty and blank texts have no terms and score the share of good labels; texts of any length are scored
whole; without labels every score is 0.5; repeated rows are scored alike, and count once where they are learned from; an empty table gives no rows;
further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.labelled import remainder, sample

#: Labelled documents that are learned from at most, hashed terms (half of them of words), dimensions, voting neighbours, and the weight of words against shapes.
BOUND, TERMS, RANK, NEIGHBOURS, WORDS = 6000, 4096, 48, 15, 0.5
LETTERS = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "9"))


def shape(word: str) -> str:
    for pattern, to in LETTERS:
        word = pattern.sub(to, word)
    return word


def letters(word: str) -> str:
    return " ".join(LETTERS[0][0].findall(word.lower()))


class Terms:
    """Counts of the hashed terms of texts."""

    def __init__(self, size: int) -> None:
        self.size, self.half, self.codes = size, size // 2, {}

    def code(self, word: str) -> int:
        """Hashes of a word's shape and, in the lower half, of its letters (0: it has none)."""
        if len(self.codes) > 500_000:
            self.codes.clear()
        text = letters(word)
        c = self.codes[word] = zlib.crc32(shape(word).encode()) << 32 | (zlib.crc32(text.encode()) or 1 if text else 0)
        return c

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms (ascending) and how often each occurs."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = self.codes
        both = np.fromiter((known[w] if w in known else self.code(w) for w in words), np.uint64, len(words))
        c, w = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        again = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, len(words) - 1)
        pairs = (c[:-1] * 1_000_003 + c[1:] + 77) % (2**31 - 1)
        terms = np.concatenate([np.concatenate([c, pairs, np.full(int(again.sum()), 12345)]) % self.half, self.half + w[w > 0] % self.half])
        n = np.bincount(terms, minlength=self.size)
        at = np.flatnonzero(n)
        return at, n[at]


def frequencies(documents: DataFrame, text: str, size: int) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many have each term; over all rows, one vector a task."""

    def task(batches):
        t, df, n = Terms(size), np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                df[t.of(x or "")[0]] += 1
                df[size] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(df)], ["term", "n"])

    found = documents.select(F.col(text).cast("string")).mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1, np.int64)
    for r in found:
        df[r["term"]] = r["n"]
    return int(df[size]), df[:size]


def weighted(terms: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """A row of unit length for each text: square roots of its terms' shares, by rarity; words together weigh WORDS times what shapes do."""
    out, half = np.zeros((len(terms), len(idf)), np.float32), len(idf) // 2
    for k, (at, n) in enumerate(terms):
        edge, norm = int(np.searchsorted(at, half)), 0.0
        for x, weight in ((slice(0, edge), 1.0), (slice(edge, None), WORDS)):
            if len(at[x]):
                v = np.sqrt(n[x] / n[x].sum()) * idf[at[x]]
                out[k, at[x]] = weight * v / max(np.sqrt((v * v).sum()), 1e-12)
                norm += weight * weight
        if norm:
            out[k] /= np.sqrt(norm)
    return out


def directions(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from a fixed start."""
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((x.shape[1], min(rank + 8, x.shape[1]))).astype(np.float32))[0]
    for _ in range(8):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", bound: int = BOUND, terms: int = TERMS, rank: int = RANK) -> dict:
    """The weights of terms, the directions, and the labelled vectors with their labels. labels: (doc_id, label) of the documents to learn from."""
    total, df = frequencies(documents, "text", terms)
    idf = (np.log((1 + total) / (1 + df)) + 0.1).astype(np.float32)
    rows = sample(documents, labels, label, bound).groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")  # one row of an id, however many there are

    def encode(batches):
        t = Terms(terms)
        for batch in batches:
            found = [t.of(x or "") for x in batch.column(1).to_pylist()]
            cols = [pa.array([f[k].tolist() for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], ["doc_id", "y", "at", "n"])

    encoded = rows.mapInArrow(encode, "doc_id long, y int, at array<int>, n array<int>")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        x = weighted([(np.array(a, np.int64), np.array(n)) for a, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True)], idf)
        v = directions(x, rank)
        return pa.table({"directions": [v.astype("<f4").tobytes()], "vectors": [unit(x @ v).astype("<f4").tobytes()], "y": [table.column("y").to_numpy().astype(np.int8).tobytes()]})

    # One task, for the bounded sample; what comes back is bounded by bound, terms and rank.
    r = encoded.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "directions binary, vectors binary, y binary").first()
    if r is None:
        return {"y": np.zeros(0, np.int8)}
    v = np.frombuffer(r["directions"], "<f4").reshape(terms, -1)
    return {"idf": idf, "directions": v, "vectors": np.frombuffer(r["vectors"], "<f4").reshape(-1, v.shape[1]), "y": np.frombuffer(r["y"], np.int8)}


def score(documents: DataFrame, model: dict, neighbours: int = NEIGHBOURS, doc_id: str = "doc_id", text: str = "text", block: int = 256) -> DataFrame:
    """Per row of documents: doc_id, score (0 to 1)."""
    kind = documents.schema[doc_id].dataType
    held = documents.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        m = held.value
        y = m["y"].astype(np.float64)
        share = float(y.mean()) if len(y) else 0.5
        t = Terms(len(m["idf"])) if len(y) else None
        k = min(neighbours, len(y))
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a in range(0, len(texts), block):
                if not len(y):
                    out += [share] * len(texts[a : a + block])
                    continue
                x = unit(weighted([t.of(x or "") for x in texts[a : a + block]], m["idf"]) @ m["directions"])
                near = x @ m["vectors"].T
                at = np.argpartition(near, len(y) - k, axis=1)[:, len(y) - k :]
                w = np.maximum(np.take_along_axis(near, at, 1).astype(np.float64), 0) ** 4
                s = ((w * y[at]).sum(1) + 0.02 * share) / (w.sum(1) + 0.02)
                out += np.round(np.where((x != 0).any(1), s, share), 6).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    schema = T.StructType().add("doc_id", kind).add("score", T.DoubleType())
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(task, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    held_out, predicted = (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted")
    return score(docs, model).select("doc_id", held_out, "score", predicted)
