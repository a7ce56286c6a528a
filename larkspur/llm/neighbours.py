"""Approximate nearest neighbours by inner product: a vantage-point tree in each shard.

Inner products are turned into distances by one more component (sqrt(M * M - |x| * |x|) for a vector x of a shard whose
longest has length M; 0 for a query), which makes the nearest the one with the largest product. A shard's vectors form a
vantage-point tree: each inner node holds the distances of its members to one of them, the half within the median on one
side. A query first goes to the side that it is nearer to; the other side is left out if the triangle inequality puts all
of it beyond ``factor`` times the query's 20th best distance so far. Factor 1 is exact search; a smaller one looks at less.

Shards are the leaves of a tree of the same kind over a bounded sample (at most SAMPLE vectors; every vector is indexed): a vector goes down to one leaf, and a
leaf that holds more than a shard is dealt further by id. Each vector moves once. Queries are what is sent to shards: the sample gives each query a first 20th
best distance, and by the ranges of the distances of a shard's members to the vantage points above it a whole shard is left out like a side of an inner node. A task
builds the tree of a shard once and lets its queries pass, a batch at a time. Equal vectors are searched as one.

Distances of vectors that have no structure (the given ones are random directions in 64 dimensions) hardly differ, so that the inequality leaves out few of
them at a factor that keeps the recall; README gives figures.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of
another length than the most frequent (of equally frequent lengths, the largest); of several rows with one id the least
vector counts; null ids take no part; a query with fewer candidates gets all of them; ties go to the smaller id; an empty table gives no rows; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.session import cut

#: Vectors of a shard, members of a leaf, vectors of the sample and those of it that make up one shard.
SHARD, LEAF, SAMPLE, EACH = 20_000, 256, 16_384, 32
FACTOR = 0.2


class Node(NamedTuple):
    low: int  # members: places low to high of the tree's order
    high: int
    vantage: int  # place of the vantage point among the vectors; -1 in a leaf
    bounds: tuple[float, float, float, float]  # least and largest distance of the near and of the far half
    near: int
    far: int


class Tree:
    """A vantage-point tree of the rows of x (with the added component)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.order, self.nodes = x, np.arange(len(x)), []
        self.norm = (x * x).sum(1)
        self.root = self.build(0, len(x), leaf)

    def build(self, low: int, high: int, leaf: int) -> int:
        if high - low <= leaf:
            self.nodes.append(Node(low, high, -1, (0, 0, 0, 0), -1, -1))
            return len(self.nodes) - 1
        members = self.order[low:high]
        # The vantage point: of a few members, the one whose distances to the others spread most.
        tried = members[:: max(1, len(members) // 8)][:8]
        some = members[:: max(1, len(members) // 400)]
        vantage = int(tried[np.argmax([self.distances(self.x[v], some).std() for v in tried])])
        d = self.distances(self.x[vantage], members)
        by = np.argsort(d, kind="stable")
        self.order[low:high], d = members[by], d[by]
        half = (high - low) // 2
        at = len(self.nodes)
        self.nodes.append(None)
        near, far = self.build(low, low + half, leaf), self.build(low + half, high, leaf)
        self.nodes[at] = Node(low, high, vantage, (d[0], d[half - 1], d[half], d[-1]), near, far)
        return at

    def distances(self, q: np.ndarray, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm[members] - 2 * (self.x[members] @ q) + q @ q, 0))

    def search(self, q: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """known: products that the k-th best of each row is known to reach. Products and places of the k best for each row of q (without the added component), best first; -inf and -1 where there are fewer. Also counts in .looked how many products were computed."""
        n, dim = q.shape
        self.best, self.place = np.full((n, k), -np.inf), np.full((n, k), -1)
        self.q, self.k, self.factor, self.looked = q, k, factor, 0
        self.known = np.full(n, -np.inf) if known is None else known
        self.length = (q * q).sum(1)
        self.shift = float(self.norm.max())  # M * M: a squared distance is |q|^2 + M^2 - 2 * product
        self.visit(self.root, np.arange(n))
        return self.best, self.place

    def visit(self, at: int, who: np.ndarray) -> None:
        node, dim = self.nodes[at], self.q.shape[1]
        if not len(who):
            return
        if node.vantage < 0:
            members = np.sort(self.order[node.low : node.high])
            p = self.q[who] @ self.x[members, :dim].T
            self.looked += p.size
            p, place = np.concatenate([self.best[who], p], 1), np.concatenate([self.place[who], np.broadcast_to(members, p.shape)], 1)
            if p.shape[1] > self.k:
                top = np.argpartition(-p, self.k - 1, 1)[:, : self.k]
                p, place = np.take_along_axis(p, top, 1), np.take_along_axis(place, top, 1)
            order = np.argsort(-p, axis=1, kind="stable")
            self.best[who], self.place[who] = np.take_along_axis(p, order, 1), np.take_along_axis(place, order, 1)
            return
        d = np.sqrt(np.maximum(self.length[who] + self.shift - 2 * (self.q[who] @ self.x[node.vantage, :dim]), 0))
        a, b, c, e = node.bounds
        first = d <= (b + c) / 2
        for side, child, other, low, high in ((first, node.near, node.far, c, e), (~first, node.far, node.near, a, b)):
            mine, dm = who[side], d[side]
            self.visit(child, mine)
            reach = np.sqrt(np.maximum(self.length[mine] + self.shift - 2 * np.maximum(self.best[mine, -1], self.known[mine]), 0))  # infinite until k are found
            gap = np.maximum(np.maximum(dm - high, low - dm), 0)
            self.visit(other, mine[gap <= self.factor * reach + 1e-9])


class Shard:
    """The vectors x of ids (ascending) and their tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.same, of = np.unique(x, axis=0, return_inverse=True)
        of = of.ravel()
        norm = (self.same * self.same).sum(1)
        self.tree = Tree(np.concatenate([self.same, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], 1))
        self.order = np.lexsort((ids, of))
        self.begin = np.searchsorted(of[self.order], np.arange(len(self.same)))
        self.many = np.bincount(of, minlength=len(self.same))

    def search(self, query_ids: np.ndarray, q: np.ndarray, known: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, ids and products of each query's k best rows, itself left out."""
        ids, x, order, begin = self.ids, self.x, self.order, self.begin
        _, place = self.tree.search(q, min(k + 1, len(self.same)), factor, known)
        size = np.minimum(self.many, k + 1)  # each distinct vector stands for its rows, the k + 1 smallest ids of them: one may be the query's own
        who, col = np.nonzero(place >= 0)
        v = place[who, col]
        n = size[v]
        row = order[np.repeat(begin[v], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        who = np.repeat(who, n)
        keep = ids[row] != query_ids[who]
        who, row = who[keep], row[keep]
        score = np.einsum("ij,ij->i", q[who], x[row])  # pair by pair, so that equal vectors have equal products
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        top = np.arange(len(who)) - np.searchsorted(who, who) < k
        return query_ids[who[top]], ids[row[top]], score[top]


class Routes:
    """The leaves of a tree over a sample, and which of them a query has to look at."""

    def __init__(self, sample_ids: np.ndarray, sample: np.ndarray, longest: float, leaves: int) -> None:
        self.ids, self.sample, self.longest = sample_ids, sample, longest
        self.steps: list[tuple[np.ndarray, float, int, int]] = []  # vantage point, split, and the steps (or ~leaf) of both sides
        self.paths: list[list[int]] = []  # the steps above each leaf
        tree = Tree(self.extended(sample), max(1, -(-len(sample) // leaves))) if len(sample) else None
        self.root = self.laid(tree, tree.root, []) if tree else ~0
        self.paths = self.paths or [[]]

    def extended(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))[:, None]], 1)

    def laid(self, tree: Tree, at: int, above: list[int]) -> int:
        node = tree.nodes[at]
        if node.vantage < 0:
            self.paths.append(above)
            return ~(len(self.paths) - 1)
        mine = len(self.steps)
        self.steps.append(None)
        near, far = self.laid(tree, node.near, [*above, mine]), self.laid(tree, node.far, [*above, mine])
        self.steps[mine] = (tree.x[node.vantage], (node.bounds[1] + node.bounds[2]) / 2, near, far)
        return mine

    def leaf(self, x: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """The leaf of each row, and its distances to the vantage points above."""
        e = self.extended(x)
        at, above = np.full(len(x), self.root), [[] for _ in x]
        while (go := at >= 0).any():
            for step in np.unique(at[go]):
                who = np.flatnonzero(at == step)
                point, split, near, far = self.steps[step]
                d = np.sqrt(((e[who] - point) ** 2).sum(1))
                at[who] = np.where(d <= split, near, far)
                for w, y in zip(who, d, strict=True):
                    above[w].append(float(y))
        return ~at, above

    def looks(self, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float, ranges: dict[int, tuple[list[float], list[float]]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The product that each query's k-th best reaches at least, and the leaves it has to look at."""
        p = q @ self.sample.T
        p[query_ids[:, None] == self.ids] = -np.inf
        known = np.partition(p, -k, 1)[:, -k] if p.shape[1] > k else np.full(len(q), -np.inf)
        reach = np.sqrt(np.maximum((q * q).sum(1) + self.longest - 2 * known, 0))
        e = np.concatenate([q, np.zeros((len(q), 1))], 1)
        away = {step: np.sqrt(((e - point) ** 2).sum(1)) for step, (point, *_) in enumerate(self.steps)}
        out = [[] for _ in q]
        for leaf, (low, high) in ranges.items():
            ok = np.ones(len(q), bool)
            for step, a, b in zip(self.paths[leaf], low, high, strict=True):
                ok &= np.maximum(np.maximum(away[step] - b, a - away[step]), 0) <= factor * reach + 1e-9
            for w in np.flatnonzero(ok):
                out[w].append(leaf)
        return known, [np.array(x, np.int64) for x in out]


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part, but for their length."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    out = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where(~F.coalesce(odd, F.lit(True)) & F.exists("embedding", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(vectors: DataFrame, is_query, k: int = 20, factor: float = FACTOR, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, each: int = EACH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each vector whose id is_query (a condition on a column of ids) holds for, among all others."""
    v = valid(vectors, vec_id, embedding)
    sizes = v.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n = (sizes["dim"], sizes["n"]) if sizes else (0, 0)
    v = v.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))  # of several rows of an id the least vector
    leaves = max(1, min(-(-n // shard), SAMPLE // each))
    part = min(1.0, leaves * each / max(1, n))
    # Driver side: at most about SAMPLE vectors, one number, and for each leaf (SAMPLE / each at most) its size and ranges.
    some = v.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 20)) < int(part * (1 << 20))).orderBy("vec_id").limit(2 * SAMPLE).collect()
    longest = v.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    routes = Routes(np.array([r["vec_id"] for r in some], np.int64), np.array([r["embedding"] for r in some], float).reshape(len(some), dim), longest, leaves)

    def placed(batches):
        for batch in batches:
            leaf, above = routes.leaf(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(above, pa.list_(pa.float64()))], ["vec_id", "embedding", "leaf", "above"])

    v = cut(v.mapInArrow(placed, "vec_id long, embedding array<double>, leaf long, above array<double>"))
    spans = v.select("leaf", F.posexplode_outer("above").alias("p", "d")).groupBy("leaf", "p").agg(F.min("d").alias("a"), F.max("d").alias("b")).orderBy("p").collect()
    ranges: dict[int, tuple[list[float], list[float]]] = {}
    for r in spans:
        low, high = ranges.setdefault(r["leaf"], ([], []))
        if r["p"] is not None:
            low.append(r["a"])
            high.append(r["b"])
    dealt = {r["leaf"]: -(-r["count"] // shard) for r in v.groupBy("leaf").count().collect()}  # shards of each leaf

    def sent(batches):
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), matrix(batch.column(1))
            for a in range(0, len(ids), 256):
                known, looks = routes.looks(ids[a : a + 256], q[a : a + 256], k, factor, ranges)
                of = np.repeat(np.arange(len(looks)), [sum(dealt[x] for x in y) for y in looks])
                to = [(int(x), s) for y in looks for x in y for s in range(dealt[x])]
                row = pa.array(a + of)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in to], pa.int64()), pa.array([s for _, s in to], pa.int32()), pa.array(np.ones(len(to), np.int32)), batch.column(0).take(row), batch.column(1).take(row), pa.array(known[of])], names)

    names = ["leaf", "part", "kind", "vec_id", "embedding", "known"]
    share = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(dealt.items()) for x in pair)), F.col("leaf")) if dealt else F.lit(1)
    candidates = v.select("leaf", F.pmod(F.xxhash64("vec_id"), share).cast("int").alias("part"), F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(0.0).alias("known"))
    queries = v.where(is_query(F.col("vec_id"))).select("vec_id", "embedding").mapInArrow(sent, "leaf long, part int, kind int, vec_id long, embedding array<double>, known double")

    def searched(batches):
        held, of, tree = [], None, None

        def built() -> Shard:
            ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(ids)
            return Shard(ids[order], x[order])

        for batch in batches:
            leaf, part, kind, ids, known = (batch.column(c).to_numpy() for c in (0, 1, 2, 3, 5))
            x = matrix(batch.column(4))
            change = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for mine in np.split(np.arange(len(ids)), change):
                if not len(mine):
                    continue
                at = (leaf[mine[0]], part[mine[0]])
                if at != of:
                    held, of, tree = [], at, None
                if kind[mine[0]] == 0:
                    held.append((ids[mine], x[mine]))
                elif held:
                    tree = tree or built()
                    found = tree.search(ids[mine], x[mine], known[mine], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], ["query_id", "vec_id", "score"])

    rows = candidates.unionByName(queries).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind")
    found = rows.mapInArrow(searched, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
