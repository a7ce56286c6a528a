"""Near-duplicate classes of texts or lines: MinHash bands, candidate clusters, exact verification, components.

1. Units (whole texts, lines, pieces) with the same shingle set, or the same content, are one node, so copies cost nothing further.
2. One-permutation MinHash signatures with optimal densification are cut into bands; the band keys of a
   task's nodes are packed and dealt by key. In each bucket of equal keys every node is linked to one (a
   star), so a bucket of n gives at most n - 1 candidate links, and only a spanning forest of them leaves
   the task. The components of these links are candidate clusters: two nodes that share any band are in one.
3. The texts of one unit per node of a cluster are brought together. In each band bucket of the cluster the first node is
   compared with the others that are not yet linked to it by confirmed links, then the next (``linked``): a bucket whose
   nodes are alike costs one comparison per node, and only nodes that stay apart are compared further.
4. A cluster of more than BLOCK_NODES nodes is cut into blocks, each of which also gets the cluster's first node (its
   pivot) to compare all others with. What is left are band buckets that hold nodes of different confirmed components: in
   these, the nodes outside the component of the pivot are compared, in blocks, with all others of the bucket. So
   the texts that move are in proportion to the nodes, but for buckets in which many nodes stay apart.
5. The components of confirmed links are the classes. A link is lost only if its nodes share no band and no chain of links.

Nodes are named by 64-bit hashes, band keys have 48 bits within a bucket. Among 1e9 distinct units a wrong equality of nodes is expected
with a chance of 3 in 100; a wrong equality of band keys only means a comparison more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.components import components, forest
from larkspur.llm.session import buckets, cut
from larkspur.llm.units import ODD, MinHash, Spec, U, blocks, mix, shingled, spelled

#: Nodes, and shingles, of a cluster that are compared in one task; a larger cluster is cut into blocks. Up to FEW nodes need no bands.
BLOCK_NODES, BLOCK_SHINGLES, FEW = 2000, 2_000_000, 8
#: Band keys that a task packs at a time.
PACKED = 2_000_000
KEY_BITS = U((1 << 48) - 1)


@lru_cache(4)
def hasher(rows: int, bands: int) -> MinHash:
    return MinHash(rows, bands)


def line_text(line: str) -> Column:
    """A line without white space at its ends, whose hash names it."""
    return trimmed(F.col(line))


def trimmed(line: Column) -> Column:
    """line without white space at its ends; lines that have none are left as they are, which is cheaper than trimming them."""
    white = " \t\n\x0b\f\r"
    some = reduce(or_, [f(line, F.lit(x)) for x in white for f in (F.startswith, F.endswith)])
    return F.when(some, F.btrim(line, F.lit(white))).otherwise(line)


def units(docs: DataFrame, specs: tuple[Spec, ...], *places: str) -> DataFrame:
    """(doc_id, the columns places, kind, unit, line, node, n) of every unit of each of specs, kind being its place there; an empty one has node null and n 0. docs has doc_id (long), places and text."""
    spec = specs[0]
    if spec.unit == "line" and spec.shingle == "char":
        lines = docs.select("doc_id", *places, F.posexplode(F.split("text", "\n", -1)).alias("unit", "text")).withColumn("text", line_text("text"))
        full = F.col("text") != ""
        n = F.when(full, F.greatest(F.octet_length("text") - spec.size + 1, F.lit(1))).otherwise(0).cast("int")  # not less than its shingles; to count characters takes longer
        return lines.select("doc_id", *places, F.lit(0).alias("kind"), "unit", F.col("unit").alias("line"), F.when(full, F.xxhash64("text")).alias("node"), n.alias("n"))
    schema = T.StructType([*docs.select("doc_id", *places).schema])
    for name, kind in (("kind", T.IntegerType()), ("unit", T.IntegerType()), ("line", T.IntegerType()), ("node", T.LongType()), ("n", T.IntegerType())):
        schema = schema.add(name, kind)

    def task(batches):
        for batch in batches:
            for first, texts in blocks(batch.column(0).to_pylist()):
                spelt = spelled(texts) if specs[0].shingle == "word" else None
                for kind, spec in enumerate(specs):
                    s = shingled(texts, spec, names=True, spelt=spelt)
                    of = pa.array(first + s.doc)
                    own = (np.full(len(s.node), kind), s.number, s.line, s.count)
                    kinds, number, line, count = (pa.array(x.astype(np.int32)) for x in own)
                    yield pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns[1:]), kinds, number, line, pa.array(named(s.node, kind), mask=s.count == 0), count], schema.names)

    return docs.select("text", "doc_id", *places).mapInArrow(task, schema)


def named(node: np.ndarray, kind: int) -> np.ndarray:
    """Names of units of one of several kinds, so that equal units of different kinds are different nodes."""
    return mix(node.view(U) ^ ODD[40 + kind]).view(np.int64) if kind else node


def packed_bands(docs: DataFrame, specs: tuple[Spec, ...], groups: int) -> DataFrame:
    """(bucket, payload): the band keys of one bucket and their nodes, as bytes: 6 and 8, in planes of two bytes. A node that a task meets again is put in twice.

    The lower 48 bits of a key are enough: a bucket's share of the input is the same at any size, and different keys that agree in them only mean a comparison more.
    """

    def task(batches):
        keys, nodes, held, met, again = [], [], 0, set(), set()

        def flush():
            k, v = np.concatenate(keys), np.concatenate(nodes)
            to = (k >> U(33)) % U(groups)
            k &= KEY_BITS
            if groups <= 1 << 16:
                k |= to << U(48)
                order = np.argsort(k)
                k = k[order]
                to = k >> U(48)
                k &= KEY_BITS
            else:
                order = np.lexsort((k, to))
                k, to = k[order], to[order]
            v = v[order]
            at = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
            rows = [planes(k[a:b], 3) + planes(v[a:b], 4) for a, b in zip(at, at[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(to[at[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "payload"])

        for batch in batches:
            for _, texts in blocks(batch.column(0).to_pylist()):
                spelt = spelled(texts) if specs[0].shingle == "word" else None
                for kind, spec in enumerate(specs):
                    s = shingled(texts, spec, not spec.by_content, spelt=spelt)
                    node = named(s.node, kind)
                    distinct, one, times = np.unique(node, return_index=True, return_counts=True)
                    fresh = [x not in met for x in distinct.tolist()]
                    double = np.array([(t > 1 or not f) and x not in again for x, f, t in zip(distinct.tolist(), fresh, times.tolist(), strict=True)], bool)
                    take = np.zeros(len(node), bool)
                    take[one[np.array(fresh, bool) | double]] = True
                    take &= s.count > 0
                    if not take.any():
                        continue
                    again.update(distinct[double].tolist())
                    met.update(distinct.tolist())
                    if len(met) > 1_000_000:  # forgetting only means that a node is put in again
                        met.clear()
                        again.clear()
                    owner, shingle = s.owner, s.shingle
                    if not take.all():
                        mine = take[owner]
                        owner, shingle = (np.cumsum(take) - 1)[owner[mine]], shingle[mine]
                    k = band_keys(spec, kind, owner, shingle, int(take.sum()))
                    keys.append(k.ravel())
                    nodes.append(np.repeat(node[take], spec.bands))
                    twice = np.isin(node[take], distinct[double])
                    keys.append(k[twice, 0])
                    nodes.append(node[take][twice])
                    held += k.size
                if held >= PACKED:
                    yield flush()
                    keys, nodes, held = [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(task, "bucket int, payload binary")


def band_keys(spec: Spec, kind: int, owner: np.ndarray, shingle: np.ndarray, count: int) -> np.ndarray:
    """count x bands keys."""
    m = hasher(spec.rows, spec.bands)
    k = m.keys(m.signatures(owner, shingle, count))
    return mix(k ^ ODD[40 + kind]) if kind else k


def planes(x: np.ndarray, many: int) -> bytes:
    """The lower two-byte parts of 64-bit numbers, part by part, so that sorted ones compress."""
    return np.ascontiguousarray(x.view(np.uint16).reshape(len(x), 4)[:, :many].T).tobytes()


def unplaned(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and nodes of a payload."""
    n = len(data) // 14
    x = np.zeros((2, n, 4), np.uint16)
    parts = np.frombuffer(data, np.uint16).reshape(7, n)
    x[0, :, :3], x[1] = parts[:3].T, parts[3:].T
    return x[0].view(U).ravel(), x[1].view(np.int64).ravel()


def stars(bands: DataFrame) -> DataFrame:
    """(src, dst): a spanning forest, by bucket, of the links between nodes that share a band key; and a link to itself for each node that several units have."""

    def group(table: pa.Table) -> pa.Table:
        parts = table.column("payload").to_pylist()
        keys, nodes = map(np.concatenate, zip(*map(unplaned, parts), strict=True))
        order = np.argsort(keys)
        same = np.diff(keys[order]) == 0
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # most keys stand alone
        keys, nodes = keys[order], nodes[order]
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        same = keys[1:] == keys[:-1]
        center = nodes[np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(keys)), 0))]  # the smallest node of the bucket
        far = center != nodes
        a, b = forest(center[far], nodes[far])
        twice = np.unique(nodes[1:][same & (nodes[1:] == nodes[:-1])])
        return pa.table({"src": pa.array(np.concatenate([a, twice])), "dst": pa.array(np.concatenate([b, twice]))})

    return bands.groupBy("bucket").applyInArrow(group, "src long, dst long")


def linked(sets: list[np.ndarray], label: np.ndarray, buckets: Iterable[np.ndarray], percent: int, side: np.ndarray | None = None, pivot: int | None = None) -> tuple[list[int], list[int], int]:
    """Links a - b (places in sets) with a similarity of percent or more that join nodes of one bucket, and how many pairs were compared.

    label tells which nodes are known to be linked, and is changed. In each bucket (ascending places) a node is compared with those after it that are not
    yet linked to it, and only on the other side if side is given; so all pairs of a bucket are compared or linked by others. A pivot is compared with all.
    """
    many = [len(s) for s in sets]
    size = np.array(many)
    a, b, compared, apart, coded = [], [], 0, {}, []

    def alike(c: int, x: int) -> bool:
        at = sets[c].searchsorted(sets[x])
        both = np.count_nonzero(sets[c].take(at, mode="clip") == sets[x])
        return 100 * both >= percent * (many[c] + many[x] - both)

    def alikes(c: int, x: np.ndarray) -> np.ndarray:
        if len(x) <= FEW:
            return np.array([alike(c, y) for y in x.tolist()])
        if not coded:  # shingles by number, so that those of c can be marked
            codes, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            coded.extend((inverse, np.cumsum(size) - size, np.zeros(len(codes), bool)))
        code, begin, mark = coded
        own = code[begin[c] : begin[c] + many[c]]
        mark[own] = True
        n = size[x]
        to = np.cumsum(n) - n
        both = np.add.reduceat(mark[code[np.repeat(begin[x] - to, n) + np.arange(n.sum())]], to, dtype=np.int64)
        mark[own] = False
        return 100 * both >= percent * (n + many[c] - both)

    def pair(c: int, x: int) -> None:
        nonlocal compared
        if label[c] == label[x] or side is not None and side[c] == side[x] or 100 * min(many[c], many[x]) < percent * max(many[c], many[x]) or c in apart and apart[c][x]:
            return
        compared += 1
        if alike(c, x):
            a.append(c)
            b.append(x)
            label[label == label[x]] = label[c]
        else:
            apart.setdefault(c, np.zeros(len(sets), bool))[x] = True

    def star(c: int, x: np.ndarray) -> None:
        nonlocal compared
        x = x[label[x] != label[c]]
        if side is not None:
            x = x[side[x] != side[c]]
        x = x[100 * np.minimum(size[x], many[c]) >= percent * np.maximum(size[x], many[c])]  # sets of too different sizes are not alike
        if c in apart:
            x = x[~apart[c][x]]
        if not len(x):
            return
        hit = alikes(c, x)
        compared += len(x)
        if hit.any():
            good = x[hit]
            a.extend([c] * len(good))
            b.extend(good.tolist())
            merged = np.zeros(int(label.max()) + 1, bool)
            merged[label[good]] = True
            label[merged[label]] = label[c]
        if not hit.all():
            apart.setdefault(c, np.zeros(len(sets), bool))[x[~hit]] = True

    if pivot is not None:
        star(pivot, np.delete(np.arange(len(sets)), pivot))
    for rest in buckets:
        if len(rest) == 2:  # most buckets
            pair(*rest.tolist())
            continue
        while len(rest) > 1 and (label[rest] != label[rest[0]]).any():
            star(int(rest[0]), rest[1:])
            rest = rest[1:]
    return a, b, compared


def shared(keys: np.ndarray, label: np.ndarray) -> Iterator[np.ndarray]:
    """Of each band in turn, the places (ascending) that have the same key, if there are several and they are not all linked."""
    for band in keys.T:
        if (label == label[0]).all():
            return
        order = np.argsort(band, kind="stable")
        same = band[order]
        head = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1], [True]]))
        for x, y in zip(head, head[1:], strict=False):
            if y - x > 1:
                yield order[x:y]


def members(docs: DataFrame, specs: tuple[Spec, ...], *places: str) -> DataFrame:
    """(doc_id, places, kind, unit, line, node, n, cluster) of the units that share a band, or their whole set, with another unit. Checkpointed: later steps read it."""
    links = cut(stars(packed_bands(docs, specs, buckets(docs))))
    roots = components(links)
    all_nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).unionByName(links.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("root")))
    clusters = all_nodes.groupBy("node").agg(F.min("root").alias("cluster"))  # a node that is met twice and linked has both rows; its root is the smaller
    return cut(units(docs, specs, *places).join(clusters, "node"), free=True)


#: What rows of compared() tell: a link, a link in a cluster of several blocks, a band key (dst) of a node of such a cluster, how many pairs a task compared (dst).
LINK, PART, KEY, COUNT = 0, 1, 2, 3
#: Where a node is compared: the group, the pair of blocks of it (equal: within one), the node's own block, the smallest node that it is linked with so far, and whether the group is one of several blocks of a cluster.
PLACE = "struct<group:bigint,i:int,j:int,side:int,root:bigint,part:boolean>"


def texts(docs: DataFrame, wanted: DataFrame, specs: tuple[Spec, ...]) -> DataFrame:
    """(kind, node, to, text) of the units of wanted: doc_id, kind, unit, node, n, and to, an array of PLACE."""
    wanted = wanted.select("doc_id", F.struct("kind", "unit", "node", "to").alias("x")).groupBy("doc_id").agg(F.collect_list("x").alias("wanted"))
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("text", "wanted")
    if specs[0].unit == "line" and specs[0].shingle == "char":
        rows = rows.select(F.split("text", "\n", -1).alias("lines"), "wanted")
        line = lambda x: F.struct(x["kind"].alias("kind"), x["node"].alias("node"), x["to"].alias("to"), F.get(F.col("lines"), x["unit"]).alias("text"))
        return rows.select(F.explode(F.transform("wanted", line)).alias("x")).select("x.*").where("text IS NOT NULL")
    return rows.mapInArrow(_texts(specs), f"kind int, node long, to array<{PLACE}>, text string")


def compared(rows: DataFrame, groups: int, specs: tuple[Spec, ...]) -> DataFrame:
    """(what, src, dst) of rows of texts(), dealt into groups. A text moves once for each place."""
    rows = rows.select("kind", "node", "text", F.explode("to").alias("p")).select("kind", "node", "text", "p.*")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("group", "i", "j"), F.lit(groups)).cast("int"))
    alone = [Spec("document", *spec[1:]) for spec in specs]

    def group(table: pa.Table) -> pa.Table:
        kind, node, of, i, j, side, root, part = (table.column(c).to_numpy() for c in ("kind", "node", "group", "i", "j", "side", "root", "part"))
        order = np.lexsort((node, j, i, of, kind))
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        total = 0
        for k in np.unique(kind).tolist():
            rows = order[kind[order] == k]
            upto, shingle, good = [0], [], []
            for _, texts in blocks(table.column("text").take(pa.array(rows)).to_pylist()):
                s = shingled(texts, alone[k])
                good.append(named(s.node, k))
                shingle.append(s.shingle)
                upto += (upto[-1] + np.cumsum(s.count)).tolist()
            found, flat = np.concatenate(good), np.concatenate(shingle)
            held = np.flatnonzero(found == node[rows])  # other rows under an id need not be the unit that was meant
            at = rows[held]
            change = (np.diff(of[at]) != 0) | (np.diff(i[at]) != 0) | (np.diff(j[at]) != 0)
            once = np.concatenate([[True], change | (np.diff(node[at]) != 0)])[: len(at)]
            held, at = held[once], at[once]
            head = np.flatnonzero(np.concatenate([[True], (np.diff(of[at]) != 0) | (np.diff(i[at]) != 0) | (np.diff(j[at]) != 0)])[: len(at)])
            links: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {PART: [], LINK: []}
            for mine, at in zip(np.split(held, head[1:]), np.split(at, head[1:]), strict=True):
                if not len(at) or len(at) == 1 and not part[at[0]]:
                    continue
                name, first = node[at], at[0]
                sets = [flat[upto[x] : upto[x + 1]] for x in mine.tolist()]
                label = np.arange(len(at)) if (root[at] == name).all() else np.unique(root[at], return_inverse=True)[1]
                pivot = across = None
                if part[first] and len(own := np.flatnonzero(name == of[first])):
                    pivot = int(own[0])
                ties = [np.arange(len(at))]
                if i[first] != j[first]:
                    across = side[at]
                elif side[first] == WHOLE and (len(at) > FEW or part[first]):
                    keys = band_keys(specs[k], k, np.repeat(np.arange(len(at)), [len(x) for x in sets]), np.concatenate(sets), len(at))
                    ties = shared(keys, label)
                    if part[first]:
                        own = name != of[first] if i[first] else np.ones(len(name), bool)  # the pivot's keys come from one block
                        out.append((KEY, np.repeat(name[own], keys.shape[1]), keys[own].ravel().view(np.int64)))
                a, b, n = linked(sets, label, ties, specs[k].percent, across, pivot)
                total += n
                if a:
                    links[PART if part[first] else LINK].append((name[a], name[b]))
            for w, pairs in links.items():
                if pairs:
                    out.append((w, *forest(*map(np.concatenate, zip(*pairs, strict=True)))))
        out.append((COUNT, np.zeros(1, np.int64), np.array([total])))
        what = np.repeat([w for w, _, _ in out], [len(x) for _, x, _ in out])
        return pa.table({"what": pa.array(what.astype(np.int32)), "src": pa.array(np.concatenate([x for _, x, _ in out])), "dst": pa.array(np.concatenate([y for _, _, y in out]))})

    return rows.groupBy("bucket").applyInArrow(group, "what int, src long, dst long")


#: The side of a node that is compared by the bands of its whole block.
WHOLE = -1


def confirmed(docs: DataFrame, members: DataFrame, specs: tuple[Spec, ...]) -> DataFrame:
    """(src, dst): links between nodes that full sets confirm, enough to connect all that are linked."""
    one = members.groupBy("node").agg(F.min(F.struct("doc_id", "unit", "kind")).alias("at"), F.max("n").alias("n"), F.min("cluster").alias("cluster"))
    size = one.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).where("c > 1")
    size = cut(size.select("cluster", F.greatest(F.ceil(F.col("c") / BLOCK_NODES), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    one = one.select("at.*", "node", "cluster").join(size, "cluster")
    several = F.col("blocks") > 1
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    where = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))  # a cluster is named by its pivot
    place = lambda k: F.struct(F.col("cluster").alias("group"), k.alias("i"), k.alias("j"), F.lit(WHOLE).alias("side"), F.col("node").alias("root"), several.alias("part"))
    rows, groups = texts(docs, one.select("doc_id", "kind", "unit", "node", F.transform(where, place).alias("to")), specs), buckets(docs)
    large = not size.where("blocks > 1").isEmpty()
    if large:  # the texts are wanted again; the documents move once all the same
        rows = cut(rows, free=True)
    first = cut(compared(rows, groups, specs), free=True)
    links = first.where(F.col("what").isin(LINK, PART)).select("src", "dst")
    if not large:
        return links
    keys = first.where(F.col("what") == KEY).select(F.col("src").alias("node"), F.col("dst").alias("key"))
    # Buckets that hold nodes of several components so far: their nodes outside the component of the least node with all others.
    roots = components(first.where(F.col("what") == PART).select("src", "dst"))
    keys = keys.groupBy("node").agg(F.collect_list("key").alias("keys")).join(roots, "node", "left")  # a row for each node, not for each key
    keys = keys.select("node", F.coalesce("root", "node").alias("root"), F.explode("keys").alias("key"))
    mixed = keys.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("last"), F.count(F.lit(1)).alias("c")).where("least != last")
    keys = keys.join(mixed.select("key", "least"), "key").withColumn("far", F.col("root") != F.col("least"))
    shape = keys.groupBy("key").agg(F.ceil(F.count_if("far") / BLOCK_NODES).cast("int").alias("f"), F.ceil(F.count_if(~F.col("far")) / BLOCK_NODES).cast("int").alias("p"))
    keys = keys.join(shape, "key")
    side = F.when(F.col("far"), F.pmod(F.xxhash64("node"), F.col("f"))).otherwise(F.col("f") + F.pmod(F.xxhash64("node"), F.col("p"))).cast("int")
    keys = keys.withColumn("side", side).withColumn("others", F.sequence(F.lit(0), F.when(F.col("far"), F.col("f") + F.col("p") - 1).otherwise(F.col("f") - 1)))
    pair = lambda k: F.struct(F.col("key").alias("group"), F.least("side", k).alias("i"), F.greatest("side", k).alias("j"), F.col("side"), F.col("root"), F.lit(False).alias("part"))
    to = keys.groupBy("node").agg(F.flatten(F.collect_list(F.transform("others", pair))).alias("to"))
    second = compared(rows.drop("to").join(to, "node"), groups, specs)
    return links.unionByName(second.where(F.col("what") == LINK).select("src", "dst"))


def _texts(specs: tuple[Spec, ...]):
    """Of rows (text, wanted units), a row for each wanted unit with its own text."""

    def task(batches):
        for batch in batches:
            wanted = batch.column(1)
            size = np.diff(wanted.offsets.to_numpy())
            x = wanted.flatten()
            kind, unit, node, to = x.field("kind").to_numpy(), x.field("unit").to_numpy(), x.field("node"), x.field("to")
            upto = np.concatenate([[0], np.cumsum(size)])
            for first, texts in blocks(batch.column(0).to_pylist()):
                a, b = upto[first], upto[first + len(texts)]
                of = np.repeat(np.arange(len(texts)), size[first : first + len(texts)])
                spelt = spelled(texts) if specs[0].shingle == "word" and specs[0].unit != "document" and b > a else None
                for k, spec in enumerate(specs):
                    rows = np.flatnonzero(kind[a:b] == k)
                    if not len(rows):
                        continue
                    if spec.unit == "document":
                        out = [texts[t] for t in of[rows]]
                    else:
                        s = shingled(texts, spec, names=True, spelt=spelt)
                        head = np.searchsorted(s.doc, of[rows])
                        ok = unit[a + rows] < np.searchsorted(s.doc, of[rows], "right") - head
                        rows, head = rows[ok], head[ok]
                        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                        out = [raw[t][s.begin[u] : s.end[u]].decode("utf-8", "surrogatepass") for t, u in zip(of[rows], head + unit[a + rows], strict=True)]
                    at = pa.array(a + rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), node.take(at), to.take(at), pa.array(out, pa.string())], ["kind", "node", "to", "text"])

    return task


def classes(docs: DataFrame, specs: tuple[Spec, ...], *places: str) -> tuple[DataFrame, DataFrame]:
    """members(docs), and (node, root) of the nodes that belong to a class and are not its smallest node. doc_id is not null."""
    m = members(docs, specs, *places)
    return m, components(confirmed(docs, m, specs))


def repeats(docs: DataFrame, spec: Spec, place: str) -> DataFrame:
    """(doc_id, removed: the ascending numbers of its units that repeat an earlier one): of each class of units, the one of the least (place, doc_id, unit) stays."""
    return later(*classes(docs, (spec,), place), place)


def later(units: DataFrame, roots: DataFrame, place: str) -> DataFrame:
    """(doc_id, removed) of units (doc_id, place, unit, node) in the classes of roots: of each class, all but the one of the least (place, doc_id, unit).

    The least units are found by node and then by class, before anything is joined, and meet the others in their own document:
    so a class or a node, however large, is one row where it is joined.
    """
    least = units.groupBy("node").agg(F.min(F.struct(place, "doc_id", "unit")).alias("least")).join(roots, "node", "left")
    kept = least.groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("least").alias("least"))
    rows = units.select("doc_id", F.col("unit").alias("any"), F.lit(None).cast("int").alias("kept")).unionByName(kept.select("least.doc_id", F.lit(None).cast("int").alias("any"), F.col("least.unit").alias("kept")))
    out = rows.groupBy("doc_id").agg(F.array_except(F.collect_set("any"), F.collect_set("kept")).alias("removed"))
    return out.where(F.size("removed") > 0).select("doc_id", F.array_sort("removed").alias("removed"))
