import numpy as np
import pytest

from larkspur.llm import neighbours as N


def brute(ids, x, every, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = np.einsum("j,ij->i", q, x)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    want = brute(v.vec_id.to_numpy(), np.stack(v.embedding).astype(float), 20)
    got = collected(N.op3(spark, f"/root/testdata/{sf}"))
    assert got.keys() == want.keys() and all(len(got[q]) == len(w) for q, w in want.items())
    assert recall(got, want) >= 0.95
    exact = dict(x for w in want for x in [(w, dict(want[w]))])
    assert all(abs(s - exact[q][i]) < 1e-12 for q in got for i, s in got[q] if i in exact[q])


def test_factor_one_is_exact(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((900, 8)) * r.uniform(0.2, 3, (900, 1))
    x[300:420] = x[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collected(N.nearest(df, lambda i: i % 7 == 0, factor=1.0, shard=100, each=8))
    want = brute(np.arange(900), x, 7)
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    tree = N.Tree(np.concatenate([x, np.sqrt((x * x).sum(1).max() - (x * x).sum(1))[:, None]], 1), 20)
    tree.search(x[:50], 5, 1.0)
    exact = tree.looked
    tree.search(x[:50], 5, 0.3)
    assert tree.looked < exact < 50 * 900


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (9, [1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    assert collected(N.nearest(df, lambda i: i % 20 == 0)) == {0: [(20, 1.0), (1, 0.5), (2, 0.5)], 20: [(0, 1.0), (1, 1.0), (2, 1.0)]}
    assert N.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert N.nearest(df.where("vec_id = 0"), lambda i: i % 20 == 0).count() == 0


def test_shards_are_left_out():
    """Vectors in far groups: a query looks at few leaves, and at factor 1 none of its nearest is lost."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.standard_normal((200, 6)) * 0.05 + c for c in r.standard_normal((12, 6)) * 4])
    ids = np.arange(len(x))
    longest = float((x * x).sum(1).max())
    routes = N.Routes(ids[::8], x[::8], longest, 16)
    leaf, above = routes.leaf(x)
    ranges = {int(k): (np.min([above[i] for i in np.flatnonzero(leaf == k)], 0).tolist(), np.max([above[i] for i in np.flatnonzero(leaf == k)], 0).tolist()) for k in np.unique(leaf)}
    q = ids[::20]
    known, looks = routes.looks(q, x[q], 20, 1.0, ranges)
    want = brute(ids, x, 20)
    for i, w, y in zip(q, known, looks):
        assert w <= want[i][-1][1] + 1e-9 and {int(leaf[j]) for j, _ in want[i]} <= set(y.tolist())
    assert np.mean([len(y) for y in looks]) < 0.7 * len(ranges)


@pytest.mark.parametrize("dim", [16, 64])
def test_several_shards_at_the_factor_of_the_query(spark, dim):
    """Routing, leaves and shards of a leaf, on vectors without structure."""
    r = np.random.default_rng(dim)
    x = r.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = collected(N.nearest(df, lambda i: i % 20 == 0, shard=300, each=40)), brute(np.arange(4000), x, 20)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.9
