import random
import re

import numpy as np
import pytest

from larkspur.llm import minhash, near
from larkspur.llm.components import components, forest
from larkspur.llm.units import MinHash, Spec, shingled


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    """Components by comparing all pairs."""
    s = [sets(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    post = {}
    for x, q in enumerate(s):
        for g in q:
            post.setdefault(g, []).append(x)
    for x, q in enumerate(s):
        for y in {y for g in q for y in post[g] if y > x}:
            both = len(q & s[y])
            if rows[x][0] is not None and rows[y][0] is not None and 100 * both >= percent * (len(q) + len(s[y]) - both):
                a, b = sorted((top(x), top(y)))
                label[b] = a
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[top(x)] = min(least.get(top(x), i), i)
    return sorted(((i, len(s[x]), least.get(top(x)) if i is not None else None) for x, (i, _) in enumerate(rows)), key=str)


def check(spark, rows, k=4):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = minhash.near_duplicates(df, shingle=k).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k)


def test_cases(spark):
    r = random.Random(3)
    vocab = [f"w{i}é" for i in range(400)]
    rows = [(None, "a b c d e"), (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (5, "one two"), (6, "a b c d e"), (7, "a b c d f")]
    for i in range(100, 130):
        doc = [r.choice(vocab) for _ in range(r.choice((3, 8, 30, 200)))]
        for _ in range(6):
            d = list(doc)
            for _ in range(r.randrange(1 + len(d) // 12)):
                d[r.randrange(len(d))] = r.choice(vocab)
            rows.append((len(rows) + 1000 if r.random() < 0.9 else 1000, " ".join(d)))
    rows.append((9999, "x " * 60_000))
    check(spark, rows)
    check(spark, rows[:1])


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        d = list(base)
        for _ in range(r.randrange(9)):
            d[r.randrange(60)] = f"v{r.randrange(300)}"
        rows.append((i, " ".join(d)))
    monkeypatch.setattr(near, "BLOCK_NODES", 20)
    check(spark, rows)


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = minhash.op4(spark, f"/root/testdata/{sf}").collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)


def test_signature_estimates_similarity():
    m = MinHash(6, 42)
    rng = np.random.default_rng(1)
    for n, both in ((10, 8), (30, 27), (400, 320)):
        hits = []
        for _ in range(40):
            g = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
            a, b = np.sort(g[:n]), np.sort(g[n - both :])
            sig = m.signatures(np.repeat([0, 1], n), np.concatenate([a, b]), 2)
            hits.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(hits) - both / (2 * n - both)) < 0.06


def test_components(spark):
    r = random.Random(9)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    a, b = forest(*np.array(links).T)
    want = dict(zip(a.tolist(), b.tolist()))
    assert {x.node: x.root for x in components(spark.createDataFrame(links, "src long, dst long")).collect()} == want
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_lines_of_characters():
    s = shingled(["  Abcdefghij \nxy\n\n", "abcdefghij"], Spec("line", "char", 5, 80, 4, 16))
    assert s.doc.tolist() == [0, 0, 0, 0, 1] and s.number.tolist() == [0, 1, 2, 3, 0]
    assert s.count.tolist() == [6, 1, 0, 0, 6] and s.shingle[s.owner == 0].tolist() == s.shingle[s.owner == 4].tolist()


def test_comparisons_of_a_family():
    """Nodes that are alike cost about one comparison each, and those that stay apart are compared in their buckets only."""
    r = np.random.default_rng(2)
    base = np.sort(r.integers(0, 2**63, 200).astype(np.uint64))
    sets = []
    for _ in range(1000):
        s = base.copy()
        s[r.integers(0, 200, 6)] = r.integers(0, 2**63, 6).astype(np.uint64)
        sets.append(np.unique(s))
    sets += [np.sort(r.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(200)]
    keys = near.band_keys(minhash.spec(4, 80), 0, np.repeat(np.arange(1200), [len(s) for s in sets]), np.concatenate(sets), 1200)
    label = np.arange(1200)
    a, b, compared = near.linked(sets, label, near.shared(keys, label), 80)
    assert len(np.unique(label[:1000])) == 1 and len(np.unique(label)) == 201 and len(a) <= compared < 1500


@pytest.mark.parametrize("size", [3, 7])
def test_buckets_of_several_blocks(spark, monkeypatch, size):
    """Clusters that are cut in many blocks, of nodes that chain through several confirmed components."""
    r = random.Random(size)
    rows = []
    for family in range(6):
        d = [f"f{family // 2}w{i}" for i in range(40)]
        for k in range(25):
            d = list(d)
            d[r.randrange(40)] = f"n{r.randrange(500)}"
            rows.append((len(rows), " ".join(d)))
    monkeypatch.setattr(near, "BLOCK_NODES", size)
    check(spark, rows)
