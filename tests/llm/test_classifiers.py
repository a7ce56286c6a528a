import math
import re
import zlib

import numpy as np
import pytest

from larkspur.llm import labelled, quality, toxicity
from larkspur.llm.entry import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "label", "of", "out", "least"), [("op2_toxicity", "toxic", 5, 0, 0.98), ("op6_quality", "quality", 3, 1, 0.98)])
def test_held_out_accuracy(spark, name, label, of, out, least):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert [zlib.crc32(str(i).encode()) % of == out for i in got.doc_id] == got.held_out.tolist()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.5)).all()
    y = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label).toPandas().set_index("doc_id")[label]
    x = got[got.held_out & got.doc_id.isin(y.index)]
    right = x.predicted.to_numpy() == y[x.doc_id].to_numpy()
    assert right.mean() >= least
    for k in (0, 1):
        assert right[y[x.doc_id].to_numpy() == k].mean() >= 0.85  # a few toxic documents hold only junk


ROWS = [(1, None), (2, ""), (3, " \n "), (None, "you idiot. fine words here"), (4, "x " * 100_000), (4, "x"), (5, "!!! ... ???")]


def frames(spark, n):
    docs = [(100 + i, f"some fine text number {i}. " + ("you idiot there. " if i % 2 else "") + "and more text") for i in range(n)]
    d = spark.createDataFrame([(*r, 0.5, 1) for r in ROWS + docs], "doc_id long, text string, score double, y int")
    labels = [(i, i % 2, i % 2) for i, _ in docs] + [(100, None, None), (None, 1, 1), (101, 0, 0), (102, 7, 7)]
    return d, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_edges(spark):
    docs, labels = frames(spark, 60)
    got = {(r.doc_id, r.score > 0.5) for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert {(1, False), (2, False), (3, False), (None, True), (4, False), (5, False), (101, True), (104, False)} <= got
    worst = [r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.doc_id == 101][0]
    assert "idiot" in "some fine text number 1. you idiot there. and more text"[worst.worst_start : worst.worst_end]
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_quality_edges(spark):
    docs, labels = frames(spark, 60)
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) + 60 and all(0 <= r.score <= 1 for r in got)
    share = round(float(model["y"].mean()), 6)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {share}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_neighbours_by_brute_force(spark):
    docs, labels = frames(spark, 40)
    m = quality.fit(docs, labels)
    t = quality.Terms(len(m["idf"]))
    for r in quality.score(docs, m).collect():
        pass
    text = "some fine text number 3. you idiot there. and more text"
    v = quality.weighted([t.of(text)], m["idf"])[0] @ m["directions"]
    cosine = m["vectors"] @ (v / np.linalg.norm(v))
    top = np.sort(cosine)[::-1][: quality.NEIGHBOURS]
    assert top[0] > 0.99 and len(m["y"]) == 40


def test_sample_is_bounded(spark):
    docs, labels = frames(spark, 400)
    assert 0 < labelled.sample(docs, labels, "toxic", 50).count() < 110
    assert labelled.sample(docs, labels, "toxic", 10_000).count() == 400


def test_noisy_or_learns_the_offending_instance():
    r = np.random.default_rng(0)
    doc = np.repeat(np.arange(200), 5)
    feature = r.integers(0, 30, 1000)
    y = np.bincount(doc, feature == 7, 200) > 0
    w = toxicity.trained(y.astype(float), doc, np.arange(1000), feature, 30)
    assert w[7] == w[:-1].max() and w[7] > np.sort(w[:-1])[-2] + 2


def test_wording_enters_the_quality_space(spark):
    good, bad = "The kind teacher gave a useful answer.", "The vile monster gave a stupid insult."
    t = quality.Terms(quality.TERMS)
    assert t.of(good)[0].tolist() != t.of(bad)[0].tolist() and t.of("Good, good!")[0][-1] == t.of("good")[0][-1]
    docs = spark.createDataFrame([(k, f"{good if k % 2 else bad} {k % 10}") for k in range(80)] + [(1, "again " * k) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    m = quality.fit(docs, labels)
    assert len(m["y"]) == 60, "one row of an id"
    got = {r.doc_id: r.score for r in quality.score(docs.where("doc_id >= 60"), m).collect()}
    assert all((s > 0.9) == bool(k % 2) and (s < 0.1) == (k % 2 == 0) for k, s in got.items())


def test_toxicity_scores_by_plain_loops(spark):
    """The noisy-or of the stored weights, sentence by sentence and word by word."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    features, weights = toxicity.fit(docs, labels, least=2)
    weight = dict(zip(features, weights[:-1], strict=True))
    assert weight
    want = {}
    for r in docs.select("doc_id", "text").collect():
        clean, worst = 1.0, None
        for m in re.finditer(r"[^.!?\n]+", r.text or ""):
            known = {f for w in re.findall(r"\w+", m[0].lower()) for f in toxicity.names(w)} & set(weight)
            if known:
                p = 1 / (1 + math.exp(-(weights[-1] + sum(weight[f] for f in known))))
                clean *= 1 - p
                worst = max(worst or (0.0, 0, 0), (p, -m.start(), m.end()))
        want[r.doc_id] = (1 - clean, worst)
    got = {r.doc_id: r for r in toxicity.score(docs, (features, weights)).collect()}
    assert got.keys() == want.keys() and any(w for _, w in want.values())
    for i, (s, w) in want.items():
        assert abs(got[i].score - s) < 2e-6
        assert (w is None) == (got[i].worst_start is None) and (w is None or abs(got[i].worst_score - w[0]) < 2e-6)


def test_training_lowers_the_noisy_or_loss():
    """The weights lie where the loss, written out, has no slope left to speak of in any weight."""
    r = np.random.default_rng(4)
    doc, feature = np.repeat(np.arange(120), 4), r.integers(0, 12, 480)
    y = (np.bincount(doc, feature < 2, 120) > 0).astype(float)
    y[:6] = 1 - y[:6]

    def loss(x):
        p = 1 / (1 + np.exp(-(x[-1] + x[feature])))
        clean = np.array([np.prod(1 - p[doc == k]) for k in range(120)])
        return -(y * np.log(1 - clean) + (1 - y) * np.log(clean)).sum() + 0.15 * (x[:-1] ** 2).sum()

    w = toxicity.trained(y, doc, np.arange(480), feature, 12, rounds=4000)
    start = np.append(np.zeros(12), -4.0)
    slope = lambda x: np.array([(loss(x + e) - loss(x - e)) / 2e-5 for e in 1e-5 * np.eye(13)])
    assert loss(w) < 0.5 * loss(start) and np.abs(slope(w)).max() < 0.02 * np.abs(slope(start)).max()
