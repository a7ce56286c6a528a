import hashlib
import random

import numpy as np
import pytest

from larkspur.llm import substrings as S


def brute_force(rows: list[tuple[int | None, str | None]], length: int = S.LENGTH) -> list[tuple]:
    """The result by looking up every window."""
    least: dict[bytes, int] = {}
    data = [(S.LAST if i is None else i, (t or "").encode("utf-8", "surrogatepass")) for i, t in rows]
    for i, t in data:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            least[w] = min(least.get(w, S.LAST), i)
    out = []
    for (raw, _), (i, t) in zip(rows, data, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(np.int8)) == 1).sum() + gone[0])
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((raw, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length=50, gram=20):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in S.substring_dedup(df, length=length, gram=gram).collect()]
    assert sorted(got, key=str) == sorted(brute_force(rows, length), key=str)


def made(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(r.randrange(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(5)):
            p = r.choice(passages)
            if r.random() < 0.5:
                a = r.randrange(len(p))
                p = p[a : a + r.randrange(40, 120)]
            if r.random() < 0.3:
                k = r.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts += [p, " ".join(word() for _ in range(r.randrange(30)))]
        rows.append((r.choice([i, i, i, 5]), "".join(parts)))
    return rows


def test_made(spark, monkeypatch):
    rows = made(1, 120) + [(None, None), (None, made(2, 1)[0][1]), (7, ""), (8, "x" * 49), (9, "x" * 50), (10, "x" * 700), (11, "ab" * 500), (3, "ab" * 333), (40, "z" * 20_000 + "é" * 3000)]
    rows += [rows[0], rows[1], (1000, rows[5][1]), (1001, rows[5][1])]
    check(spark, rows)
    monkeypatch.setattr(S, "PACK", 40)
    monkeypatch.setattr(S, "BLOCK", 500)
    check(spark, rows)
    check(spark, made(3, 60), 16, 5)
    check(spark, rows[:1])


def test_empty(spark):
    assert S.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, S.op5(spark, f"/root/testdata/{sf}").collect()), key=str) == sorted(brute_force(rows), key=str)


def test_little_moves(spark):
    """The texts move once, compressed, and of a segment that nothing repeats only a part of its digit."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    size = S.op5(spark, "/root/testdata/sf0.01").agg({"n_bytes": "sum"}).first()[0]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < written() - before < 1.7 * size, (written() - before) / size


def test_digits_that_differ_in_what_does_not_move(spark, monkeypatch):
    monkeypatch.setattr(S, "SHORT", S.U(40))  # so all but 256 digits pass for the same
    check(spark, made(4, 80))
    monkeypatch.setattr(S, "DEAL", 300)
    check(spark, made(5, 60))
