import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

from larkspur.llm import infill

MARKS = ("<P>", "<S>", "<M>")


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def written(spark, tmp_path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(map(tuple, infill.op11(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    df = infill.op11(spark, f"/root/testdata/{sf}")
    want = con.execute(infill.OP11_SQL)
    assert [d[0] for d in want.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_edges(spark, tmp_path):
    r = random.Random(5)
    odd = ["", None, "a", "é", "<", "<S", "S>", "a<P>b", "<<S<S", "P>x<", "\n\r\0  ", "ab́cD9", "😀a😀", "z" * 5000, "a1" * 3000 + "q" * 4000 + " é" * 3000]
    odd += ["".join(r.choice(["<", "P", "S", ">", "ab", "é", "😀", " ", "Zq"]) for _ in range(r.randrange(40))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(odd)] + [(None, "one two"), (7, "one two"), (7, "one two")]
    assert written(spark, tmp_path, rows) == sorted((plain(*x) for x in rows), key=str)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert written(spark, tmp_path / "e", []) == []
    rows = [(k, f"some words {k} here", "x", 1, "y", 2) for k in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, output string, n int, form string, cut int")
    got = infill.fill_in_middle(d).collect()
    assert {x.n for x in got} == {7, 8} and {x.form for x in got} == {"plain", "psm", "spm"}
    back = infill.fill_in_middle(d).select("doc_id", infill.restored(infill.F.col("output"), infill.F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back)) == [(x[0], x[1]) for x in rows]


def test_long_text_in_blocks(spark, tmp_path, monkeypatch):
    text = ("word " * 40 + "x" * 300 + "éé 9") * 20_000  # beyond one block
    assert len(text) > infill.BLOCK
    rows = [(1, "a b"), (2, text), (3, "c")]
    assert written(spark, tmp_path, rows) == sorted((plain(*x) for x in rows), key=str)


def test_index_is_bounded_and_exact(spark):
    r = np.random.default_rng(1)
    for steps in (np.ones(1, int), r.integers(1, 9, 5000), np.where(r.random(5000) < 0.01, 3000, 1), np.repeat([1, 400, 2, 90], 700), np.zeros(0, int)):
        offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
        x = infill.fit(offsets)
        ranks = np.arange(len(offsets))
        assert (np.abs(offsets - x.predict(ranks)) <= infill.REACH + 1).all()
        assert (x.at(ranks) == offsets).all()
        assert x.residual.dtype == np.int8 and len(x.residual) == len(offsets)
    steady = infill.fit(np.arange(0, 500_000, 5))
    assert len(steady.first) == 1
    d = spark.createDataFrame([(1, "ab c" * 999), (2, None)], "doc_id long, text string")
    kept = {x.doc_id: x for x in infill.rank_index(d).collect()}
    stored = infill.RankIndex(*(np.array(kept[1][c]) for c in ("first", "offset", "slope")), np.frombuffer(kept[1].residuals, np.int8))
    assert stored.at(np.array([0, 1, 2, 3, 4])).tolist() == [0, 2, 3, 6, 7] and kept[1].n == len(re.findall("[A-Za-z]+|[^A-Za-z]", "ab c" * 999)) and kept[2].n == 0


def test_query_is_registered():
    from larkspur.llm import entry

    assert "op11_fill_in_middle" in entry.QUERIES and "op11_fill_in_middle" in entry.SQL
    assert os.path.basename(infill.__file__) == "infill.py"
