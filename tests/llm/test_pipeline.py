import re

import pytest
import test_lines
import test_minhash

import corpus_pipeline
from larkspur.llm import decontaminate, lines, minhash, toxicity

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def contaminated(texts, items, n=10):
    """Of each text: words, hit words and items, by looking up every window."""
    marks = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            marks.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(m) for m in marks}:
            for k in range(len(w) - size + 1):
                if s := marks.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= s
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score >= 0.5}
    kept = [r for r in rows if r[0] not in toxic]
    out = stages[0](spark, docs, SF)
    assert out.columns == columns and sorted((r.doc_id, r.text) for r in out.collect()) == sorted(kept) and toxic

    out = stages[1](spark, out, SF).cache()
    want = []
    for (i, n, gone), t in zip(sorted(test_lines.brute(kept, lines.line_spec()), key=lambda r: r[0]), [t for _, t in sorted(kept)]):
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or left.strip():
            want.append((i, left))
    got = out.collect()
    assert out.columns == columns and sorted((r.doc_id, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)

    out = stages[2](spark, out, SF).cache()
    least = {i: c for i, _, c in test_minhash.brute(want, 5)}
    want = [r for r in want if least[r[0]] == r[0]]
    assert out.columns == columns and sorted((r.doc_id, r.text) for r in out.collect()) == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = stages[3](spark, out, SF).cache()
    found = contaminated([t for _, t in want], items)
    assert any(h for _, h, _ in found)
    want = [r for r, (_, hit, _) in zip(want, found) if not hit]
    assert out.columns == columns and sorted((r.doc_id, r.text) for r in out.collect()) == want

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == [(i, sp.encode(t)) for i, t in want]


ROWS = [(1, None), (2, ""), (3, "One two THREE four five six seven eight nine ten eleven"), (3, "x one two three four five six seven eight nine TEN"), (None, "a,b.short item!c"), (4, "a b short"), (5, "w " * 30_000 + "one two three four five six seven eight nine ten"), (6, "éa öb one-two three four five six seven eight nine ten eleven twelve")]
ITEMS = [(7, "one two three four five six seven eight nine ten eleven"), (8, "Short item"), (9, None), (10, "..."), (7, "short item")]


@pytest.mark.parametrize("most", [2_000_000, 1])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "SLICE", most)
    full = [(*r, k, 2 * k) for k, r in enumerate(ROWS)]
    docs = spark.createDataFrame(full, "doc_id long, text string, row int, h int")
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, doc_id int")
    found = contaminated([t for _, t in ROWS], ITEMS)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs, items).collect()]
    assert sorted(got, key=str) == sorted(((i, n, h, len(x), h > 0) for (i, _), (n, h, x) in zip(ROWS, found)), key=str)
    left = decontaminate.remove(docs, items)
    assert left.columns == docs.columns and sorted(str(tuple(r)) for r in left.collect()) == sorted(str(r) for r, f in zip(full, found) if not f[1])
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate.remove(docs, items.limit(0)).count() == len(ROWS)
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, items.limit(0)).collect())


def test_many_windows(spark):
    """More windows than a plan could hold as values."""
    item = " ".join(f"w{k}" for k in range(210_000))
    rows = [(1, "w5 " + " ".join(f"w{k}" for k in range(150_000, 150_012))), (1, "w1 w2"), (1, "w1 w2"), (2, " ".join(f"w{k}" for k in range(3, 12)))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a", item), ("b", "w2")], "item_id string, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, items).collect())
    assert got == [(1, 2, 1, 1), (1, 2, 1, 1), (1, 13, 12, 1), (2, 9, 0, 0)]
    assert [tuple(r) for r in decontaminate.remove(docs, items).collect()] == [rows[3]]


def test_filters_keep_columns(spark):
    same = "the same text of some words here"
    rows = [(None, same, 1), (2, same, 2), (2, same, 3), (3, None, 4), (4, "", 5)]
    for name in ("_key", "_removed", "_row", "node"):
        docs = spark.createDataFrame([(*r, 7) for r in rows], f"doc_id long, text string, {name} int, line int")
        assert sorted(tuple(r)[2:] for r in minhash.dedup(docs).collect()) == [(2, 7), (3, 7), (4, 7), (5, 7)]
        assert sorted(tuple(r)[1:] for r in lines.line_dedup(docs).collect() if r.doc_id != 3) == [("", 5, 7), (same, 2, 7), (same, 3, 7)]
        assert sorted(tuple(r)[2:] for r in toxicity.clean(docs, ([], [0.0])).collect()) == [(k, 7) for k in range(1, 6)]
        if name in ("_key", "_row"):
            none = spark.createDataFrame([], "item_id long, text string")
            assert sorted(tuple(r)[2:] for r in decontaminate.remove(docs, none).collect()) == [(k, 7) for k in range(1, 6)]


def staged(spark, docs, tmp_path):
    """All stages on docs, each written and read again, with no benchmark but one passage and labels of other documents."""
    folder = str(tmp_path)
    spark.createDataFrame([(10_000 + k, k % 2, k % 2) for k in range(4)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b", "a passage of the benchmark that has ten words and more")], "item_id string, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.mode("overwrite").parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
    return docs


def test_whole_pipeline_on_odd_tables(spark, tmp_path):
    base = "doc_id long, text string"
    assert staged(spark, spark.createDataFrame([], f"{base}, n_chars long"), tmp_path).count() == 0
    long_text = " ".join(f"word{k}" for k in range(60))
    near = long_text.replace("word59", "other")
    rows = [(1, None), (2, ""), (None, "a text without an id"), (4, long_text), (5, near), (6, "a line\nanother line of words"), (7, "a line\nits own words"), (8, "x A passage of the benchmark that has ten words and more y")]
    clash = "_key int, _removed int, _row int, node int, unit int, cluster int, ids int, removed string, root int"
    docs = spark.createDataFrame([(*r, *range(7), "s", 9) for r in rows], f"{base}, {clash}")
    for d in (docs, docs.select("doc_id", "text")):
        got = {r.doc_id: r.ids for r in staged(spark, d, tmp_path).collect()}
        assert set(got) == {1, 2, None, 4, 6, 7} and got[1] == got[2] == [] and len(got[4]) > 60
    kept = spark.read.parquet(f"{tmp_path}/stage3")
    assert kept.columns == ["doc_id", "text"] and {r.doc_id: r.text for r in kept.collect()}[7] == "its own words"
