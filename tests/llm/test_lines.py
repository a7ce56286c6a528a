import random
import re

import pytest

from larkspur.llm import lines
from larkspur.llm.units import Spec, shingled


def brute(rows, spec):
    """What goes, by comparing all pairs of units; rows (id, text)."""
    docs = sorted({(lines.LAST if i is None else i, t or "") for i, t in rows})
    found = []
    for i, t in docs:
        s = shingled([t], spec)
        raw = t.encode() if spec.shingle == "word" else t
        for u, (b, e, n) in enumerate(zip(s.begin, s.end, s.count)):
            if n:
                unit = raw[b:e].decode() if spec.shingle == "word" else raw[b:e]
                unit = re.sub("[A-Z]", lambda m: m[0].lower(), unit)
                if spec.shingle == "word":
                    w = re.findall(r"[^\x20\x09-\x0D]+", unit)
                    q = {tuple(w[k : k + spec.size]) for k in range(len(w) - spec.size + 1)}
                else:
                    q = {unit[k : k + spec.size] for k in range(max(1, len(unit) - spec.size + 1))}
                assert len(q) == n
                found.append((i, t, u, q))
    label = list(range(len(found)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    post = {}
    for x, f in enumerate(found):
        for g in f[3]:
            post.setdefault(g, []).append(x)
    for x, f in enumerate(found):
        for y in {y for g in f[3] for y in post[g] if y > x}:
            both = len(f[3] & found[y][3])
            if 100 * both >= spec.percent * (len(f[3]) + len(found[y][3]) - both):
                a, b = sorted((top(x), top(y)))
                label[b] = a
    out = {d: (0, []) for d in docs}
    for x, f in enumerate(found):
        n, gone = out[f[:2]]
        out[f[:2]] = n + 1, gone + [f[2]] * (top(x) != x)
    return sorted(((i, *out[lines.LAST if i is None else i, t or ""]) for i, t in rows), key=str)


def check(spark, rows, spec):
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, removed int")
    got = sorted(((r.doc_id, r.n_units, r.removed) for r in lines.removals(df, spec).collect()), key=str)
    assert got == brute(rows, spec)


ROWS = [(None, "a shared line of some length\nown"), (1, None), (2, ""), (3, "A shared line of some length  \n\nxy\nxy"), (3, "A shared line of some length  \n\nxy\nxy"), (3, "xy\nother text under one id"), (4, "é" * 9000 + "\n" + "x y " * 3000)]


def made(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéñ") for _ in range(r.randrange(2, 9))) for _ in range(150)]
    shared = [[r.choice(vocab) for _ in range(r.choice((4, 12, 60)))] for _ in range(8)]
    rows = list(ROWS)
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            p = list(r.choice(shared)) if r.random() < 0.5 else [r.choice(vocab) for _ in range(r.randrange(1, 40))]
            if r.random() < 0.4:
                p[r.randrange(len(p))] = r.choice(vocab)
            parts.append(" ".join(p))
        rows.append((100 + i, r.choice("\n ").join(parts)))
    return rows


@pytest.mark.parametrize("spec", [lines.line_spec(), lines.paragraph_spec()])
def test_made(spark, spec):
    check(spark, made(5), spec)
    assert lines.removals(spark.createDataFrame([], "doc_id long, text string"), spec).count() == 0


def test_passage_is_found_wherever_it_stands(spark):
    r = random.Random(8)
    new = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passages = [new(55) for _ in range(40)]
    rows = [(k, f"{new(30)} {p} {new(30)}") for k, p in enumerate(passages)] + [(100 + k, f"{new(47)} {p} {new(5)}") for k, p in enumerate(passages)] + [(500 + k, new(100)) for k in range(20)]
    got = {x.doc_id: x.n_removed for x in lines.removals(spark.createDataFrame(rows, "doc_id long, text string"), lines.paragraph_spec()).collect()}
    assert sum(got[100 + k] > 0 for k in range(40)) >= 38
    assert not any(n for i, n in got.items() if i < 100 or i >= 500)


def test_texts(spark):
    df = spark.createDataFrame([(*r, "s") for r in ROWS], "doc_id long, text string, _lines string")
    got = {(r.doc_id, r.text) for r in lines.line_dedup(df).collect()}
    assert got == {(None, "own"), (1, None), (2, ""), (3, "A shared line of some length  \n\nxy"), (3, "other text under one id"), (4, ROWS[-1][1])}


@pytest.mark.parametrize("name", ["op8_lines", "op10_paragraphs"])
def test_query(spark, name):
    from larkspur.llm.entry import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(((r[0], r[1], r.removed) for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(rows, lines.line_spec() if name == "op8_lines" else lines.paragraph_spec())


def whole(rows, size=5, percent=80):
    """The lines that go, by comparing the word shingles of all pairs of lines; rows (id, text) of distinct ids."""
    found = []
    for i, t in sorted(rows):
        for u, line in enumerate(t.split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
            if w:
                found.append((i, u, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}))
    label = list(range(len(found)))
    for x, (_, _, p) in enumerate(found):
        for y in range(x):
            q = found[y][2]
            if 100 * len(p & q) >= percent * len(p | q):
                a, b = sorted((label[x], label[y]))
                label = [a if k == b else k for k in label]
    out = {i: [] for i, _ in rows}
    for x, (i, u, _) in enumerate(found):
        if label[x] != x:
            out[i].append(u)
    return out


def test_whole_paragraphs(spark):
    """A long paragraph with one word changed, and a short one, repeat an earlier one as a whole."""
    r = random.Random(3)
    new = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    a, b = new(100), new(60)
    changed = lambda w, k: " ".join([*w[:k], "changed", *w[k + 1 :]])
    rows = [(1, f"{' '.join(a)}\nTwo words\n\n{' '.join(b)}"), (2, f"{changed(a, 50)}\n two  WORDS "), (3, f"{' '.join(new(40))}\n{changed(b, 30)}\nthree other words")]
    got = {x.doc_id: x for x in lines.paragraph_removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: x.removed_paragraphs for i, x in got.items()} == {1: [], 2: [0, 1], 3: [1]} == whole(rows)
    assert [(got[i].n_paragraphs, got[i].n_removed, got[i].removed_passages) for i in (1, 2, 3)] == [(3, 0, []), (2, 2, []), (3, 1, [])]


def test_passages_stay_where_their_line_stays(spark):
    """A piece that first stands in a line that goes is kept where it stands next."""
    r = random.Random(4)
    new = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, p, z = new(300), new(30), new(100)
    rows = [(1, f"{a} {z}"), (2, f"{a} {p} {z}"), (3, f"{new(60)} {p} {new(60)}"), (4, f"{new(60)} {p} {new(60)}")]
    got = {x.doc_id: x for x in lines.paragraph_removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].removed_paragraphs for i in (1, 2, 3, 4)] == [[], [0], [], []]
    assert not got[3].removed_passages and got[3].removed and got[4].removed_passages == got[4].removed != []


def test_whole_paragraphs_of_documents(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = lines.paragraph_removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed_paragraphs for r in got} == whole(rows)
