import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from larkspur.llm import alignment

A = Tokenizer.from_file(alignment.BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL)
MAP = alignment.byte_of()


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(rows):
    """The contract by loops over single tokens."""
    docs, count = [], Counter()
    for _, text in rows:
        text = text or ""
        a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
        bytes_a = [bytes(MAP[c] for c in A.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        links, y = [], 0
        sa, sb = spans(bytes_a), spans(bytes_b)
        for x, (begin, end) in enumerate(sa):
            while sb[y][1] <= begin:
                y += 1
            z = y
            while z < len(sb) and sb[z][0] < end:
                links.append((a[x], b[z]))
                z += 1
        both = {e for _, e in sa} & {e for _, e in sb}
        groups = [([], []) for _ in both]
        for side, ids, s in ((0, a, sa), (1, b, sb)):
            g = 0
            for i, (_, e) in zip(ids, s, strict=True):
                groups[g][side].append(i)
                g += e in both
        docs.append((a, b, groups, links))
        count.update(set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for (k, _), (a, b, groups, links) in zip(rows, docs, strict=True):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = sha256(text.encode()).hexdigest() if a else ""
        out.append((k, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest))
    return out


def compared(df, rows):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(plain(rows), key=key)


ODD = ["", None, " ", "\n", "a", "  two  spaces ", "\n\n line\r\n\ttab", "<|endoftext|> and </s> <s> <unk>", "b▁lock", "▁", "日本語 text 😀😀", "é\0nul", "x" * 2000, " " * 500, "don't we'll I'M 123456 3.14", "ﬁ Å ½", " 　 ideographic"]


def test_query_on_given_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(x.doc_id, x.text) for x in d.select("doc_id", "text").collect()]
    df = alignment.op12(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and dict(df.dtypes)["doc_id"] == "bigint"
    compared(df, rows)


@pytest.mark.parametrize("fan,records", [(256, 1 << 21), (2, 200), (3, 20)])
def test_edges_and_levels_of_merging(spark, fan, records):
    r = random.Random(fan)
    words = ["the", "The", " of", "naïve", "tokenization", "ünder", "\n", "  ", "42", "😀", "re", "'s", "ing"]
    rows = list(enumerate(ODD)) + [(100 + k, "".join(r.choice(words) + r.choice(["", " "]) for _ in range(r.randrange(60)))) for k in range(150)]
    rows += [(None, "a null id"), (5, "twice the same"), (5, "twice the same")]
    d = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, run int, part string").repartition(5)
    compared(alignment.align(d, fan=fan, records=records), rows)


def test_empty_tables(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = alignment.align(spark.createDataFrame([("x", None), ("y", "")], "doc_id string, text string")).collect()
    assert sorted(map(tuple, got)) == [("x", 0, 0, 0, 0, 0, 0, ""), ("y", 0, 0, 0, 0, 0, 0, "")]


def test_sides_equal_their_libraries(spark):
    s = alignment.sides(open(alignment.BYTE_BPE).read(), open(alignment.MODEL, "rb").read())
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + [t for t in ODD if t]
    assert s.b.parted
    assert s.b.encode(texts) == B.encode(texts)
    assert s.a.encode(texts) == [e.ids for e in A.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_merge_and_maxima():
    r = np.random.default_rng(2)
    runs, sums = [], Counter()
    for n in (0, 1, 5, 70_000, 70_000, 40_000, 3):
        keys = np.unique(r.integers(0, 200_000, n))
        values = r.integers(1, 9, len(keys))
        sums.update(dict(zip(keys.tolist(), values.tolist(), strict=True)))
        runs.append(alignment.frames(keys, values))
    assert len(runs[3]) > 1
    steps = list(alignment.merged(runs))
    assert len(steps) > 2
    keys, values = (np.concatenate(x) for x in zip(*steps, strict=True))
    assert (np.diff(keys) > 0).all() and dict(zip(keys.tolist(), values.tolist(), strict=True)) == sums
    for width in (7, 1000, 90_000):
        keys, values = (np.concatenate(x) for x in zip(*alignment.marked(alignment.merged(runs), width), strict=True))
        s = pd.Series(sums).sort_index()
        assert (values == 2 * s.values + (s.values == s.groupby(s.index // width).transform("max").values)).all() and (keys == s.index).all()


def test_long_text(spark):
    text = "some words of a longer text, naïve and plain\n" * 4000
    rows = [(1, text), (2, "some words")]
    compared(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), records=1000), rows)
