import random
import tracemalloc

import pytest

from larkspur.llm import sentencepiece_codec as S

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    return S.Codec(S.load()), sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def ids(codec, texts):
    starts, flat = codec.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(starts, starts[1:])]


def test_as_the_library(both, spark):
    codec, sp = both
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(200).collect()
    texts = [r.text or "" for r in rows]
    texts += ["", " ", "   ", " a", "a ", "Hello  world\n\tx   ​中☃ é é ﬁ ", "aaaaaaaaaaaaaaaaaaaaaaa" * 40, "a" * 50 + "b" * 3, "\0\n\0", "𝕏🎉 emoji", " " * 37 + "x", "x" + " " * 41, "1234567890" * 9, "<s></s><unk><0x41>"]
    assert ids(codec, texts) == [sp.encode(t) for t in texts]


def test_random_strings(both):
    codec, sp = both
    r = random.Random(5)
    for alphabet in ("ab ", "the  and\n", "abcdefghijklmnopqrstuvwxyz ", "éèñßüöä enrst", "01.,:;-_/\\ ", "中文☃𝕏 a"):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(300)]
        assert ids(codec, texts) == [sp.encode(t) for t in texts]
        assert [codec.decode(x) for x in ids(codec, texts)] == texts


def test_frame(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (3, "", None), (4, "中\udb40"[:1] * 5000, "z")], "doc_id long, text string, ids string")
    out = S.encode(df).collect()
    assert [(r.doc_id, r.n_tokens > 0, r.round_trip) for r in out] == [(1, True, True), (1, True, True), (None, False, True), (3, False, True), (4, True, True)]
    assert [r.text for r in S.decode(S.encode(df)).collect()] == ["a b", "a b", "", "", "中" * 5000]
    assert S.encode(df.limit(0)).count() == 0


def test_memory_is_bounded(both, monkeypatch):
    """A process that meets ever new words holds a bounded number of them and of pairs, and needs little to learn them; frequent words are kept when others are forgotten."""
    sp, codec, r = both[1], S.Codec(S.load()), random.Random(7)
    words = lambda n: " ".join("the" if k % 3 else "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(5, 12))) for k in range(n))
    tracemalloc.start()
    try:
        peaks = []
        for n in (1, 4):  # one and four times the words
            tracemalloc.reset_peak()
            before = tracemalloc.get_traced_memory()[0]
            for part in S.blocks([words(1500) for _ in range(60 * n)]):
                codec.encode(part)
            peaks.append((tracemalloc.get_traced_memory()[1] - before) / 1e6)
    finally:
        tracemalloc.stop()
    assert max(peaks) < 130, peaks
    assert len(codec.fits) <= 100_000
    monkeypatch.setattr(S, "MEMORY", 2000)
    codec.forget()
    for _ in range(5):
        texts = [words(600) for _ in range(6)] + ["", "a▁b c", "▁"]
        assert ids(codec, texts) == [sp.encode(t) for t in texts]
        assert len(codec.seen) <= 2000
