"""What the comparison and the signatures of near-duplicate units cost, in calls, and that they give what plain loops give."""

import cProfile
import pstats

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import lines, near, units
from larkspur.llm.units import MinHash, Spec, shingled


def sets_of(texts):
    s = shingled(texts, Spec("document", "char", 8, 80, 5, 20, True))
    return np.split(s.shingle, np.cumsum(s.count)[:-1])


def alike(a, b):
    both = len(np.intersect1d(a, b))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def some_texts(n, seed=5):
    r = np.random.default_rng(seed)
    base = ["".join(r.choice(list("abcdefgh "), 90)) for _ in range(n // 3)]
    return [base[k % len(base)][: 90 - 2 * (k // len(base))] + "xyz"[: k % 4] for k in range(n)]


def test_pairs_of_a_bucket_take_few_calls():
    sets = sets_of([f"{k:05d} " * 12 for k in range(200)])
    buckets = [np.array([a, b]) for a in range(0, 200, 2) for b in (a + 1, (a + 7) % 200) if a < b]
    p = cProfile.Profile()
    p.enable()
    _, _, compared = near.linked(sets, np.arange(200), buckets, 80)
    p.disable()
    assert compared == len(buckets) and pstats.Stats(p).total_calls < 40 * compared


@pytest.mark.parametrize("n", [3, 8, 60])
def test_links_connect_what_a_loop_over_all_pairs_connects(n):
    sets = sets_of(some_texts(n))
    pairs = [(a, b) for a in range(n) for b in range(a) if alike(sets[a], sets[b])]
    label = np.arange(n)
    a, b, _ = near.linked(sets, label, [np.arange(n)], 80)
    assert all(alike(sets[x], sets[y]) for x, y in zip(a, b, strict=True))
    assert all(label[x] == label[y] for x, y in pairs) and all((label[x] == label[y]) for x, y in zip(a, b, strict=True))
    assert len(set(label.tolist())) == n - (len(near.forest(*map(np.array, zip(*pairs, strict=True)))[0]) if pairs else 0)


@pytest.mark.parametrize(("rows", "bands"), [(3, 8), (5, 20), (5, 60)])
def test_empty_bins_take_the_first_filled_one_of_their_order(rows, bands):
    m, r = MinHash(rows, bands), np.random.Generator(np.random.PCG64(77))
    order = np.stack([r.permutation(rows * bands) for _ in range(rows * bands)], axis=1)
    count = np.array([1, 2, 5, 17, 40, 900])
    owner, shingle = np.repeat(np.arange(len(count)), count), units.mix(np.arange(count.sum(), dtype=np.uint64))
    for unit, sig in enumerate(m.signatures(owner, shingle, len(count))):
        own = {}
        for x in shingle[owner == unit].tolist():
            place = (x >> 32) * rows * bands >> 32
            own[place] = min(own.get(place, 1 << 32), x & 0xFFFFFFFF)
        assert sig.tolist() == [own[k] if k in own else own[next(c for c in order[:, k].tolist() if c in own)] for k in range(rows * bands)]


class Held:
    """Takes the function that a frame would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, task, schema):
        return task


def test_lines_and_pieces_share_the_words_of_a_block(monkeypatch):
    calls, words = [], units.words
    monkeypatch.setattr(units, "words", lambda buf: calls.append(len(buf)) or words(buf))
    task = near.packed_bands(Held(), (lines.whole_spec(), lines.paragraph_spec()), 4)
    out = list(task(iter([pa.RecordBatch.from_arrays([pa.array(["one two three four five six seven\nand so on", None, ""])], ["text"])])))
    assert len(calls) == 1 and sum(b.num_rows for b in out)


def test_lines_are_counted_and_trimmed_as_a_loop_would(spark):
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list(" \t\n\n\x0b\x0c\r\x1c\x85aé一"), r.integers(0, 12))) for _ in range(400)] + ["", "\n", "a\n\nb"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", lines.n_lines(near.F.col("text")), near.line_text("text")).collect()
    white = " \t\n\x0b\x0c\r"
    assert [(n, line) for _, n, line in got] == [(sum(x.strip(white) != "" for x in t.split("\n")), t.strip(white)) for t in texts]
