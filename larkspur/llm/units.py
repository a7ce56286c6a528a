"""Word and character shingles of whole texts or of their lines, for a block of texts at a time, in numpy.

Hashes are 64 bits; equal content has equal hashes in every process.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash

U = np.uint64
_R = np.random.Generator(np.random.PCG64(20240229))
BYTE = _R.integers(0, 2**64, 256, dtype=U)
ODD = _R.integers(0, 2**64, 64, dtype=U) | U(1)
BASE = 0x9E3779B97F4A7C15 | 5
LETTER = BYTE.copy()  # of a byte, A-Z as a-z
LETTER[65:91] = BYTE[97:123]
WHITE = " \t\n\x0b\x0c\r"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLOCK_CHARS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: list[np.ndarray] = [np.zeros(0, U), np.zeros(0, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n or further."""
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        up, down = np.full(size, BASE, U), np.full(size, pow(BASE, -1, 2**64), U)
        up[0] = down[0] = 1
        _powers[:] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0], _powers[1]


class Spec(NamedTuple):
    """What is compared: unit ('document', 'line', or 'piece': a part of a line that is cut at places its words decide), shingles of size words or characters ('word' or 'char'), the least similarity in percent, and MinHash rows and bands. Pieces of fewer words than a shingle are left out."""

    unit: str
    shingle: str
    size: int
    percent: int
    rows: int
    bands: int
    by_content: bool = False  # whether units with equal sets but other content are different nodes, which saves sorting


class Shingled(NamedTuple):
    doc: np.ndarray  # of each unit: its text's place in the block
    number: np.ndarray  # and its place in that text (0, or the line's number)
    count: np.ndarray  # size of its set; 0 if it is empty
    node: np.ndarray  # hash of its set
    begin: np.ndarray  # its first and last word's or character's place in its text, in bytes (word) or characters (char); end exclusive
    end: np.ndarray
    owner: np.ndarray  # of each shingle: its unit; ascending
    shingle: np.ndarray  # distinct within the unit, ascending
    line: np.ndarray  # of each unit: the number of its line in its text (0 for a document)


def blocks(texts: list[str | None], most: int = BLOCK_CHARS):
    """(first, texts) of consecutive texts of most characters together, or one longer text; null is empty."""
    first, out, n = 0, [], 0
    for k, t in enumerate(texts):
        t = t or ""
        if out and n + len(t) > most:
            yield first, out
            first, out, n = k, [], 0
        out.append(t)
        n += len(t)
    if out:
        yield first, out


def cuts(h: np.ndarray, line: np.ndarray, reach: int = 5) -> np.ndarray:
    """Where pieces begin: at a line's first word, and before a word whose hash with the next word's is less than those of the reach words before and after it in the line.

    So the same run of words is cut at the same places wherever it stands, but for reach words at its ends, and pieces have 6 words or more.
    """
    n = len(h)
    first = np.concatenate([[True], line[1:] != line[:-1]]) if n else np.zeros(0, bool)
    pair = h.copy()
    pair[:-1] += np.where(line[1:] == line[:-1], h[1:] * ODD[55], U(0))
    pair = mix(pair)
    low = np.ones(n, bool)
    for d in range(1, reach + 1):
        same = line[d:] == line[:-d]
        low[:-d] &= ~same | (pair[:-d] < pair[d:])
        low[d:] &= same & (pair[d:] < pair[:-d])  # a line's first words are no cuts: its first piece would be too short
    low[:reach] = low[max(0, n - reach) :] = False
    if n > reach:
        low[:-reach] &= line[reach:] == line[:-reach]
    return first | low


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of buf (bytes), A-Z as a-z."""
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(LETTER[buf] * up[: len(buf)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start])


class Words(NamedTuple):
    begin: np.ndarray  # where each text of a block begins in it, in bytes
    lines: np.ndarray  # where each line begins
    at: np.ndarray  # start, end and hash of each word
    till: np.ndarray
    hash: np.ndarray


def spelled(texts: list[str]) -> Words:
    """The words of a block of texts, for all specs that compare words."""
    size = np.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
    buf = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    return Words(np.cumsum(size + 1) - size - 1, np.concatenate([[0], np.flatnonzero(buf == 10) + 1]).astype(np.int64), *words(buf))


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """The sum of h[i + j] * BASE**j for j below size, at every i where size elements follow, put together from runs of 1, 2, 4, ... elements."""
    out, done, run, n = np.zeros(0, U), 0, h, 1
    if len(h) < size:
        return out
    while True:
        if size & n:
            many = len(h) - done - n + 1
            out = out[:many] + run[done : done + many] * U(pow(BASE, done, 2**64)) if done else run
            done += n
        if 2 * n > size:
            return out
        run = run[:-n] + run[n:] * U(pow(BASE, n, 2**64))
        n *= 2


def windows(h: np.ndarray, owner: np.ndarray, n_units: int, size: int, by_content: bool, names: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and hash of each run of size elements of one owner (an owner with fewer, but not none, has one run of all); and, by_content, a hash of all elements of each owner. With names, only that hash."""
    n = np.bincount(owner, minlength=n_units)
    first = np.cumsum(n) - n
    node = np.zeros(n_units, U)
    if by_content:
        up, down = powers(len(h) + 1)
        total = np.zeros(len(h) + 1, U)
        np.cumsum(h * up[: len(h)], out=total[1:])
        node = mix((total[first + n] - total[first]) * down[first] + n.astype(U) * ODD[54])
    if names:
        return np.zeros(0, np.int64), np.zeros(0, U), node
    full = max(0, len(h) - size + 1)
    inside = owner[:full] == owner[size - 1 :] if full else np.zeros(0, bool)
    o, s = owner[:full][inside], rolled(h, size)[inside]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        many = n[short]
        begin = np.cumsum(many) - many
        place = np.arange(many.sum()) - np.repeat(begin, many)
        whole = np.add.reduceat(h[np.repeat(first[short], many) + place] * powers(size)[0][place], begin)
        o, s = np.concatenate([o, short]), np.concatenate([s, whole + many.astype(U) * ODD[60]])
    return o, mix(s), node


def sort_sets(o: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and shingles by owner, each owner's shingles ascending and distinct."""
    if len(o) and (o[1:] < o[:-1]).any():
        order = np.argsort(o, kind="stable")
        o, s = o[order], s[order]
    if not len(o):
        return o, s
    head = np.append(np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])), len(o))
    if len(o) > 16 * len(head):
        s = s.copy()
        edge = head.tolist()
        for a, b in zip(edge, edge[1:], strict=False):
            s[a:b].sort()
    else:
        order = np.lexsort((s, o))
        s = s[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])
    return (o, s) if new.all() else (o[new], s[new])


def line_nodes(lines: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for near.line_text(): XXH64 of lines that have no white space at their ends."""
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in lines), U, len(lines))


def shingled(texts: list[str], spec: Spec, sets: bool = True, names: bool = False, spelt: Words | None = None) -> Shingled:
    """The shingle sets of the units of texts; not sets: in any order and with repeats; names: without shingles, if nodes are by content; spelt: spelled(texts), if it is known."""
    clean: list[str] = []
    if spec.shingle == "word":
        begin, lines, at, till, h = spelt or spelled(texts)
        if spec.unit != "document":
            doc = np.searchsorted(begin, lines, "right") - 1
            number, starts = np.arange(len(lines)) - np.searchsorted(lines, begin)[doc], lines
        else:
            doc, number, starts = np.arange(len(texts)), np.zeros(len(texts), np.int64), begin
        line_number = number
        inner = np.diff(np.append(np.searchsorted(at, starts), len(at)))
        if spec.unit == "piece":
            line = np.repeat(np.arange(len(starts)), inner)
            at_cut = np.flatnonzero(cuts(h, line))
            doc, line_number = doc[line[at_cut]], number[line[at_cut]]
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            inner = np.diff(np.append(at_cut, len(at)))
        n = len(doc)
        left, right, has = np.zeros(n, np.int64), np.zeros(n, np.int64), inner > 0
        f = (np.cumsum(inner) - inner)[has]
        left[has], right[has] = at[f] - begin[doc[has]], till[f + inner[has] - 1] - begin[doc[has]]
    else:
        # Characters of a line, without white space at either end; runs of them are what is compared.
        parts = [t.split("\n") for t in texts] if spec.unit != "document" else [[t] for t in texts]
        many = np.array([len(x) for x in parts], np.int64)
        doc, n = np.repeat(np.arange(len(texts)), many), int(many.sum())
        number = np.arange(n) - np.repeat(np.cumsum(many) - many, many)
        line_number = number
        raw = [x for part in parts for x in part]
        clean = [t.strip(WHITE) for t in raw]
        size, inner = (np.fromiter(map(len, x), np.int64, n) for x in (raw, clean))
        lead = np.array([len(t) - len(t.lstrip(WHITE)) if len(t) > len(c) > 0 else 0 for t, c in zip(raw, clean, strict=True)], np.int64)
        start = np.cumsum(size + 1) - size - 1
        left = np.where(inner > 0, start - start[(np.cumsum(many) - many)[doc]] + lead, 0)
        right = left + inner
        low = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = low + ((low - np.uint32(65) < 26).view(np.uint8) << np.uint8(5))
        h = low.astype(U)
        h += U(1)
        h *= ODD[59]
    owner = np.repeat(np.arange(n), inner)
    if spec.unit == "piece":
        enough = (inner >= spec.size)[owner]
        owner, h = owner[enough], h[enough]
    names = names and spec.by_content
    length = np.bincount(owner, minlength=n)
    o, s, node = windows(h, owner, n, spec.size, spec.by_content and spec.shingle == "word", names)
    if sets and not names:
        o, s = sort_sets(o, s)
    count = np.bincount(o, minlength=n) if sets and not names else np.where(length > 0, np.maximum(length - spec.size + 1, 1), 0)
    has = count > 0
    if spec.shingle == "char":
        node = np.where(has, line_nodes(clean), U(0))
    elif not spec.by_content and has.any():
        node[has] = mix(np.add.reduceat(mix(s + ODD[58]), (np.cumsum(count) - count)[has]) + count[has].astype(U))
    return Shingled(doc, number, count, node.view(np.int64), left, right, o, s, line_number)


class MinHash:
    """One-permutation MinHash with optimal densification: every empty bin takes the value of the first filled bin in an order of its own."""

    def __init__(self, rows: int, bands: int) -> None:
        self.rows, self.bands, self.bins = rows, bands, rows * bands
        r = np.random.Generator(np.random.PCG64(77))
        order = np.stack([r.permutation(self.bins) for _ in range(self.bins)], axis=1)  # [attempt, bin]
        rank = np.argsort(order, axis=0).T + 1  # [bin, other]: when bin tries other, after itself
        np.fill_diagonal(rank, 0)
        self.shift = 8 if self.bins < 255 else 16
        kind = np.uint16 if self.bins < 255 else np.uint32
        code = (rank << self.shift | np.arange(self.bins)).astype(kind)  # the least of the filled ones is what a bin takes
        held = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
        self.least = []  # for every eight bins: of each set of them, the least code for each bin
        for k in range(0, self.bins, 8):
            part = code[:, k : k + 8]
            self.least.append(np.where(held[:, None, : part.shape[1]], part, np.iinfo(kind).max).min(2))

    def signatures(self, owner: np.ndarray, shingle: np.ndarray, units: int) -> np.ndarray:
        """units x bins; owner counts from 0 and every unit has a shingle."""
        none = np.uint32(0xFFFFFFFF)
        place = shingle >> U(32)  # already mixed
        place *= U(self.bins)
        place >>= U(32)
        at = place.view(np.int64)
        at += owner * self.bins
        low = shingle.astype(np.uint32)
        np.minimum(low, none - np.uint32(1), out=low)
        sig = np.full(units * self.bins, none, np.uint32)
        np.minimum.at(sig, at, low)
        sig = sig.reshape(units, self.bins)
        full = sig != none
        rows = np.flatnonzero(~full.all(1))
        if len(rows):
            bits = np.packbits(full[rows], axis=1, bitorder="little")
            best = self.least[0][bits[:, 0]]
            for k in range(1, len(self.least)):
                np.minimum(best, self.least[k][bits[:, k]], out=best)
            source = (best & best.dtype.type((1 << self.shift) - 1)).astype(np.int64)
            source += (rows * self.bins)[:, None]
            sig[rows] = sig.ravel()[source]
        return sig

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """units x bands: a hash of each band."""
        s = sig.reshape(len(sig), self.bands, self.rows)
        k = np.arange(self.bands, dtype=U) * ODD[56]
        for row in range(self.rows):
            k = k + s[:, :, row] * ODD[row]
        return mix(k)
