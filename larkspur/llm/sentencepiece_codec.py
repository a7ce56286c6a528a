"""SentencePiece encoding and decoding by suffix-array matching and edge relaxation.

A vocabulary of merged pieces is applied without running merges over the text. The distinct chunks of a
block of texts are concatenated and indexed by a suffix array (no deeper than the longest piece); every
piece is found in it by binary search, which gives the range of its occurrences; these are the edges of
the block, sorted by position and relaxed from left to right. An edge (piece) continues a path only if
merging the last piece of the path and the new one alone gives these two pieces again. Exactly one path
reaches each position under that rule, and it is what merging by score gives, so the ids are those of the
SentencePiece library, while the work grows with the text and not with the square of a long word.

Edge cases: null and empty texts have no ids; characters that are not in the vocabulary become byte pieces
(or the unknown piece, if the model has no byte pieces); a text of any length is encoded whole; the lower
one-eighth block character, which stands for a space inside the model, decodes to a space, as in the
library, and is the one case in which a text does not come back exactly; null and repeated ids are rows of their own; an empty table gives
no rows; further columns are not used by ``encode`` and left as they were by ``decode``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of text that are encoded at a time, those of new chunks that are learned at a time, chunks whose ids a process remembers between
#: blocks, and pairs of pieces that it remembers beside the slots. What a process holds is in proportion to these, not to the texts it has met.
BLOCK_CHARS, LEARNED_CHARS, MEMORY, PAIRS = 1 << 19, 1 << 17, 200_000, 100_000


class Vocabulary(NamedTuple):
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str  # of each piece: n normal, b byte, c control, u unknown, x unused
    dummy_prefix: bool


def load(model: str = MODEL) -> Vocabulary:
    """Read a model file on the driver; its size is bounded by the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    if "a  b" != sp.decode(sp.encode("a  b")) or sp.normalize("ﬁ A") not in ("ﬁ A", f"{SPACE}ﬁ{SPACE}A"):
        raise ValueError("only models that leave the text as it is are handled")
    ids = range(sp.get_piece_size())
    kind = lambda i: "b" if sp.is_byte(i) else "c" if sp.is_control(i) else "u" if sp.is_unknown(i) else "x" if sp.is_unused(i) else "n"
    first = sp.id_to_piece(sp.encode("a")[0])
    return Vocabulary(tuple(map(sp.id_to_piece, ids)), tuple(map(sp.get_score, ids)), "".join(map(kind, ids)), first.startswith(SPACE))


class Codec:
    """A vocabulary made ready to encode and decode in one process."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        normal = [i for i, k in enumerate(v.kinds) if k == "n"]
        self.score = {v.pieces[i]: v.scores[i] for i in normal}
        self.id = {v.pieces[i]: i for i in normal}
        self.bytes = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == "b"}
        self.unknown = v.kinds.find("u")
        self.deep = max(map(len, self.id), default=1)
        letters = sorted({c for p in self.id for c in p})
        self.code = np.full(0x110000, 0xFFFE, np.uint16)  # 0 ends a chunk; 0xFFFE is in no piece
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        wide = -(-self.deep // 4) * 4
        keys = np.zeros((len(normal), wide), ">u2")
        for k, i in enumerate(normal):
            p = v.pieces[i]
            keys[k, : len(p)] = self.code[[ord(c) for c in p]]
        above = np.where(keys == 0, 0xFFFF, keys).astype(">u2")
        self.low, self.high = (x.view(f"S{2 * wide}").ravel() for x in (keys, above))
        self.normal, self.length = np.array(normal), np.array([len(v.pieces[i]) for i in normal])
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id)
        line = not inner and not any("\n" in p for p in self.id)
        self.chunk = re.compile(".+" if inner else " *[^ \n]+| +|\n" if line else " *[^ ]+| +", re.DOTALL)
        self.fits: dict[int, bool] = {}
        self.slots = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)
        self.forget()
        escape = lambda b: chr(b) if b < 128 else chr(0xDC00 + b)
        self.text = [escape(int(p[3:5], 16)) if k == "b" else "" if k == "c" else " ⁇ " if k == "u" else p.replace(SPACE, " ") for p, k in zip(v.pieces, v.kinds, strict=True)]

    def forget(self) -> None:
        """Begin anew with what is remembered of chunks: the number of each, and where its ids begin among all ids."""
        self.seen: dict[str, int] = {}
        self.upto, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def remember(self, chunks: list[str], n: np.ndarray, ids: np.ndarray) -> None:
        """Add chunks, the number of ids of each, and all ids to what is remembered."""
        self.seen.update(zip(chunks, range(len(self.upto) - 1, len(self.upto) - 1 + len(chunks)), strict=True))
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(n)])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def recalled(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of chunks, and all ids; all are remembered."""
        at = np.fromiter(map(self.seen.__getitem__, chunks), np.int64, len(chunks))
        begin = self.upto[at]
        n = self.upto[at + 1] - begin
        return n, self.flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging pairs, best score first, then leftmost."""
        parts, score, none = list(text), self.score, -float("inf")
        pairs = [score.get(p + q, none) for p, q in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = score.get(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = score.get(parts[k] + parts[k + 1], none)
        return parts

    def allowed(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether a path that ends in last (-1: at its start) may go on with piece."""
        key = (last.astype(np.int64) + 1) * len(self.v.pieces) + piece
        slot = (key * 0x9E3779B1) & (len(self.slots[0]) - 1)
        keys, values = self.slots
        for k in np.unique(key[keys[slot] != key]).tolist():
            known = self.fits.get(k)
            if known is None:
                p, i = divmod(k, len(self.v.pieces))
                a, b = (self.v.pieces[p - 1] if p else ""), self.v.pieces[i]
                if len(self.fits) >= PAIRS:
                    self.fits.clear()
                known = self.fits[k] = self.merged(a + b) == ([a, b] if a else [b])
            at = (k * 0x9E3779B1) & (len(keys) - 1)
            keys[at], values[at] = k, known
        out = values[slot]
        for k in np.flatnonzero(keys[slot] != key).tolist():  # two pairs of this call have one slot
            out[k] = self.fits[int(key[k])] if int(key[k]) in self.fits else self.allowed(last[k : k + 1], piece[k : k + 1])[0]
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, piece and length of all occurrences of pieces in codes."""
        wide = -(-self.deep // 4) * 4
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([codes, np.zeros(wide - 1, np.uint16)]).astype(">u2"), wide)
        windows = np.ascontiguousarray(windows)
        suffixes = np.lexsort(windows.view(">u8").astype(np.uint64).T[::-1])
        keys = windows[suffixes].view(f"S{2 * wide}").ravel()
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        start = suffixes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        return start, self.normal[which], self.length[which]

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks, which have spaces where pieces have SPACE, and remember their ids."""
        joined = np.frombuffer("\0".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        joined = np.where(joined == ord(" "), np.uint32(ord(SPACE)), joined)
        codes = self.code[joined]
        size = np.array([len(c) for c in chunks])
        ends = np.cumsum(size) + np.arange(len(chunks))
        codes[ends[:-1]] = 0
        begins = ends - size
        none = -9
        last, back = np.full(len(codes) + 1, none, np.int32), np.zeros(len(codes) + 1, np.int64)
        last[begins] = -1
        start, piece, length = self.edges(codes)
        odd = np.flatnonzero(codes == 0xFFFE)  # from these a path goes on anew
        start, piece, length = np.concatenate([start, odd]), np.concatenate([piece, np.full(len(odd), -1)]), np.concatenate([length, np.ones(len(odd), np.int64)])
        depth = start - np.repeat(begins, size + 1)[start]
        order = np.argsort(depth, kind="stable")
        start, piece, length = start[order], piece[order], length[order]
        steps = np.concatenate([[0], np.flatnonzero(np.diff(depth[order])) + 1, [len(order)]])
        for a, b in zip(steps, steps[1:], strict=False):  # all chunks at once, position by position
            s, i = start[a:b], piece[a:b]
            e = s + length[a:b]
            open_ = (last[s] != none) & (last[e] == none)
            s, i, e = s[open_], i[open_], e[open_]
            good = i < 0
            known = np.flatnonzero(~good)
            good[known] = self.allowed(last[s[known]], i[known])
            last[e[good]], back[e[good]] = i[good], s[good]
        chunk, at, found = np.arange(len(chunks)), ends, []
        while len(at):
            before = back[at]
            found.append((chunk, before, np.where(last[at] < 0, -1 - joined[before].astype(np.int64), last[at])))
            more = before > begins[chunk]
            chunk, at = chunk[more], before[more]
        chunk, at, ids = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        chunk, ids = chunk[order], ids[order]
        if (ids < 0).any():
            chunk, ids = self.spelled(chunk, ids)
        self.remember(chunks, np.bincount(chunk, minlength=len(chunks)), ids)

    def spelled(self, chunk: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces (-1 - character) as byte pieces, or as the unknown piece."""
        spell = {c: [self.bytes[x] for x in chr(-1 - c).encode("utf-8", "replace")] if self.bytes else [self.unknown] for c in np.unique(ids[ids < 0]).tolist()}
        n = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids < 0)
        n[odd] = [len(spell[c]) for c in ids[odd].tolist()]
        out = np.repeat(ids, n)
        out[np.repeat(ids < 0, n)] = list(chain.from_iterable(spell[c] for c in ids[odd].tolist()))
        return np.repeat(chunk, n), out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (and the last ends), and all ids."""
        split = [self.chunk.findall((" " if self.v.dummy_prefix else "") + t.replace(SPACE, " ")) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        distinct = set(flat)
        new = distinct.difference(self.seen)
        if len(self.seen) + len(new) > MEMORY:  # those of these texts are kept, so what is remembered is never more than MEMORY chunks and those of a block
            kept = list(distinct.difference(new))
            n, ids = self.recalled(kept)
            self.forget()
            self.remember(kept, n, ids)
        for part in blocks(sorted(new, key=len), LEARNED_CHARS):  # those of one length together, as the longest of a part decides its steps
            self.learn(part)
        n, values = self.recalled(flat)
        upto = np.concatenate([[0], np.cumsum(n)])
        return upto[np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)], values

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.text.__getitem__, ids))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


@lru_cache(1)
def codec(v: Vocabulary) -> Codec:
    return Codec(v)


def blocks(texts: Iterable[str | None], most: int = BLOCK_CHARS):
    """Consecutive texts of most characters together, or one longer text."""
    out, n = [], 0
    for t in texts:
        t = t or ""
        if out and n + len(t) > most:
            yield out
            out, n = [], 0
        out.append(t)
        n += len(t)
    if out:
        yield out


def encode(documents: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of documents: doc_id, n_tokens, ids, round_trip (whether decoding the ids gives the text again)."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(load(model))

    def task(batches):
        c = codec(held.value)
        for batch in batches:
            at = 0
            texts = batch.column(1)
            for part in blocks(chain.from_iterable(texts.slice(k, 256).to_pylist() for k in range(0, len(texts), 256))):
                starts, ids = c.encode(part)
                same = [c.decode(ids[a:b].tolist()) == t for a, b, t in zip(starts, starts[1:], part, strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)), pa.array(same)],
                    ["doc_id", "n_tokens", "ids", "round_trip"],
                )
                at += len(part)

    kind = documents.schema[doc_id].dataType
    schema = T.StructType().add("doc_id", kind).add("n_tokens", T.LongType()).add("ids", T.ArrayType(T.IntegerType())).add("round_trip", T.BooleanType())
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(task, schema)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the column out added (or replaced): the text of the ids; null ids give null."""
    held = encoded.sparkSession.sparkContext.broadcast(load(model))

    @F.pandas_udf("string")
    def text(column):
        c = codec(held.value)
        return column.map(lambda x: None if x is None else c.decode(list(x)))

    return encoded.withColumn(out, text(F.col(ids)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
