"""Alignment of two tokenizers over a corpus, with pair counts by external spill counting.

Each text is encoded by both sides. In the bytes of the text the ends of the tokens of either side cut it into stretches, and each
stretch is the overlap of exactly one token of A with one of B: that is a link. Places where tokens of both sides end cut the tokens
into groups.

How many documents link a pair of ids is counted externally. A task collects records (pair, document, links) of the documents it reads; when it
holds RECORDS of them they are sorted, dealt into radix partitions by the id of A, and written as one zstd-compressed run a
partition: a head (the pairs in order, and of how many documents each is) and a body (the documents and their links). Only heads move to
be counted. For each radix partition a k-way heap merge passes over the runs in the order of pairs, A's side first, and sums each pair; as
pairs of one A id follow each other, the highest sum of the id is known when the next id comes. What each run's pairs
were found to have then goes back to the run, meets its body and is added up for each document.

A merge takes at most FAN runs. More runs are merged in groups of FAN to larger runs first, level by level, and sums go back
down the same way, so a task holds FAN runs at most, and a run never more pairs than the two vocabularies have in one
radix partition: what a task holds does not grow with the corpus, and a pair that is in every document has one entry in each run.

Edge cases: texts that are null or empty, or whose tokens do not spell a space and the text (a lower one-eighth block, which B reads as a space),
have no tokens and count nothing; repeated rows and ids are documents of their own; null ids stay null; one text of any length is encoded whole, by one
task; an empty table gives no rows; further columns are not used, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.sentencepiece_codec import MODEL, SPACE, blocks
from larkspur.llm.session import cut

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: How byte-level BPE cuts a text before it merges (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Records and documents of a run, runs merged at a time, pairs compressed together, radix partitions at most, characters encoded at a time, chunks remembered by a task.
RECORDS, DOCUMENTS, FAN, FRAME, RADIX, CHARS, MEMORY = 1 << 21, 1 << 16, 256, 1 << 15, 256, 1 << 20, 300_000


# The two sides


def byte_of() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: printable Latin-1 characters for their own code, the others, in order, are moved above it."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(moved)}


class ByteLevel:
    """Side A: byte-level BPE by the vocabulary of a tokenizers file, whose special tokens are plain text here."""

    def __init__(self, file: str) -> None:
        import tiktoken

        self.file = file
        spec = json.loads(file)
        words, model, by = spec["pre_tokenizer"], spec["model"], byte_of()
        vocab = model["vocab"]
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(by[c] for c in token)
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        byte_level = words["type"] == "ByteLevel" and words.get("use_regex") and not words["add_prefix_space"] and not spec["normalizer"]
        if not byte_level or merged != sorted(merged) or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE whose ids ascend in the order of merges is handled")
        self.encoding = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})
        self.whole = None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.one(" " + t) for t in texts]

    def one(self, text: str) -> list[int]:
        try:
            return self.encoding.encode_ordinary(text)
        except ValueError:  # its pattern gave up on a very long run of white space
            if not self.whole:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_str(self.file)
                self.whole.encode_special_tokens = True
            return self.whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """Side B: a SentencePiece model. Where no piece reaches over a space or a line feed, the ids of chunks are remembered."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        names = list(map(sp.id_to_piece, range(sp.get_piece_size())))
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        plain = sp.decode(sp.encode("a  b")) == "a  b" and sp.normalize("ﬁ A") in ("ﬁ A", f"{SPACE}ﬁ{SPACE}A")
        self.feed = sp.encode("\n")
        self.parted = plain and len(self.feed) == 2 and not any("\n" in p or SPACE in p.lstrip(SPACE) for p in names)
        self.chunk = re.compile(f"[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+|\n")
        self.seen: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.parted:
            return self.sp.encode(texts, num_threads=1)
        if len(self.seen) > MEMORY:
            self.seen = {}
        split = [self.chunk.findall(" " + t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.seen, "\n"))
        self.seen["\n"] = [self.feed[1]]
        for k in range(0, len(new), 1000):
            part = new[k : k + 1000]
            ids = np.array(self.sp.encode("\n" + "\n".join(part)))
            at = np.append(np.flatnonzero(ids == self.feed[1]), len(ids))
            ids = ids.tolist()
            self.seen.update((c, ids[a + 1 : b]) for c, a, b in zip(part, at[:-1].tolist(), at[1:].tolist(), strict=True))
        return [list(chain.from_iterable(map(self.seen.__getitem__, s))) for s in split]


class Sides:
    """Both tokenizers made ready in one process."""

    def __init__(self, file: str, proto: bytes) -> None:
        self.a, self.b = ByteLevel(file), Pieces(proto)
        self.long_a, self.long_b = (np.array(list(map(len, x.bytes))) for x in (self.a, self.b))
        self.base = 2 * len(self.a.bytes)
        self.names = [b"%d%b" % (i, s) for i in range(len(self.a.bytes)) for s in (b",", b"|")] + [b"%d%b" % (i, s) for i in range(len(self.b.bytes)) for s in (b",", b";", b"")]


@lru_cache(1)
def sides(file: str, proto: bytes) -> Sides:
    return Sides(file, proto)


class Aligned(NamedTuple):
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pair: np.ndarray  # of each link: A id * size of B + B id
    doc: np.ndarray  # and which text it is in


def flags(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens end (bit 1: A, bit 2: B), what ends there, and the numbers of the tokens of A and B that the stretch before lies in."""
    at = np.flatnonzero(mark)
    what = mark[at]
    a, b = what & 1, what >> 1
    return at, what, np.cumsum(a, dtype=np.int64) - a, np.cumsum(b, dtype=np.int64) - b


def aligned(texts: list[str], s: Sides) -> Aligned:
    a, b = s.a.encode(texts), s.b.encode(texts)
    size = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        raw = b" " + t.encode()
        if t and b"".join(map(s.a.bytes.__getitem__, a[k])) == raw == b"".join(map(s.b.bytes.__getitem__, b[k])):
            size[k] = len(raw)
        else:
            a[k] = b[k] = []
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (a, b))
    ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
    del a, b
    mark = np.zeros(size.sum() + 1, np.uint8)
    mark[np.cumsum(s.long_a[ids_a])] = 1
    mark[np.cumsum(s.long_b[ids_b])] |= 2
    at, what, in_a, in_b = flags(mark)
    del mark
    links = np.diff(np.searchsorted(at, np.append(0, np.cumsum(size)), "right"))
    doc = np.repeat(np.arange(len(texts)), links)
    pair = ids_a[in_a] * len(s.b.bytes) + ids_b[in_b]
    ends = np.flatnonzero(what == 3)
    groups = np.bincount(doc[ends], minlength=len(texts))
    upto_a, upto_b = in_a[ends] + 1, in_b[ends] + 1  # tokens of all groups so far
    own_a, own_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    code_a, code_b = 2 * ids_a, s.base + 3 * ids_b
    code_a[upto_a - 1] += 1
    code_b[upto_b - 1] += 1
    code_b[upto_b[np.cumsum(groups)[groups > 0] - 1] - 1] += 1
    code[np.arange(len(ids_a)) + np.repeat(upto_b - own_b, own_a)] = code_a
    code[np.arange(len(ids_b)) + np.repeat(upto_a, own_b)] = code_b
    parts = list(map(s.names.__getitem__, code.tolist()))
    upto, hashed = np.append(0, np.cumsum(n_a + n_b)).tolist(), []
    for x, y in zip(upto, upto[1:], strict=False):
        hashed.append(sha256(b"".join(parts[x:y])).hexdigest() if y > x else "")
    return Aligned(n_a, n_b, groups, links, hashed, pair, doc)


# Runs


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes, the bytes of equal weight together, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns))


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def frames(keys: np.ndarray, values: np.ndarray) -> list[bytes]:
    """A run of ascending keys with a value each, in frames that are unpacked one at a time."""
    return [packed(np.diff(keys[k : k + FRAME], prepend=0).astype(np.int64), values[k : k + FRAME].astype(np.int64)) for k in range(0, len(keys), FRAME)]


def opened(run: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for frame in run:
        steps, values = unpacked(frame, np.int64, np.int64)
        yield np.cumsum(steps), values


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of all runs, ascending, with the sum of their values: a k-way merge with one frame of each run in hand.

    One heap has the first key in hand of each run, one the last: up to the least last key, what is in hand is complete.
    """
    left = [opened(r) for r in runs]
    hand: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    first: list[tuple[int, int]] = []
    last: list[tuple[int, int]] = []

    def load(r: int) -> None:
        if (x := next(left[r], None)) is not None:
            hand[r] = x
            heapq.heappush(first, (int(x[0][0]), r))
            heapq.heappush(last, (int(x[0][-1]), r))

    for r in range(len(runs)):
        load(r)
    while first:
        bound = last[0][0]
        taken = []
        while first and first[0][0] <= bound:
            r = heapq.heappop(first)[1]
            keys, values = hand[r]
            n = int(np.searchsorted(keys, bound, "right"))
            taken.append((keys[:n], values[:n]))
            if n < len(keys):
                hand[r] = keys[n:], values[n:]
                heapq.heappush(first, (int(keys[n]), r))
        ended = []
        while last and last[0][0] == bound:
            ended.append(heapq.heappop(last)[1])
        for r in ended:
            load(r)
        keys, values = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield keys[begin], np.add.reduceat(values, begin)


def marked(sums: Iterator[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys with twice their sum, and 1 more where it is the highest of its A id: side-major order brings the keys of an id together, and an id that may go on is held back."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in chain(sums, [None]):
        keys, n = held if x is None else map(np.concatenate, zip(held, x, strict=True))
        if not len(keys):
            continue
        side = keys // width
        to = len(keys) if x is None else int(np.searchsorted(side, side[-1]))
        held = keys[to:], n[to:]
        keys, n, side = keys[:to], n[:to], side[:to]
        if to:
            begin = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
            best = np.repeat(np.maximum.reduceat(n, begin), np.diff(np.append(begin, to)))
            yield keys, 2 * n + (n == best)


HEAD = pa.list_(pa.binary())
TOTALS = T.StructType().add("run", T.LongType()).add("part", T.IntegerType()).add("total", T.ArrayType(T.BinaryType()))


def rows(run: list[int], part: int, data: list[list[bytes]], name: str) -> pa.Table:
    return pa.table({"run": pa.array(run, pa.int64()), "part": pa.array([part] * len(run), pa.int32()), name: pa.array(data, HEAD)})


def answered(table: pa.Table, keys: np.ndarray, values: np.ndarray) -> pa.Table:
    """For each run of table, its keys with their values."""
    out = []
    for run in table["head"].to_pylist():
        own = np.concatenate([k for k, _ in opened(run)])
        out.append(frames(own, values[np.searchsorted(keys, own)]))
    return rows(table["run"].to_pylist(), table["part"][0].as_py() if len(table) else 0, out, "total")


def totals(runs: DataFrame, width: int, fan: int = FAN) -> DataFrame:
    """For rows (run, part, head: pairs ascending, with a number each) the same with total: twice the sum of the pair's numbers over all runs, and 1 more if that is the highest of its A id. part must follow from the A id (pair // width)."""
    n = runs.select("run").distinct().count()
    levels = [runs.select("run", "part", "head")]

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        keys, values = (np.concatenate(x) for x in zip(*merged(table["head"].to_pylist()), strict=True))
        return rows([key[1].as_py()], key[0].as_py(), [frames(keys, values)], "head")

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        keys, values = (np.concatenate(x) for x in zip(*marked(merged(table["head"].to_pylist()), width), strict=True))
        return answered(table, keys, values)

    def descend(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        if not len(table):
            return rows([], 0, [], "total")
        keys, values = (np.concatenate(x) for x in zip(*opened(above["total"][0].as_py()), strict=True))
        return answered(table, keys, values)

    while n > fan:
        n = -(-n // fan)
        levels[-1] = levels[-1].withColumn("up", F.pmod(F.xxhash64("run"), F.lit(n)))
        levels.append(cut(levels[-1].groupBy("part", "up").applyInArrow(fold, "run long, part int, head array<binary>")))
    out = levels.pop().groupBy("part").applyInArrow(finish, TOTALS)
    while levels:
        below = levels.pop()
        out = below.groupBy("part", "up").cogroup(out.withColumnRenamed("run", "up").groupBy("part", "up")).applyInArrow(descend, TOTALS)
    return out


# The operator

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def encoded(documents: DataFrame, file: str, proto: bytes, parts: int, doc_id: str, text: str, records: int = RECORDS) -> DataFrame:
    """Rows of documents (run, doc, doc_id, counts, groups_sha256) and of runs (run, part, head, body)."""
    spark, kind = documents.sparkSession, documents.schema[doc_id].dataType
    held = spark.sparkContext.broadcast((file, proto))
    schema = T.StructType().add("run", T.LongType()).add("part", T.IntegerType()).add("head", T.ArrayType(T.BinaryType())).add("body", T.BinaryType()).add("doc", T.IntegerType()).add("doc_id", kind)
    for c in COUNTS:
        schema.add(c, T.LongType())
    schema.add("groups_sha256", T.StringType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        s = sides(*held.value)
        width = len(s.b.bytes)
        arrow = to_arrow_schema(schema)
        run, docs, size, kept = TaskContext.get().partitionId() << 32, 0, 0, []

        def batch_of(n: int, **columns) -> pa.RecordBatch:
            given = {k: v if isinstance(v, pa.Array) else pa.array(v, arrow.field(k).type) for k, v in columns.items()}
            return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        def spilled() -> Iterator[pa.RecordBatch]:
            key = np.sort(np.concatenate(kept))
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            links, key = np.diff(np.append(begin, len(key))), key[begin]
            pair, doc = (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.uint16)
            part = pair // width % parts
            order = np.argsort(part, kind="stable")
            pair, doc, links = pair[order], doc[order], links[order]
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edge)).tolist():
                x = slice(edge[p], edge[p + 1])
                own = pair[x]
                begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                yield batch_of(1, run=[run], part=[p], head=[frames(own[begin], np.diff(np.append(begin, len(own))))], body=[packed(doc[x], links[x].astype(np.uint32))])

        for batch in batches:
            at = 0
            for block in blocks(batch.column(1).to_pylist(), CHARS):
                for k in range(0, len(block), DOCUMENTS):
                    texts = block[k : k + DOCUMENTS]
                    if size > records or docs + len(texts) > DOCUMENTS:
                        if kept:
                            yield from spilled()
                        run, docs, size, kept = run + 1, 0, 0, []
                    x = aligned(texts, s)
                    if len(x.pair):
                        kept.append(x.pair.astype(np.uint64) << np.uint64(16) | (x.doc + docs).astype(np.uint64))
                    size += len(x.pair)
                    n = len(texts)
                    yield batch_of(n, run=[run] * n, doc=np.arange(docs, docs + n), doc_id=batch.column(0).slice(at, n), groups_sha256=x.groups, **{c: getattr(x, c) for c in COUNTS})
                    docs, at = docs + n, at + n
        if kept:
            yield from spilled()

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(task, schema)


def align(documents: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = MODEL, doc_id: str = "doc_id", text: str = "text", fan: int = FAN, records: int = RECORDS) -> DataFrame:
    """Per row of documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as any pair of its A id), count_sum (of the documents of each link's pair, over links), groups_sha256.

    byte_bpe and pieces are the vocabulary files of the two sides, read on the driver.
    """
    spark = documents.sparkSession
    with open(byte_bpe, encoding="utf-8") as f:
        file = f.read()
    with open(pieces, "rb") as f:
        proto = f.read()
    width = len(sides(file, proto).b.bytes)
    parts = min(RADIX, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    e = cut(encoded(documents, file, proto, parts, doc_id, text, records))
    found = totals(e.where("part is not null"), width, fan)
    kind = e.schema["doc_id"].dataType
    schema = T.StructType().add("doc_id", kind)
    for c in (*COUNTS, "n_best", "count_sum"):
        schema.add(c, T.LongType())
    schema.add("groups_sha256", T.StringType())

    def summed(key: tuple, own: pa.Table, back: pa.Table) -> pa.Table:
        """One run: what its pairs were found to have, added up for each document."""
        docs = own.filter(pc.is_null(own["part"]))
        best, total = np.zeros((2, len(docs)), np.int64)
        answer = dict(zip(back["part"].to_pylist(), back["total"], strict=True))
        runs = own.filter(pc.is_valid(own["part"])).select(["part", "head", "body"])
        for part, head, body in zip(*runs.columns, strict=True):
            n = np.concatenate([v for _, v in opened(head.as_py())])
            values = np.repeat(np.concatenate([v for _, v in opened(answer[part.as_py()].as_py())]), n)
            doc, links = unpacked(body.as_py(), np.uint16, np.uint32)
            np.add.at(best, doc, (values & 1) * links)
            np.add.at(total, doc, (values >> 1) * links)
        at = docs["doc"].to_numpy()
        columns = [docs["doc_id"], *(docs[c] for c in COUNTS), pa.array(best[at]), pa.array(total[at]), docs["groups_sha256"]]
        return pa.Table.from_arrays(columns, names=schema.names)

    return e.groupBy("run").cogroup(found.groupBy("run")).applyInArrow(summed, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("doc_id", F.col("doc_id").cast("long"))
