"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that also starts in an earlier document.

Sorting the suffixes of all positions, even through only 50 bytes, would move the text many times over. So the
first pass of the radix sort is done on a digit that is the same for equal windows but common to runs of
neighbours: the least hash of the ``gram``-byte strings inside the window. Neighbouring windows with the same
least hash form a segment, of about 16 windows, and only segments are moved:

1. The texts are dealt into groups of documents once, packed and compressed, for all passes. Each group cuts its texts
   into segments and deals its digits, each once and in order, so that about three bytes of each move; it is told
   which of them another document has too. None of the windows of the other segments repeats.
2. Segments with these digits are dealt by digit, with a hash of their bytes: equal segments, the bulk of copied text,
   are decided at once, all but those of the earliest document.
3. Where different segments share a digit, the bytes of one of each are fetched from the documents and their windows
   sorted by most-significant-digit passes of eight bytes, each pass on the groups of the pass before that still have
   two members, until all 50 bytes are used. Equal groups are exactly the repeated windows.
4. The windows to remove go back to their documents, which are cut.

A digit or segment that very many documents share is reduced to one entry by each group of documents before it is
dealt, so what one digit's group gets grows with the number of groups and not with the documents.

Edge cases: null and empty texts have no bytes; texts shorter than a window never match; a null id comes after all
others; rows equal in id and text are one document, rows of one id never match each other; texts of any length are
taken whole; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.lines import LAST, key
from larkspur.llm.session import buckets
from larkspur.llm.units import BYTE, U, mix, powers

LENGTH, GRAM = 50, 20
#: Windows of one segment at most, bytes of text that are hashed at a time, segments that a task packs at a time, and bytes of text that it deals at a time.
RUN, BLOCK, PACK, DEAL = 64, 1 << 20, 1_500_000, 1 << 25


def segments(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Digit, text, start in the text, number of windows and hash of the bytes of every segment of texts."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none.astype(U), none, none, none, none.astype(U)
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTE[buf] * up[: len(buf)], out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * down[: len(buf) + 1 - gram])
    span, w = length - gram + 1, 1
    while 2 * w <= span:  # least over w strings, twice as many each time
        h = np.minimum(h[:-w], h[w:])
        w *= 2
    if w < span:
        h = np.minimum(h[: len(h) - (span - w)], h[span - w :])
    n = np.maximum(size - length + 1, 0)  # windows of each text
    text = np.repeat(np.arange(len(texts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(text):
        return none.astype(U), none, none, none, none.astype(U)
    digit = h[(end - size)[text] + place]
    new = np.concatenate([[True], (digit[1:] != digit[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    run = np.diff(np.concatenate([first, [len(digit)]]))
    if run.max() > RUN:  # a text that repeats itself
        parts = -(-run // RUN)
        first = np.repeat(first, parts) + RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        run = np.diff(np.concatenate([first, [len(digit)]]))
    a = (end - size)[text[first]] + place[first]
    content = mix((total[a + run + length - 1] - total[a]) * down[a] + run.astype(U))
    return mix(digit[first]) >> U(16), text[first], place[first], run, content


def bucket_of(digit: np.ndarray, groups: int) -> np.ndarray:
    return ((digit >> U(16)) * U(groups) >> U(32)).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length in planes of bytes, so that what is zero or ascends slowly compresses."""
    out = [np.array([len(columns[0])], np.int64).tobytes()]
    for c in columns:
        planes = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize)
        out.append(np.ascontiguousarray(planes.T).tobytes())
    return b"".join(out)


def unpack(data: bytes, *kinds: type) -> tuple[list[np.ndarray], bytes]:
    """The columns of pack(), of these kinds, and what follows them."""
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        wide = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * wide, at).reshape(wide, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * wide
    return out, data[at:]


def steps(ascending: np.ndarray) -> np.ndarray:
    """The differences of ascending numbers, from zero on; np.cumsum() undoes it."""
    return np.diff(ascending, prepend=U(0))


def squeezed(data: bytes) -> bytes:
    """data, compressed, after its length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def opened(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def gathered(parts: list[bytes], *kinds: type) -> list[np.ndarray]:
    columns = [unpack(opened(p), *kinds)[0] for p in parts]
    return [np.concatenate([c[k] for c in columns]) if columns else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def dealt(to: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(bucket, packed and compressed columns) for each bucket in to."""
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [c[order] for c in columns]
    at = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else [0]
    return [(int(to[a]), squeezed(pack(*(c[a:b] for c in columns)))) for a, b in zip(at, at[1:], strict=False)]


def home(document: np.ndarray, groups: int) -> np.ndarray:
    """The bucket of each document key, as Spark's pmod has it."""
    return document % groups


def rows(pairs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Buckets, kinds and payloads as a batch."""
    b, k, p = zip(*pairs, strict=True) if pairs else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], ["bucket", "kind", "payload"])


PACKED = "bucket int, kind int, payload binary"
#: Kind 0 is still to be decided, by digit; kind 1 is decided and on its way to its document; kind 2 asks a document for bytes.
OPEN, DECIDED, ASKED = 0, 1, 2


def with_documents(document: np.ndarray, place: np.ndarray, digit: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns packed with the documents they are of; each document is named once. digit ascends."""
    used, first, index = np.unique(document, return_index=True, return_inverse=True)
    return pack(steps(digit), *columns, index.astype(np.uint32)) + pack(used, place[first])


def of_documents(data: bytes, *kinds: type) -> tuple[list[np.ndarray], bytes]:
    """Document, place, digit and columns of with_documents(), and what follows them."""
    columns, rest = unpack(data, np.uint64, *kinds, np.uint32)
    (used, place), rest = unpack(rest, np.int64, np.int64)
    return [used[columns[-1]], place[columns[-1]], np.cumsum(columns[0]), *columns[1:-1]], rest


def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def packed_texts(docs: DataFrame, groups: int) -> DataFrame:
    """The texts of docs (key, place, doc_id, text) by the bucket of their document, several in a pack, compressed."""

    def task(batches):
        held: list[pa.RecordBatch] = []

        def whole() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            to = home(table.column("key").to_numpy(), groups)
            order = np.argsort(to, kind="stable")
            table, to = table.take(order), to[order]
            at = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
            out = []
            for a, b in zip(at, at[1:], strict=False):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
                    stream.write_table(table.slice(a, b - a).combine_chunks())
                out.append((int(to[a]), sink.getvalue().to_pybytes()))
            b, p = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.binary())], ["home", "pack"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= DEAL:
                yield whole()
                held = []
        if held:
            yield whole()

    return docs.mapInArrow(task, "home int, pack binary")


def unpacked(packs: pa.ChunkedArray):
    """(key, place, texts, doc_id) of the packs, one after the other."""
    for p in packs:
        t = pa.ipc.open_stream(p.as_buffer()).read_all()
        yield t.column("key").to_numpy(), t.column("place").to_numpy(), t.column("text").to_pylist(), t.column("doc_id")


def of_one(digit: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """The digits once and in order, each with its least and its greatest place."""
    order = np.argsort(digit, kind="stable")
    digit = digit[order]
    begin = np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1]])) if len(digit) else np.zeros(0, np.int64)
    if not len(begin):
        return [digit, low, high]
    return [digit[begin], np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin)]


#: Bits of a digit that do not move in pass 1: digits that differ in them alone pass for the same there, and go on to pass 2.
SHORT = U(8)


def digits(texts: DataFrame, groups: int, length: int, gram: int) -> DataFrame:
    """Pass 1, by document: the digits of a group of documents, by digit, each once, and marked if several of the documents have it."""

    def group(table: pa.Table) -> pa.Table:
        found = []
        for _, places, whole, _ in unpacked(table.column("pack")):
            parts = []
            for first, block in byte_blocks(whole):
                digit, text, _, _, _ = segments(block, length, gram)
                own = places[first + text]
                parts.append(of_one(digit >> SHORT, own, own))
            found.append(of_one(*joined(parts)))
        digit, low, high = of_one(*joined(found))
        own, out = np.array([table.column("home")[0].as_py()], np.int64).tobytes(), []
        to = bucket_of(digit << SHORT, groups)
        for b in np.unique(to):
            k = slice(*np.searchsorted(to, [b, b + 1]))
            out.append((int(b), OPEN, squeezed(own + pack(steps(digit[k]), (low[k] != high[k]).astype(np.uint8)))))
        return pa.Table.from_batches([rows(out)])

    return texts.groupBy("home").applyInArrow(group, PACKED)


def shared_digits(packed: DataFrame) -> DataFrame:
    """Pass 1, by digit: to each group of documents those of its digits that another document has too."""

    def group(table: pa.Table) -> pa.Table:
        homes, lists, marks = [], [], []
        for p in map(opened, table.column("payload").to_pylist()):
            homes.append(int(np.frombuffer(p, np.int64, 1)[0]))
            (step, mark), _ = unpack(p[8:], np.uint64, np.uint8)
            lists.append(np.cumsum(step))
            marks.append(mark)
        digit = np.concatenate(lists)
        order = np.argsort(digit, kind="stable")
        same = digit[order]
        begin = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        n = np.diff(np.concatenate([begin, [len(same)]]))
        several = np.empty(len(digit), bool)
        several[order] = np.repeat((n > 1) | (np.maximum.reduceat(np.concatenate(marks)[order], begin) > 0), n)
        out, at = [], 0
        for h, x in zip(homes, lists, strict=True):
            mine = x[several[at : at + len(x)]]
            at += len(x)
            if len(mine):
                out.append((h, OPEN, squeezed(pack(steps(mine)))))
        return pa.Table.from_batches([rows(out)])

    return packed.groupBy("bucket").applyInArrow(group, PACKED)


def byte_blocks(texts: list[bytes], most: int = BLOCK):
    """(first, texts) of consecutive texts of most bytes together, or one longer text, and 5,000 texts at most."""
    out, n, first = [], 0, 0
    for k, t in enumerate(texts):
        if out and (n + len(t) > most or len(out) == 5000):
            yield first, out
            out, n, first = [], 0, k
        out.append(t)
        n += len(t)
    if out:
        yield first, out


def by_document(documents: np.ndarray, *columns: np.ndarray) -> dict[int, list[np.ndarray]]:
    order = np.argsort(documents, kind="stable")
    documents, columns = documents[order], [c[order] for c in columns]
    at = np.concatenate([[0], np.flatnonzero(np.diff(documents)) + 1, [len(documents)]]) if len(documents) else [0]
    return {int(documents[a]): [c[a:b] for c in columns] for a, b in zip(at, at[1:], strict=False)}


def fingerprints(texts: DataFrame, shared: DataFrame, groups: int, length: int, gram: int) -> DataFrame:
    """Pass 2, by document: the hashes of segments with shared digits, by digit. Of equal segments of a pack, those of the earliest document go on and later ones are decided."""

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = [np.cumsum(unpack(opened(p), np.uint64)[0][0]) for p in right.column("payload").to_pylist()]
        known = np.sort(np.concatenate(lists)) if lists else np.zeros(0, U)
        out, held, count = [], [], 0

        def flush() -> None:
            digit, content, doc, place, start, run = joined(held)
            order, least = ranked(digit, content, run, place)
            late = order[place[order] > least]
            out.extend(removed(doc[late], start[late], run[late], groups))
            order = order[place[order] == least]
            to = bucket_of(digit[order], groups)
            for b in np.unique(to):
                k = order[slice(*np.searchsorted(to, [b, b + 1]))]
                out.append((int(b), OPEN, squeezed(with_documents(doc[k], place[k], digit[k], content[k], start[k].astype(np.uint32), run[k].astype(np.uint16)))))

        for keys, places, whole, _ in unpacked(left.column("pack")) if len(known) else ():
            for first, block in byte_blocks(whole):
                digit, text, start, run, content = segments(block, length, gram)
                short = digit >> SHORT
                t = np.flatnonzero(known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short)
                if len(t):
                    held.append([digit[t], content[t], keys[first + text[t]], places[first + text[t]], start[t], run[t]])
                    count += len(t)
                if count >= PACK:
                    flush()
                    held, count = [], 0
        if count:
            flush()
        return pa.Table.from_batches([rows(out)])

    return texts.groupBy("home").cogroup(shared.groupBy("bucket")).applyInArrow(group, PACKED)


def ranked(digit: np.ndarray, content: np.ndarray, run: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of segments by digit, bytes and place; and in it, of each segment, the least place of its equals."""
    order = np.lexsort((place, run, content, digit))
    d, c, r = digit[order], content[order], run[order]
    head = np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (r[1:] != r[:-1])])
    return order, place[order][np.flatnonzero(head)][np.cumsum(head) - 1]


def removed(doc: np.ndarray, start: np.ndarray, run: np.ndarray, groups: int) -> list[tuple[int, int, bytes]]:
    """Rows that tell documents that the run windows from start on go."""
    order = np.lexsort((start, doc))
    doc, start, run = doc[order], start[order], run[order]
    return [(b, DECIDED, p) for b, p in dealt(home(doc, groups), [doc, start.astype(np.uint32), run.astype(np.uint32)])]


def passed(table: pa.Table) -> tuple[list[tuple[int, int, bytes]], dict[int, list[bytes]]]:
    """The decided rows of a group, as they are, and the payloads of the others by kind."""
    out, others = [], {}
    for b, k, p in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True):
        if k == DECIDED:
            out.append((b, k, p))
        else:
            others.setdefault(k, []).append(p)
    return out, others


def whole_segments(packed: DataFrame, groups: int) -> DataFrame:
    """Pass 2, by digit: equal segments are decided; where different ones share a digit, their documents are asked for their bytes."""

    def group(table: pa.Table) -> pa.Table:
        out, others = passed(table)
        if OPEN in others:
            doc, place, digit, content, start, run = joined([of_documents(opened(p), np.uint64, np.uint32, np.uint16)[0] for p in others[OPEN]])
            order, least = ranked(digit, content, run, place)
            late = order[place[order] > least]
            out += removed(doc[late], start[late], run[late], groups)
            order = order[place[order] == least]
            d, c, r = digit[order], content[order], run[order]
            begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            other = np.concatenate([[0], (d[1:] == d[:-1]) & ((c[1:] != c[:-1]) | (r[1:] != r[:-1]))]).astype(np.int64)
            mixed = np.repeat(np.add.reduceat(other, begin) > 0, np.diff(np.concatenate([begin, [len(d)]])))
            k = order[mixed]
            k = k[np.lexsort((start[k], doc[k]))]
            out += [(b, ASKED, p) for b, p in dealt(home(doc[k], groups), [doc[k], digit[k], start[k], run[k].astype(np.uint16)])]
        return pa.Table.from_batches([rows(out)])

    return packed.groupBy("bucket").applyInArrow(group, PACKED)


def contents(texts: DataFrame, asked: DataFrame, groups: int, length: int) -> DataFrame:
    """Pass 3, by document: the bytes that were asked for, by digit."""

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        out, others = passed(right)
        if ASKED in others:
            wanted = by_document(*gathered(others[ASKED], np.int64, np.uint64, np.uint32, np.uint16))
            held: list[list[np.ndarray]] = []
            body: list[bytes] = []
            size, met = 0, set()

            def flush() -> None:
                digit, doc, place, start, run = joined(held)
                order = np.argsort(digit, kind="stable")
                to = bucket_of(digit[order], groups)
                for b in np.unique(to):
                    k = order[slice(*np.searchsorted(to, [b, b + 1]))]
                    out.append((int(b), OPEN, squeezed(with_documents(doc[k], place[k], digit[k], start[k], run[k]) + b"".join(body[x] for x in k))))

            for keys, places, whole, _ in unpacked(left.column("pack")):
                for key, place, t in zip(keys.tolist(), places.tolist(), whole, strict=True):
                    if (w := wanted.get(key)) is None or key in met:
                        continue
                    met.add(key)  # rows equal in id and text are one document
                    digit, start, run = w
                    held.append([digit, np.full(len(digit), key), np.full(len(digit), place), start, run])
                    body += [t[a : a + n + length - 1] for a, n in zip(start.tolist(), run.tolist(), strict=True)]
                    size += sum(map(len, body[-len(digit) :]))
                    if size > 16 * BLOCK:
                        flush()
                        held, body, size = [], [], 0
            if held:
                flush()
        return pa.Table.from_batches([rows(out)])

    return texts.groupBy("home").cogroup(asked.groupBy("bucket")).applyInArrow(group, PACKED)


def equal_windows(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A group number for each window (buf from at on, length bytes), or -1 if no other window equals it, by most-significant-digit passes."""
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)
    group, alive = np.zeros(len(at), np.int64), np.arange(len(at))
    for d in [*range(0, length - 8, 8), length - 8]:
        digit = np.ascontiguousarray(eight[at[alive] + d]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group[alive])) if d else np.argsort(digit, kind="stable")
        alive, digit = alive[order], digit[order]
        g = group[alive]
        head = np.concatenate([[True], (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])]) if len(g) else np.zeros(0, bool)
        new = np.cumsum(head) - 1
        several = np.bincount(new, minlength=1)[new] > 1 if len(g) else head
        group[alive] = new
        alive = alive[several]
    out = np.full(len(at), -1, np.int64)
    out[alive] = group[alive]
    return out


def repeated(packed: DataFrame, groups: int, length: int) -> DataFrame:
    """Pass 3, by digit: the windows that an earlier document has too."""

    def group(table: pa.Table) -> pa.Table:
        out, others = passed(table)
        parts, body = [], []
        for p in others.get(OPEN, []):
            columns, rest = of_documents(opened(p), np.uint32, np.uint16)
            parts.append(columns)
            body.append(rest)
        if not parts:
            return pa.Table.from_batches([rows(out)])
        doc, place, digit, start, run = joined(parts)
        run = run.astype(np.int64)
        text = b"".join(body)
        begin = np.cumsum(run + length - 1) - (run + length - 1)
        ids: dict[bytes, int] = {}
        same = np.fromiter((ids.setdefault(text[a:b], len(ids)) for a, b in zip(begin.tolist(), (begin + run + length - 1).tolist(), strict=True)), np.int64, len(begin))
        least = np.full(len(ids), LAST, np.int64)
        np.minimum.at(least, same, place)
        one = np.zeros(len(ids), np.int64)
        one[same] = np.arange(len(same))  # any entry with this content
        late = place > least[same]
        gone = [(doc[late], start[late].astype(np.int64), run[late])]
        # Digits with different contents: their windows, once for each content, at its earliest document.
        order = np.argsort(digit[one], kind="stable")
        d = digit[one][order]
        several = np.concatenate([[False], d[1:] == d[:-1]]) | np.concatenate([d[1:] == d[:-1], [False]])
        mixed = order[several]
        if len(mixed):
            n = run[one[mixed]]
            owner = np.repeat(np.arange(len(mixed)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = equal_windows(np.frombuffer(text, np.uint8), begin[one[mixed]][owner] + offset, length)
            hit = np.flatnonzero(equal >= 0)
            first = np.full(equal.max(initial=-1) + 1, LAST, np.int64)
            by = least[mixed][owner[hit]]
            np.minimum.at(first, equal[hit], by)
            hit = hit[by > first[equal[hit]]]
            # The same windows go from every entry with this content at its earliest document.
            entry = np.flatnonzero(~late)
            rank = np.full(len(ids), -1, np.int64)
            rank[mixed] = np.arange(len(mixed))
            entry = entry[rank[same[entry]] >= 0]
            offsets = by_document(owner[hit], offset[hit])
            for e in entry.tolist():
                if (g := offsets.get(int(rank[same[e]]))) is not None:
                    w = np.sort(g[0])
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(w) > 1) + 1])
                    gone.append((np.full(len(cut), doc[e]), start[e] + w[cut], np.diff(np.concatenate([cut, [len(w)]]))))
        out += removed(*joined(gone), groups)
        return pa.Table.from_batches([rows(out)])

    return packed.groupBy("bucket").applyInArrow(group, PACKED)


def cut_texts(texts: DataFrame, gone: DataFrame, kind: T.DataType, length: int) -> DataFrame:
    """Pass 4, by document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""

    def cut(t: bytes, start: np.ndarray, run: np.ndarray) -> tuple[int, int, int, bytes]:
        start, run = start.astype(np.int64), run.astype(np.int64)
        order = np.argsort(start)
        a, b = start[order], (start + run + length - 1)[order]
        b = np.maximum.accumulate(b)
        head = np.concatenate([[True], a[1:] > b[:-1]])
        a, b = a[head], np.concatenate([b[:-1][head[1:]], b[-1:]])
        edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(t)]
        return len(t), int((b - a).sum()), len(a), b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        removal = by_document(*gathered(right.column("payload").to_pylist(), np.int64, np.uint32, np.uint32))
        found, ids = [], []
        for keys, _, whole, doc_id in unpacked(left.column("pack")):
            ids += doc_id.chunks
            found += [cut(t, *removal[k]) if k in removal else (len(t), 0, 0, t) for k, t in zip(keys.tolist(), whole, strict=True)]
        n = list(zip(*found, strict=True))
        return pa.table([pa.chunked_array(ids), *(pa.array(x, pa.int64()) for x in n[:3]), pa.array(n[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType().add("doc_id", kind).add("n_bytes", T.LongType()).add("n_removed", T.LongType()).add("n_spans", T.LongType()).add("kept", T.BinaryType())
    return texts.groupBy("home").cogroup(gone.groupBy("bucket")).applyInArrow(group, schema)


def substring_dedup(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of documents: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay, concatenated)."""
    groups = buckets(documents)
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    place = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    docs = documents.select(key(doc_id, text).alias("key"), place.alias("place"), F.col(doc_id).alias("doc_id"), plain.cast("binary").alias("text"))
    texts = packed_texts(docs, groups)  # dealt once, for all passes
    shared = shared_digits(digits(texts, groups, length, gram))
    asked = whole_segments(fingerprints(texts, shared, groups, length, gram), groups)
    gone = repeated(contents(texts, asked, groups, length), groups, length)
    return cut_texts(texts, gone, documents.schema[doc_id].dataType, length)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
