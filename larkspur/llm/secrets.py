"""Secret scan with a recursive decoding worklist.

Every text is scanned for three kinds of secret. Then its encoded parts are unwrapped, layer by layer:
URL escapes, Unicode escapes, base64 (also broken into lines), and gzip or zlib data in any of them or in one another. Layers stay
bytes until no compression is left. Each layer is scanned again and
unwrapped again until nothing new appears; a layer that was met before at the same place (a cycle) is not taken
up again, the same content at another place is.
A finding in a layer is reported at the place in the original text that it came from: the exact
characters where a layer only replaces escapes, the whole encoded run where it is base64.

Edge cases: null and empty texts have no findings; a text of any length is scanned whole, and decoded
layers too, whatever characters they hold: bytes that are no UTF-8 are replaced, and compressed data is unpacked
to the end of its last member in blocks of 64 MB (only an encoded run or secret of more than 32 MB without a break
inside compressed data may be met in parts);
rows with null or repeated ids are scanned each by itself; an empty table gives no rows; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a greedy run of fewer would fail; runs are apart, so nothing is skipped
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
BREAK = re.compile(r"[^A-Za-z0-9+/_.=\-\"':\x20%\\]")  # what ends a match of every pattern
#: Escaped bytes that begin as compressed data does, with the characters that such escapes leave as they are.
PACKED_URL = re.compile(r"(?:%1[fF]%8[bB]|(?:%78|x)(?:%01|%5[eE]|\^|%9[cC]|%[dD][aA]))(?:%[0-9A-Fa-f]{2}|[^%\s\"'<>\x80-\U0010ffff])*")
PACKED_UNICODE = re.compile(r"(?:\\(?:x|u00)1[fF]\\(?:x|u00)8[bB]|(?:\\(?:x|u00)78|x)(?:\\(?:x|u00)(?:01|5[eE]|9[cC]|[dD][aA])|\^))(?:\\(?:x|u00)[0-9A-Fa-f]{2}|\\[nrt\\'\"0]|[^\\\x00-\x1f\"\x80-\U0010ffff])*")
ESCAPE = re.compile(r"\\(?:(?:x|u00)([0-9A-Fa-f]{2})|(.))")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}+[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
MOST, STEP, HEAD = 64 << 20, 1 << 20, 1 << 16

Span = tuple[int, int, int]  # start, kind, end: in the order of the result


def base(text: str) -> list[Span]:
    """The findings in one text as it stands."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text and, for each stretch of it, where it lies in the original."""

    def __init__(self, text: str, parts: list[tuple[int, int, int, bool]]) -> None:
        self.text, self.parts = text, parts  # parts: start here; start and end there; whether one character stands for one
        self.starts = [p[0] for p in parts]

    def mark(self) -> bytes:
        """A digest of the text and of where it lies."""
        return hashlib.sha256(f"{self.parts}\n{self.text}".encode("utf-8", "surrogatepass")).digest()

    def origin(self, start: int, end: int) -> tuple[int, int]:
        at, a, b, alike = self.parts[bisect_right(self.starts, start) - 1]
        first = a + start - at if alike else a
        at, a, b, alike = self.parts[bisect_right(self.starts, end - 1) - 1]
        return first, (a + end - at if alike else b)

    def replaced(self, pattern: re.Pattern, decode) -> Layer | None:
        """The layer with what pattern finds decoded, or None if nothing could be."""
        out, parts, upto, length = [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal length
            while a < b:  # what stays as it is keeps the stretches it had
                k = bisect_right(self.starts, a) - 1
                at, x, y, alike = self.parts[k]
                stop = min(b, self.starts[k + 1]) if k + 1 < len(self.parts) else b
                parts.append((length, x + a - at, 0, True) if alike else (length, x, y, False))
                out.append(self.text[a:stop])
                length += stop - a
                a = stop

        for m in pattern.finditer(self.text):
            if new := decode(m[0]):
                keep(upto, m.start())
                parts.append((length, *self.origin(m.start(), m.end()), False))
                out.append(new)
                length += len(new)
                upto = m.end()
        if not upto:
            return None
        keep(upto, len(self.text))
        return Layer("".join(out), parts)


def unescaped_url(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def unescaped_unicode(run: str) -> str:
    units = "".join(chr(int(m[2:], 16)) for m in re.findall(r"\\u....|\\x..", run))
    return units.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0


def inflated(pieces: Iterator[bytes], ends: list[int] | None = None) -> Iterator[bytes]:
    """One layer of a stream of bytes: what its members hold, a piece at a time, then what follows them; of a member that is broken, what it gives and, on a line of its own, itself (of more than one piece, the first megabyte). ends gets the number of bytes given at the end of each member."""
    given, data = 0, b""
    while True:
        while len(data) < 3 and (more := next(pieces, None)) is not None:
            data += more
        if not packed(data):
            break
        d, raw, kept = zlib.decompressobj(47), [data], len(data)
        while not d.eof:
            try:
                out = d.decompress(data, STEP)
            except zlib.error:
                out, d = b"", None
                break
            data = d.unconsumed_tail
            if out:
                given += len(out)
                yield out
            elif not data:
                if (more := next(pieces, None)) is None:  # cut short
                    d = None
                    break
                data = more
                if kept < STEP:
                    raw.append(more)
                    kept += len(more)
        if ends is not None:
            ends.append(given)
        if d is None:
            data = b"\n" + b"".join(raw)
            break
        data = d.unused_data
    yield data
    yield from pieces


def opened(pieces: Iterator[bytes], above: frozenset[bytes] = frozenset()) -> Iterator[bytes]:
    """A long stream of bytes with all its layers open. A layer that begins as one above it is a cycle and is given as it is."""
    head = b""
    while len(head) < HEAD and (more := next(pieces, None)) is not None:
        head += more
    mark = hashlib.sha256(head[:HEAD]).digest()
    rest = chain([head], pieces)
    yield from opened(inflated(rest), above | {mark}) if packed(head) and mark not in above else rest


def layers_of(data: bytes) -> Iterator[Iterator[bytes]]:
    """The contents of data as streams, all compression open: to any depth; data that was met before (a cycle) is given as it is."""
    work, met = [data], set()
    while work:
        data = work.pop()
        mark = hashlib.sha256(data).digest()
        if mark in met or not packed(data):
            yield (data[k : k + STEP] for k in range(0, len(data), STEP))
            continue
        met.add(mark)
        held, n, ends = [], 0, []
        pieces = inflated(iter([data]), ends)
        for piece in pieces:
            held.append(piece)
            n += len(piece)
            if n > MOST:  # larger than what is held: as a stream
                yield opened(chain(held, pieces))
                break
        else:
            whole = b"".join(held)
            work += [whole, *(whole[e:] for e in ends if e and packed(whole[e:]))]  # later members may be compressed once more


def unpacked(data: bytes, most: int = MOST) -> Iterator[str]:
    """The texts of data, unpacked if it is compressed, in blocks of about most characters; what is no UTF-8 is replaced.

    A block ends where no pattern reaches over. If it has no such place, its end is repeated in the next.
    """
    for pieces in layers_of(data):
        decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        held, n = [], 0
        for piece in pieces:
            held.append(decode(piece))
            n += len(held[-1])
            if n >= most:
                text = "".join(held)
                at = last_break(text)
                yield text[:at] if at else text
                held = [text[at:] if at else text[-(most // 2) :]]
                n = len(held[0])
        if text := "".join([*held, decode(b"", True)]):
            yield text


def last_break(text: str) -> int:
    """The place after the last character that no pattern can hold; 0 if there is none."""
    for end in range(len(text), 0, -4096):
        if found := list(BREAK.finditer(text, max(0, end - 4096), end)):
            return found[-1].end()
    return 0


def decoded(run: str) -> bytes:
    """The bytes of a base64 run; none if it is not base64. A last character that stands for no whole byte is left out."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[:-1] if len(body) % 4 == 1 else body
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return b""


def starts(run: str) -> list[int]:
    """Where base64 may begin in a run that may have a path before it: at its begin, and after slashes: the first of each place modulo 4 (later ones give the end of the same bytes), and all that compressed data follows."""
    out, met = [0], {0}
    at = run.find("/") + 1
    while 0 < at <= len(run) - 20:
        if at % 4 not in met or packed(decoded(run[at : at + 4])):
            met.add(at % 4)
            out.append(at)
        at = run.find("/", at) + 1
    return out


def blocks_at(data: bytes, place: tuple[int, int]) -> Iterator[Layer]:
    return (Layer(t, [(0, *place, False)]) for t in unpacked(data))


def lines_joined(text: str) -> Iterator[tuple[int, int, str]]:
    """Base64 broken into lines of one length, the last not longer, and filled up to whole groups of four: begin, end, and the run without the breaks."""
    for m in WRAPPED.finditer(text):
        rows = list(LINE.finditer(text, m.start(), m.end()))
        k = 0
        while k < len(rows):
            size, to = len(rows[k][0]), k + 1
            while to < len(rows) and len(rows[to][0]) == size:
                to += 1
            last = to + (to < len(rows) and len(rows[to][0]) < size)
            for end in {last, to}:  # what seems to be the last line may be a word that follows
                run = "".join(r[0] for r in rows[k:end])
                if end - k > 1 and size >= 20 and len(run) % 4 == 0:
                    yield rows[k].start(), rows[end - 1].end(), run
            k = to


def escaped_bytes(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Compressed data that is escaped byte by byte: begin, end, and the bytes."""
    if "%" in text:
        for m in PACKED_URL.finditer(text):
            yield m.start(), m.end(), unquote_to_bytes(m[0])
            if "+" in m[0]:
                yield m.start(), m.end(), unquote_to_bytes(m[0].replace("+", " "))
    if "\\" in text:
        short = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}
        for m in PACKED_UNICODE.finditer(text):
            yield m.start(), m.end(), ESCAPE.sub(lambda x: chr(int(x[1], 16)) if x[1] else short.get(x[2], x[2]), m[0]).encode("latin-1")


def layered(text: str) -> set[Span]:
    """The findings of all layers under text, at their places in text."""
    found: set[Span] = set()
    top = Layer(text, [(0, 0, 0, True)])
    met = {top.mark()}
    work: list[Layer | Iterator[Layer]] = [top]
    while work:
        layer = work.pop()
        if not isinstance(layer, Layer):
            rest, layer = layer, next(layer, None)
            if layer is None:
                continue
            work.append(rest)
        if layer is not top:
            if (mark := layer.mark()) in met:
                continue
            met.add(mark)
            for s, kind, e in base(layer.text):
                a, b = layer.origin(s, e)
                found.add((a, kind, b))
        new: list[Layer | None] = []
        if "%" in layer.text:
            new.append(layer.replaced(URL, unescaped_url))
        if "\\" in layer.text:
            new.append(layer.replaced(UNICODE, unescaped_unicode))
        for m in BASE64.finditer(layer.text):
            for start in starts(m[0]):
                if data := decoded(m[0][start:]):
                    inner = blocks_at(data, layer.origin(m.start() + start, m.end()))
                    if packed(data):  # may be far larger than the run, so its blocks are made one by one
                        work.append(inner)
                    else:
                        new += inner
        for start, end, data in escaped_bytes(layer.text):
            work.append(blocks_at(data, layer.origin(start, end)))
        for start, end, run in lines_joined(layer.text) if "\n" in layer.text else ():
            if data := decoded(run):
                work.append(blocks_at(data, layer.origin(start, end)))
        work += [x for x in new if x]
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of documents: doc_id, n_assign, n_access, n_hex, base_sha256 (of kind:start:end of the findings in the text itself, comma-joined), spans (all findings, joined likewise)."""
    kind = documents.schema[doc_id].dataType

    def task(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                plain = base(t or "")
                all_spans = sorted({*plain, *layered(t)}) if t else []
                counts = [sum(k == n for _, k, _ in plain) for n in range(3)]
                rows.append((*counts, hashlib.sha256(joined(plain).encode()).hexdigest(), joined(all_spans)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], schema.names)

    schema = T.StructType().add("doc_id", kind)
    for name in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("base_sha256", T.StringType()).add("spans", T.StringType())
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(task, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
