"""Delimited files (CSV, TSV) read in blocks, so that one large file is the work of many tasks.

Whether a line feed ends a record depends on everything before it. So a block is first looked at for every state that it may begin in
(at a field, in a plain or a quoted one, after a closing quote, after a CR): what state it ends in, how many records end, how many fields
stand at its edges. These summaries are composed along each file, which gives each block its state, row and column; then every block gives the
cells that begin in it, reading on where the last one is longer. A task holds a block and one cell.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources import ranges

MAX_COLUMNS, MAX_CELL, BLOCK = 2048, 1_000_000, 1 << 22
#: States: at a field's begin, the same after a CR, in a plain field, in a quoted one, after a quote there (which may be doubled), after the closing quote and white space.
START, RETURN, PLAIN, QUOTED, QUOTE, CLOSED = range(6)
LIMIT, AFTER, OPEN = "a limit is exceeded", "text after a closing quote", "a quote is not closed"
INSIDE, BLANK = re.compile(r'(?:[^"]++|"")*+'), re.compile(r"[ \t]*+")


@lru_cache(8)
def patterns(d: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """A whole field with what ends it, the rest of a plain field, and what ends one."""
    d = re.escape(d)
    return re.compile(rf'(?:"((?:[^"]++|"")*+)"[ \t]*+|([^"\r\n{d}][^\r\n{d}]*+|))({d}|\r\n|\r|\n)'), re.compile(rf"[^\r\n{d}]*+"), re.compile(rf"{d}|\r\n|\r|\n")


class Summary(NamedTuple):
    """What a block does to the state before it. lead: of the field and record that were open before, tail: of those that are open after."""

    state: int
    records: int
    lead_fields: int  # fields that end before the first record does (in all, if none does)
    tail_fields: int
    lead_length: int
    lead_ends: bool
    tail_length: int
    most_fields: int
    most_length: int
    error: str


def lead(text: str, state: int, d: str) -> tuple[int, int, str, str]:
    """How an open field goes on: where what ends it begins, its characters here, the state if the text ends first (else ''), and an error."""
    at, length = 0, 0
    if state == PLAIN:
        at = length = patterns(d)[1].match(text).end()
        return at, length, "" if at < len(text) else str(PLAIN), ""
    if state == QUOTE and text[:1] == '"':
        state, at, length = QUOTED, 1, 1
    if state == QUOTED:
        m = INSIDE.match(text, at)
        length += m.end() - at - m[0].count('""')
        at = m.end()
        if at == len(text):
            return at, length, str(QUOTED), ""
        at += 1
        if at == len(text):
            return at, length, str(QUOTE), ""
    elif at == len(text):
        return at, length, str(state), ""
    at = BLANK.match(text, at).end()
    if at == len(text):
        return at, length, str(CLOSED), ""
    return at, length, "", "" if patterns(d)[2].match(text, at) else AFTER


def fields(text: str, at: int, d: str) -> Iterator[tuple[int, int, str, str]]:
    """From a field's begin: begin, end with delimiter, value and delimiter of each field that ends in text."""
    for m in patterns(d)[0].finditer(text, at):
        if m.start() != at:
            return
        at = m.end()
        yield m.start(), at, m[1].replace('""', '"') if m[1] is not None else m[2], m[3]


def rest(text: str, at: int, d: str, records: int, first: int, now: int, most: int, longest: int, ahead: tuple[int, bool]) -> Summary:
    """The summary from a field's begin on, after records that ended with first fields, and now fields in the open one."""
    ended = ""
    for _, at, value, ended in fields(text, at, d):
        longest = max(longest, len(value))
        now += 1
        if ended != d:
            first, most = (first, max(most, now)) if records else (now, most)
            records, now = records + 1, 0
    state, length, error = START, 0, ""
    if at == len(text):
        state = RETURN if text[-1:] == "\r" and ended == "\r" else START
    elif text[at] == '"':
        _, length, left, error = lead(text[at + 1 :], QUOTED, d)
        state = int(left or QUOTED)
    else:
        state, length = PLAIN, len(text) - at
    return Summary(state, records, first if records else now, now if records else 0, *ahead, length, most, longest, error)


def summaries(text: str, d: str) -> list[Summary]:
    """The summary of a block for each state that it may begin in."""
    out, known = [], {}

    def after(at: int, fields_ended: int, records: int, ahead: tuple[int, bool]) -> Summary:
        key = (at, fields_ended, records)
        if key not in known:
            known[key] = rest(text, at, d, records, fields_ended, 0 if records else fields_ended, 0, 0, ahead)
        return known[key]._replace(lead_length=ahead[0], lead_ends=ahead[1])

    for state in range(6):
        if not text:
            out.append(Summary(state, 0, 0, 0, 0, False, 0, 0, 0, ""))
        elif state in (START, RETURN):
            out.append(after(int(state == RETURN and text[0] == "\n"), 0, 0, (0, True)))
        else:
            at, length, left, error = lead(text, state, d)
            if left or error:
                out.append(Summary(int(left or state), 0, 0, 0, length, False, 0, 0, 0, error))
            else:
                end = patterns(d)[2].match(text, at)
                last = end[0] == "\r" and end.end() == len(text)
                s = after(end.end(), 1, int(end[0] != d), (length, True))
                out.append(s._replace(state=RETURN) if last else s)
    return out


def composed(blocks: list[list[Summary]]) -> tuple[list[tuple[int, int, int]], str]:
    """State, row and column at which each block of a file begins, and the file's first error."""
    state, row, column, length, out = START, 0, 0, 0, []
    for per_state in blocks:
        out.append((state, row, column))
        s = per_state[state]
        open_length = (length if state in (PLAIN, QUOTED, QUOTE, CLOSED) else 0) + s.lead_length
        if s.error:
            return out, s.error
        if max(s.most_length, open_length) > MAX_CELL or max(column + s.lead_fields, s.most_fields) > MAX_COLUMNS:
            return out, LIMIT
        length = s.tail_length if s.lead_ends else open_length
        row, column = row + s.records, s.tail_fields if s.records else column + s.lead_fields
        state = s.state
    if state == QUOTED:
        return out, OPEN
    return out, LIMIT if length > MAX_CELL or column >= MAX_COLUMNS else ""


def text_of(f: ranges.File, block: int, size: int) -> str:
    """The characters that begin in a block, without the mark at a file's begin. UnicodeDecodeError if it is no UTF-8."""
    data = f.get(block * size, size + 3)
    start = 0
    while block and start < min(3, len(data)) and data[start] & 0xC0 == 0x80:
        start += 1
    end = min(size, len(data))
    while end < min(size + 3, len(data)) and data[end] & 0xC0 == 0x80:
        end += 1
    text = data[start:end].decode("utf-8")
    return text[1:] if not block and text[:1] == "﻿" else text


def cells(f: ranges.File, block: int, size: int, state: int, row: int, column: int, d: str) -> Iterator[tuple[int, int, str]]:
    """The cells that begin in a block, given how it begins."""
    text = text_of(f, block, size)
    at, own = int(state == RETURN and text[:1] == "\n"), len(text)
    if state not in (START, RETURN):
        at, _, left, _ = lead(text, state, d)
        if left:
            return
        end = patterns(d)[2].match(text, at)
        at, row, column = end.end(), row + (end[0] != d), column + 1 if end[0] == d else 0
        if end[0] == "\r" and text[at : at + 1] == "\n":
            at += 1
    last = (block + 1) * size >= f.size  # a delimiter at the end begins a field of the next block, or one more of this
    decoder, upto = codecs.getincrementaldecoder("utf-8")(), block * size + len(text_bytes(f, block, size))
    while True:
        for begin, at, value, ended in fields(text, at, d):
            if begin >= own:
                return
            yield row, column, value
            row, column = (row, column + 1) if ended == d else (row + 1, 0)
        over = upto >= f.size
        if at >= own and not (last and over and at == len(text) and column):
            return
        if over:
            if at < len(text) or column:
                value = text[at:]
                yield row, column, value[1 : value.rindex('"')].replace('""', '"') if value[:1] == '"' else value
            return
        more = f.get(upto, size)
        upto += len(more)
        text = text[at:] + decoder.decode(more, upto >= f.size)
        own, at = own - at, 0


def text_bytes(f: ranges.File, block: int, size: int) -> bytes:
    """The bytes of a block up to the last that belongs to a character which begins in it, from the block's begin."""
    data = f.get(block * size, size + 3)
    end = min(size, len(data))
    while end < min(size + 3, len(data)) and data[end] & 0xC0 == 0x80:
        end += 1
    return data[:end]


CELLS = "file string, row_no int, col_no int, value string, error string"
FIELDS = "state long, records long, lead_fields long, tail_fields long, lead_length long, lead_ends boolean, tail_length long, most_fields long, most_length long, error string"


def delimiter(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def read_delimited(spark: SparkSession, glob: str, size: int = BLOCK) -> DataFrame:
    """(file, row_no, col_no, value, error) of CSV and TSV files, in blocks of size bytes that many tasks share, in no order. A rejected file is one row with error.

    Delimiter by extension; quotes are doubled inside quotes, line ends may stand in them; CR, LF and CRLF end a record; a blank line is one empty field; after a closing quote
    only white space may come before the delimiter. UTF-8, a mark at the begin is dropped. Files in stores that only Spark can open are one block each.
    """
    files = ranges.listed(spark, glob).where("length > 0")
    one = files.select("path").first()
    whole = one is not None and not ranges.can_range(one[0])
    if whole:
        raw = spark.read.format("binaryFile").load(glob).where("length > 0")
        files = raw.select("path", F.col("length").alias("size"), F.lit(0).cast("long").alias("block"), "content")
    else:
        files = files.select("path", F.lit(size).cast("long").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"), F.lit(None).cast("binary").alias("content"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.repartition(tasks, "path", "block")

    def opened(path: str, content: bytes | None) -> ranges.File:
        return ranges.File(path) if content is None else ranges.Bytes(content)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, own, block, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = summaries(text_of(opened(path, content), block, own), delimiter(path))
                except UnicodeDecodeError as e:
                    found = [Summary(s, 0, 0, 0, 0, False, 0, 0, 0, str(e)) for s in range(6)]
                yield pa.RecordBatch.from_pylist([{"path": path, "size": own, "block": block, "found": [s._asdict() for s in found]}], seen)

    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        starts, error = composed([[Summary(**s) for s in found] for found in table["found"].to_pylist()])
        if error:
            return pa.table({"path": [key[0].as_py()], "size": [0], "block": [-1], "state": [0], "row": [0], "column": [0], "error": [error]}, places)
        state, row, column = zip(*starts, strict=True)
        return pa.table({"path": table["path"], "size": table["size"], "block": table["block"], "state": list(state), "row": list(row), "column": list(column), "error": [""] * len(table)}, places)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, own, block, state, row, column, error, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, names = [], ("file", "row_no", "col_no", "value", "error")
                if error:
                    rows.append(dict(zip(names, (path, -1, -1, "", error), strict=True)))
                for cell in cells(opened(path, content), block, own, state, row, column, delimiter(path)) if not error else ():
                    rows.append(dict(zip(names, (path, *cell, ""), strict=True)))
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_pylist(rows, out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, out)

    kinds = {"lead_ends": pa.bool_(), "error": pa.string()}
    summary = pa.struct([(n, kinds.get(n, pa.int64())) for n in Summary._fields])
    seen = pa.schema([("path", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("found", pa.list_(summary))])
    places = pa.schema([("path", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("state", pa.int32()), ("row", pa.int64()), ("column", pa.int64()), ("error", pa.string())])
    out = pa.schema([("file", pa.string()), ("row_no", pa.int32()), ("col_no", pa.int32()), ("value", pa.string()), ("error", pa.string())])
    looked = dealt.mapInArrow(look, f"path string, size long, block long, found array<struct<{re.sub(r'(\w+) (\w+)', r'\1:\2', FIELDS)}>>")
    placed = looked.groupBy("path").applyInArrow(place, "path string, size long, block long, state int, row long, column long, error string")
    if whole:
        placed = placed.join(files.select("path", "content"), "path", "left")
    else:
        placed = placed.withColumn("content", F.lit(None).cast("binary"))
    return placed.repartition(tasks, "path", "block").mapInArrow(give, CELLS)
