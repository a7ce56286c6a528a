"""Delimited files in blocks against a parser that goes character by character over the whole file."""

import random
from collections.abc import Iterator

import pytest

from larkspur.sources import delimited, files

MAX_COLUMNS, MAX_CELL = delimited.MAX_COLUMNS, delimited.MAX_CELL


def records(text: str, delimiter: str) -> Iterator[list[str]]:
    """Records of a delimited text. Quotes are doubled inside quotes; CR, LF and CRLF end a record; a blank line is one empty field. ValueError on text after a closing quote, an open quote, or a limit."""
    row, cell, state, i, n = [], [], "start", 0, len(text)

    def close() -> None:
        if len(row) >= MAX_COLUMNS or len(cell) > MAX_CELL:
            raise ValueError("a limit is exceeded")
        row.append("".join(cell))
        cell.clear()

    while i < n:
        ch = text[i]
        if state == "quoted":
            if ch != '"':
                cell.append(ch)
            elif i + 1 < n and text[i + 1] == '"':
                cell.append('"')
                i += 1
            else:
                state = "closed"
        elif ch == delimiter:
            close()
            state = "start"
        elif ch in "\r\n":
            i += ch == "\r" and i + 1 < n and text[i + 1] == "\n"
            close()
            yield row
            row, state = [], "start"
        elif state == "closed":
            if ch not in " \t":
                raise ValueError("text after a closing quote")
        elif ch == '"' and state == "start":
            state = "quoted"
        else:
            cell.append(ch)
            state = "plain"
        i += 1
    if state == "quoted":
        raise ValueError("a quote is not closed")
    if row or cell or state != "start":
        close()
        yield row


def whole(data, d=","):
    try:
        return [(r, c, v) for r, row in enumerate(records(data.decode("utf-8-sig"), d)) for c, v in enumerate(row)], ""
    except ValueError as e:
        return [], str(e)


def in_blocks(data, size, d=","):
    f = delimited.ranges.Bytes(data)
    n = -(-len(data) // size)
    try:
        starts, error = delimited.composed([delimited.summaries(delimited.text_of(f, k, size), d) for k in range(n)])
    except UnicodeDecodeError as e:
        return [], str(e)
    return ([x for k, s in enumerate(starts) for x in delimited.cells(f, k, size, *s, d)], "") if not error else ([], error)


def test_blocks_of_any_size_give_the_same_cells():
    r = random.Random(4)
    for n in range(4000):
        text = "".join(r.choice(['"', '"', ",", "\n", "\r", "\r\n", "a", "é", "😀", " ", "\t", '""', '"x"', '"y\n,"']) for _ in range(r.randrange(1, 30)))
        data = (("\ufeff" if r.random() < 0.1 else "") + text).encode()
        want = whole(data)
        for size in (1, 2, 3, 5, 8, 64):
            got = in_blocks(data, size)
            assert got == want or (want[1] and got[1]), (text, size, got, want)


def test_limits(monkeypatch):
    for name, value in (("MAX_COLUMNS", 3), ("MAX_CELL", 5)):
        monkeypatch.setattr(delimited, name, value)
        monkeypatch.setitem(globals(), name, value)
    r = random.Random(8)
    for _ in range(3000):
        data = "".join(r.choice([",", "\n", "a", "bb", '"', '""', '"c,c"', "\r\n"]) for _ in range(r.randrange(1, 14))).encode()
        want = whole(data)
        for size in (1, 2, 4, 50):
            got = in_blocks(data, size)
            assert got == want or (want[1] and got[1]), (data, size, got, want)


def test_a_large_file_is_many_tasks(spark, tmp_path):
    rows = [f'{k},"line one {k}\nline ""two"", {"é" * (k % 50)}\r\n\n",plain "text" {k}\n' for k in range(40_000)]
    data = "".join(rows).encode()
    (tmp_path / "large.csv").write_bytes(data)
    (tmp_path / "small.tsv").write_text("a\tb\n\n")
    (tmp_path / "bad.csv").write_bytes(b'x,"y\n' + data[:300_000].rsplit(b'"', 1)[0] + b'" z')
    (tmp_path / "torn.csv").write_bytes(b"a,\xc3")
    size = 50_000
    out = files.read_delimited(spark, str(tmp_path), size=size)
    got = {(r.file.rsplit("/", 1)[1], r.row_no, r.col_no): (r.value, r.error) for r in out.collect()}
    want = whole(data)[0]
    assert len(data) > 60 * size and len([k for k in got if k[0] == "large.csv"]) == len(want)
    assert all(got["large.csv", r, c] == (v, "") for r, c, v in want)
    assert [k[1:] for k in got if k[0] in ("bad.csv", "torn.csv")] == [(-1, -1)] * 2 and got["small.tsv", 1, 0] == ("", "")
    tasks = out.mapInArrow(lambda b: b, out.schema).select(delimited.F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_stores_that_only_spark_opens(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('a,"b\nc"\n')
    monkeypatch.setattr(delimited.ranges, "can_range", lambda address: False)
    assert sorted((r.row_no, r.col_no, r.value) for r in files.read_delimited(spark, str(tmp_path)).collect()) == [(0, 0, "a"), (0, 1, "b\nc")]


@pytest.mark.parametrize("text,error", [('"a"x,b\n', delimited.AFTER), ('a,"b\n', delimited.OPEN), ('"a" ,b', "")])
def test_errors(text, error):
    for size in (1, 3, 100):
        assert in_blocks(text.encode(), size)[1] == error
