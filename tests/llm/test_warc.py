import io
import json
import random
import zipfile
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.llm import warc


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '/root/testdata/{sf}/pages.parquet'")
    want = con.execute(warc.OP13_SQL)
    df = warc.op13(spark, f"/root/testdata/{sf}")
    assert [d[0] for d in want.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def plain(rows):
    pages = [(k, (html or "").encode()) for k, _, html in rows]
    least = {}
    for k, p in pages:
        if k is not None and len(p) >= 100:
            least[p] = min(k, least.get(p, k))
    out = []
    for k, p in pages:
        first = least.get(p, k)
        again = k is not None and first is not None and k > first
        out.append((k, len(p), sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_equal_payloads_and_edges(spark, tmp_path):
    r = random.Random(3)
    texts = [None, "", "é" * 50, "é" * 49 + "a", "x" * 99, "x" * 100, "y" * 100 + "\r\n\r\nWARC/1.1\r\n", "😀\0\r\n" * 40, "z" * 3_000_000]
    rows = [(k, r.choice(["http://a.example/b", None, "http://[bad", "HTTP://Ü.example/x y\nz?q=1"]), r.choice(texts)) for k in r.sample(range(10_000), 300)]
    rows += [(None, None, None), (None, "u", "x" * 100), (77_777, "u", "k" * 200), (77_777, "u", "k" * 200), (77_778, "u", "k" * 200)]
    d = spark.createDataFrame([(*x, "clash", 5) for x in rows], "page_id long, url string, html string, digest string, refers_to int")
    d.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(map(tuple, warc.op13(spark, str(tmp_path)).collect()), key=str) == plain(rows)


def test_many_copies_of_one_page(spark, tmp_path):
    rows = [(k, "u", "same " * 30 if k % 3 else f"own {k} " * 20) for k in range(6000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, warc.op13(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows) and sum(x[3] == "revisit" for x in got) == 3999


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op13(spark, str(tmp_path)).collect() == []


def test_packages_are_zip_files(spark, tmp_path):
    rows = [(k, f"http://h{k % 7}.example.com/p/{k}", f"<p>{k}</p>" * 60) for k in range(400)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    packages = warc.write_packages(d, str(tmp_path / "out"), package=10_000)
    listed = packages.collect()
    assert len(listed) > 2 and sum(x.records for x in listed) == 400
    for x in listed:
        with zipfile.ZipFile(x.path) as z:
            assert z.testzip() is None and sorted(z.namelist()) == ["archive/data.warc.gz", "indexes/index.cdx"]
            index = z.read("indexes/index.cdx").decode().splitlines()
            assert index == sorted(index) and len(index) == x.records
            entry = json.loads(index[0].split(" ", 2)[2])
            data = z.read("archive/data.warc.gz")[entry["offset"] : entry["offset"] + entry["length"]]
            assert f"WARC-Target-URI: {entry['url']}\r\n".encode() in zlib.decompress(data, 31)
    got = warc.read_records(warc.locate(packages)).select(F.element_at("headers", "warc-page-id").cast("long"), F.col("payload").cast("string"), "error").collect()
    assert sorted(map(tuple, got)) == sorted((k, html, None) for k, _, html in rows)


def lines(n, zipped=True):
    """Records of n payloads, as an archive and its index lines."""
    archive, index = b"", []
    for k in range(n):
        data = warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:x:{k}>")], f"payload {k}".encode())
        data = data if zipped else zlib.decompress(data, 31)
        index.append(f'com,x)/{k} 2000 {json.dumps({"offset": len(archive), "length": len(data), "filename": "a.warc.gz" if zipped else "a.warc"})}\n')
        archive += data
    return archive, "".join(index).encode()


def payloads(spark, *paths):
    d = spark.createDataFrame([(str(p),) for p in paths], "path string")
    return sorted((bytes(x.payload).decode() if x.payload is not None else None, x.error) for x in warc.read_records(warc.locate(d)).collect())


def test_foreign_packages(spark, tmp_path):
    archive, index = lines(20)
    raw, _ = lines(20, False)
    want = sorted((f"payload {k}", None) for k in range(20))
    kinds = {
        "plain": [("archive/a.warc.gz", archive), ("indexes/i.cdx", index), ("pages/pages.jsonl", b"{}")],
        "zipped index": [("indexes/i.cdx.gz", zlib.compress(index, 9, 31)), ("archive/a.warc.gz", archive)],
        "no index": [("archive/a.warc.gz", archive)],
        "no index, not zipped": [("archive/deep/a.warc", raw)],
        "empty archive": [("archive/a.warc.gz", b"")],
    }
    for name, members in kinds.items():
        for prefix, comment in ((b"", b""), (b"#!/bin/sh PK\5\6\n" * 9, b"PK\5\6 a comment")):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.comment = comment
                for m, data in members:
                    z.writestr(m, data)
            p = tmp_path / f"{name}{len(prefix)}.zip"
            p.write_bytes(prefix + held.getvalue())
            assert payloads(spark, p) == ([] if name == "empty archive" else want), name
    # many entries need ZIP64 records in the directory's end
    p = tmp_path / "many.zip"
    with zipfile.ZipFile(p, "w") as z:
        for k in range(66_000):
            z.writestr(f"x/{k}", b"")
        z.writestr("archive/a.warc.gz", archive)
        z.writestr("indexes/i.cdx", index)
    assert payloads(spark, p) == want
    p.write_bytes(b"in front" + p.read_bytes())
    assert payloads(spark, p) == want


def test_beyond_four_gigabytes_reads_little(tmp_path):
    """A sparse file: offsets need ZIP64 fields, and only the ends and the records are read."""
    archive, index = lines(5)
    p = tmp_path / "large.zip"
    with open(p, "wb") as out:
        z = warc.Package(out)
        z.begin("archive/a.warc.gz")
        z.add(archive)
        z.end()
        z.begin("data/other")
        out.seek(5 << 30)
        z.at = 5 << 30
        z.end()
        z.begin("indexes/i.cdx")
        z.add(index)
        z.end()
        z.close()
    assert len(zipfile.ZipFile(p).namelist()) == 3
    found = list(warc.layout(str(p)))
    f = warc.Ranges(str(p))
    assert [warc.parsed(f.get(s, n), True)[2] for _, s, n in found] == [f"payload {k}".encode() for k in range(5)]
    f = warc.Ranges(str(p))
    list(warc.directory(f))
    assert f.bytes < 200_000


def test_errors(spark, tmp_path):
    archive, index = lines(3)
    with zipfile.ZipFile(tmp_path / "d.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", archive)
    with pytest.raises(ValueError, match="stored"):
        list(warc.layout(str(tmp_path / "d.zip")))
    (tmp_path / "n.zip").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="directory"):
        list(warc.layout(str(tmp_path / "n.zip")))
    broken = archive[:40] + b"????" + archive[44:]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("archive/a.warc.gz", broken)
        z.writestr("indexes/i.cdx", index)
    got = [(x.payload, x.error) for x in warc.read_records(warc.locate(spark.createDataFrame([(str(tmp_path / "b.zip"),), (None,)], "path string"))).collect()]
    assert len(got) == 3 and sum(e is not None for _, e in got) == 1


def test_stretches_are_dealt_out(spark, tmp_path, monkeypatch):
    d = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("text "), "id").alias("html")).coalesce(1)
    packages = warc.write_packages(d, str(tmp_path / "o"))
    assert packages.count() >= 1
    monkeypatch.setattr(warc, "STRETCH", 2000)
    r = warc.read_records(warc.locate(packages))
    assert r.count() == 300 and r.select("path", (F.col("start") / 2000).cast("long")).distinct().count() > 10
