"""Small cases with known results, and properties: idempotent merges, chunks that make up the text, stable pages."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import catalog, fleet, search, state, text
from larkspur.sources import files


def test_scalars(spark):
    cases = [
        (S.norm_ext(F.lit(" ..PDF ")), ".pdf"), (S.norm_ext(F.lit(" ")), ""), (S.norm_ext(F.lit(""), F.lit("a.Txt")), ".txt"), (S.path_identity(F.lit("c:\\a\\b\\")), "C:/A/B"), (S.user_folder(F.lit("x.txt")), "_ROOT"),
        (S.archive_device(F.lit("Jo Ä!")), "OLD-JO_Ä_"), (S.archive_device(F.lit(" ")), "OLD-OLD_USER"), (S.human_size(F.lit(1536).cast("long")), "1.5 KB"), (S.human_size(F.lit(1023).cast("long")), "1023 B"), (S.human_size(F.lit(1 << 20).cast("long")), "1 MB"),
        (S.version_status(F.lit("1.0"), F.lit("1.0.0")), "outdated"), (S.version_status(F.lit("dev"), F.lit("1.0")), "unknown"), (S.version_status(F.lit("2.1"), F.lit("2.0.9")), "newer"), (S.retry_delay(F.lit(1)), 30), (S.retry_delay(F.lit(40)), 1800),
        (S.column_name(F.lit(0)), "A"), (S.column_name(F.lit(25)), "Z"), (S.column_name(F.lit(26)), "AA"), (S.column_name(F.lit(701)), "ZZ"), (S.column_name(F.lit(702)), "AAA"), (S.column_name(F.lit(2047)), "BZT"),
        (S.infer_type(F.lit("2024-01-31")), "date"), (S.infer_type(F.lit("-7")), "integer"), (S.infer_type(F.lit("1e3")), "number"), (S.infer_type(F.lit("TRUE")), "boolean"), (S.infer_type(F.lit(" ")), "null"), (S.merged_type(F.lit(6)), "number"), (S.merged_type(F.lit(3)), "string"),
        (S.object_key("p", F.lit("u"), F.lit("a/../b//c\\d")), "p/u/a/b/_/c/d"), (S.content_type(F.lit(".zip")), "application/octet-stream"), (S.norm_level(F.lit(None).cast("string")), "INFO"),
    ]
    got = spark.range(1).select(*(column.alias(str(k)) for k, (column, _) in enumerate(cases))).first()
    assert list(got) == [want for _, want in cases]


def test_filter_and_policy_errors():
    for bad in ({"min_size": -1}, {"min_size": 5, "max_size": 4}, {"source_type": "x"}, {"modified_after": "2024-01-02", "modified_before": "2024-01-01"}):
        with pytest.raises(ValueError):
            catalog.validate_filter(bad)
    with pytest.raises(ValueError):
        catalog.normalize_policy(["."], 1)
    assert catalog.normalize_policy(["PDF", " .pdf", "txt"], 5) == [".pdf", ".txt"]


def test_identity_codes(spark):
    rows = [("", "", "", 5, "", "", "", 5, False), ("", "", "", 5, "v", "", "", 5, False), ("a", "", "", 5, "b", "", "", 5, False), ("a", '"X"', "", 5, "a", "x", "", 5, False), ("a", "x", "", 5, "a", "y", "", 5, False), ("a", "", "AA", 5, "a", "", "bb", 5, False), ("a", "", "", 5, "a", "", "", 6, False), ("a", "", "", 5, "a", "", "", 99, False), ("", "", "", 5, "", "", "", 5, True)]
    df = spark.createDataFrame(rows, "job_version_id string, job_etag string, job_sha string, job_size long, got_version_id string, got_etag string, got_sha string, got_size long, is_deleted boolean")
    got = [(r.code, r.disposition) for r in catalog.verify_identity(df, 50).collect()]
    assert got == [("source_version_identity_missing", "retry"), ("ok", "ok"), ("source_version_mismatch", "retry"), ("ok", "ok"), ("source_etag_mismatch", "retry"), ("checksum_mismatch", "reject"), ("source_size_mismatch", "retry"), ("source_too_large", "reject"), ("document_deleted", "reject")]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('\ufeffClient,Client,,Amount,Approved,OrderDate\r\n"A, ""B""",x,,12.5,true,2024-01-31\r\n"two\nlines" ,y,,7,false,2024-02-01'.encode())
    (tmp_path / "b.tsv").write_text("a\tb\n\nc\td\n")
    (tmp_path / "bad.csv").write_text('"a"x,b\n')
    (tmp_path / "open.csv").write_text('a,"b\n')
    (tmp_path / "empty.csv").write_text("")
    cells = files.read_delimited(spark, str(tmp_path))
    rows = {(r.file.rsplit("/", 1)[1], r.row_no, r.col_no): r.value for r in cells.collect()}
    assert rows["a.csv", 1, 0] == 'A, "B"' and rows["a.csv", 2, 0] == "two\nlines" and rows["b.tsv", 1, 0] == "" and rows["b.tsv", 2, 1] == "d"
    assert rows["bad.csv", -1, -1] == "" and ("open.csv", -1, -1) in rows and not any(k[0] == "empty.csv" for k in rows)
    p = {r.name: (r.type, r.rows, r.boundary) for r in text.csv_profile(cells.where("file like '%/a.csv'")).orderBy("col_no").collect()}
    assert list(p) == ["Client", "Client_2", "Column3", "Amount", "Approved", "OrderDate"]
    assert [p[k][0] for k in ("Amount", "Approved", "OrderDate")] == ["number", "boolean", "date"] and p["Amount"][1:] == (2, "A1:F3")


def test_sheet_types_from_sample(spark):
    cells = [("f", "s", 0, 0, " "), *(("f", "s", 3, k, v) for k, v in enumerate(("Client", "Amount", "Approved"))), *(("f", "s", r, k, v) for r in (5, 6) for k, v in enumerate(("x", "12.5", "true")))]
    got = text.sheet_profile(spark.createDataFrame(cells, "file string, sheet string, row_no int, col_no int, value string")).orderBy("col_no").collect()
    assert [(r.name, r.type, r.rows) for r in got] == [("Client", "string", 2), ("Amount", "number", 2), ("Approved", "boolean", 2)]


def test_heading_path(spark):
    b = spark.createDataFrame([("d", 0, 1, "A"), ("d", 1, 3, "C"), ("d", 2, None, "t"), ("d", 3, 2, "B"), ("d", 4, None, "u"), ("d", 5, 1, "Z"), ("d", 6, None, "v")], "doc string, block_no int, level int, text string")
    got = {r.block_no: (r.path, r.heading) for r in text.heading_path(b).collect()}
    assert got[2] == (["A", "C"], "C") and got[4] == (["A", "B"], "B") and got[6] == (["Z"], "Z")


def test_slides(spark):
    rows = [("d", 1, "box", 0, "title", "Launch Plan"), ("d", 1, "box", 1, "body", "body text"), ("d", 1, "table", 2, None, "Owner | Date"), ("d", 1, "notes", 3, None, "notes"), ("d", 1, "box", 4, "footer", "no"), ("d", 1, "box", 5, "body", "body text")]
    r = text.slide_text(spark.createDataFrame(rows, "doc string, slide int, part string, seq int, placeholder string, text string")).first()
    assert (r.heading, r.content) == ("Launch Plan", "Launch Plan\nbody text\nOwner | Date\nnotes")


def test_chunks():
    t = "Large searchable paragraph.\n" * 5000
    parts = text.cut_text(t, 50_000)
    assert "".join(parts) == t and all(0 < len(p) <= 50_000 for p in parts) and all(p.endswith("\n") for p in parts) and len(parts) > 1
    assert text.cut_text("x" * 120_001, 50_000) == ["x" * 50_000, "x" * 50_000, "x" * 20_001] and text.cut_text("", 5) == [""]


def test_mime(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<x/>")
    rows = [("a.csv", b"a,b", files.OCTETS), ("b.docx", z.getvalue(), ""), ("c.docx", b"%PDF-1.7", ""), ("d.exe", b"MZ", ""), ("e.txt", b"a\x00b", ""), ("f.txt", b"", ""), ("g.txt", "é".encode(), "image/png"), ("h.png", bytes.fromhex("89504E470D0A1A0A00"), "image/png")]
    df = spark.createDataFrame([(n, bytearray(c), d) for n, c, d in rows], "name string, content binary, declared string").withColumn("head", F.substring("content", 1, files.HEAD))
    got = {r.name: (r.detected, r.code) for r in files.mime_gate(files.mime_detect(df)).collect()}
    assert got["a.csv"] == ("text/plain", "accepted") and got["b.docx"][1] == "accepted" and got["c.docx"][1] == "mime_mismatch" and got["d.exe"][1] == "unsupported_format"
    assert got["e.txt"][0] == files.OCTETS and got["f.txt"][0] == files.OCTETS and got["g.txt"][1] == "declared_mime_mismatch" and got["h.png"][1] == "accepted"


def test_heads_are_read_by_ranges(spark, tmp_path):
    def packed(name, *entries, front=0):
        with open(tmp_path / name, "wb") as f:
            with zipfile.ZipFile(f, "w") as z:
                z.writestr("a/first", b"x")
                if front:  # a sparse gap, as if of a large member
                    f.seek(front)
                    z.start_dir = front
                for e in entries:
                    z.writestr(e, b"<x/>")

    packed("a.docx", "Word\\Document.XML")
    packed("b.xlsx", "xl/workbook.xml", front=3 << 30)
    packed("c.zip", "other")
    packed("d.zip", *(f"e{k}" for k in range(60)))
    (tmp_path / "e.zip").write_bytes(b"PK\x03\x04 no zip")
    (tmp_path / "f.pdf").write_bytes(b"%PDF-" + b"x" * 100_000)
    (tmp_path / "g.pdf").write_bytes(b"%PDF")
    heads = files.mime_detect(files.read_heads(spark, str(tmp_path), most=50))
    got = {r.path.rsplit("/", 1)[1]: (r.detected, r.rejected, r.bytes_read) for r in heads.collect()}
    zipped, word, sheet = "application/zip", files.ZIP_PARTS["word/document.xml"], files.ZIP_PARTS["xl/workbook.xml"]
    want = {"a.docx": (word, ""), "b.xlsx": (sheet, ""), "c.zip": (zipped, ""), "d.zip": (zipped, "archive_entry_limit_exceeded"), "e.zip": (zipped, "invalid_archive"), "f.pdf": ("application/pdf", ""), "g.pdf": ("text/plain", "")}
    assert {k: v[:2] for k, v in got.items()} == want and all(v[2] < 100_000 for v in got.values())
    (tmp_path / "b.xlsx").unlink()
    raw = files.mime_detect(files.read_raw(spark, str(tmp_path)), most=50)
    assert {r.path.rsplit("/", 1)[1]: (r.detected, r.rejected) for r in raw.collect()} == {k: v for k, v in want.items() if k != "b.xlsx"}


def test_parse_query():
    assert search.parse_query('a "b c" -d OR -"e f" G') == [search.Clause(("a", "b", "c"), (("b", "c"),), (("d",),)), search.Clause(("g",), (), (("e", "f"),))]
    for blank in ("", '""', "-x", "OR"):
        with pytest.raises(ValueError):
            search.parse_query(blank)


def test_highlight():
    t = " ".join(["x"] * 100 + ["Needle,"] + ["y"] * 200 + ["needle"] + ["z"] * 5)
    m = search.marked(t, ["needle"])
    assert m.count("**") == 4 and all(20 <= len(p.split()) <= 45 or p.endswith("z") for p in m.split(" … ")) and search.marked(t, ["other"]) == ""


def test_merges_are_idempotent(spark):
    schema = "device_code string, full_path string, seq long, size_bytes long, is_deleted boolean"
    cur = spark.createDataFrame([("D", "a", 1, 1, False), ("D", "b", 2, 2, False)], schema)
    batch = spark.createDataFrame([("D", "a", 3, 5, True), ("D", "a", 4, 6, False), ("D", "A", 5, 7, False), ("D", " ", 6, 8, False)], schema)
    first = state.merge_file_index(cur, batch)
    rows = sorted(map(tuple, first.collect()))
    assert rows == [("D", "A", 5, 7, False), ("D", "a", 4, 6, False), ("D", "b", 2, 2, False)] and sorted(map(tuple, state.merge_file_index(first, batch).collect())) == rows
    devices = spark.createDataFrame([("D", "h", "u", "1", None, None)], "device_code string, hostname string, username string, agent_version string, last_seen_at timestamp_ntz, registered_at timestamp_ntz")
    beats = spark.sql("select * from values ('D', 'h2', 'u', '2', timestamp_ntz'2024-01-02 00:00:00'), ('E', 'h3', 'u', '2', timestamp_ntz'2024-01-01 00:00:00'), ('D', 'h1', 'u', '1', timestamp_ntz'2024-01-01 00:00:00') as t(device_code, hostname, username, agent_version, ts)")
    once = state.fold_heartbeats(devices, beats)
    assert {(r.device_code, r.hostname) for r in once.collect()} == {("D", "h2"), ("E", "h3")} and sorted(map(str, state.fold_heartbeats(once, beats).collect())) == sorted(map(str, once.collect()))


def test_pages_make_up_the_whole(spark):
    df = spark.range(23).withColumn("k", F.col("id") % 4)
    order = [F.asc("k"), F.asc("id")]
    pages = [catalog.page(df, order, at, 10).collect() for at in (0, 10, 20)]
    assert [r.id for p in pages for r in sorted(p, key=lambda r: r.position)] == [r.id for r in df.orderBy(*order).collect()]
    assert [{r.next_offset for r in p} for p in pages] == [{10}, {20}, {None}]


def test_seek_pages_make_up_the_whole(spark):
    rows = [(k, None if k % 7 == 0 else k % 4, None if k % 5 == 0 else f"n{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, k int, name string").withColumn("at", F.expr("timestamp_ntz'2024-01-01 00:00:00.123456' + make_dt_interval(0, 0, 0, cast(k as decimal(18,6)) / 1000000)"))
    for order in ([("k", False), ("id", False)], [("at", True), ("name", False), ("id", True)], [("name", True), ("k", True), ("id", False)]):
        want = [r.id for r in df.orderBy(*(F.col(c).desc() if d else F.col(c).asc() for c, d in order)).collect()]
        got, key = [], None
        while True:
            page = catalog.seek_page(df, order, 17, key).collect()
            if not page:
                break
            got, key = got + [r.id for r in page], page[-1].continuation
        assert got == want
    assert "TakeOrderedAndProject" in catalog.seek_page(df, [("id", False)], 5, '{"id": "9"}')._jdf.queryExecution().executedPlan().toString()


def test_a_failed_or_requeued_job_has_no_lease(spark):
    j = spark.sql("select * from values (1, 7L, 'running', 't', timestamp_ntz'2024-01-01 00:00:00', 1, 5, timestamp_ntz'2024-01-01 00:00:00', '', 'old'), (2, 8L, 'failed', 's', timestamp_ntz'2024-01-01 00:00:00', 1, 5, timestamp_ntz'2024-01-01 00:00:00', 'x', 'old') as t(job_id, version_id, status, lease_token, lease_until, attempt_count, max_attempts, next_attempt_at, error_code, error_message)")
    f = spark.createDataFrame([(1, "t", "reject", "bad", "why")], "job_id int, token string, disposition string, error string, message string")
    got = {r.job_id: r for r in state.apply_failures(j, f, "2024-06-01 00:00:00").collect()}
    assert got[1].lease_token is got[1].lease_until is None and got[1].error_message == "why" and got[1].completed_at == got[1].next_attempt_at and got[2].lease_token == "s" and got[2].error_message == "old"
    again = state.requeue(j, j.select("job_id"), "2024-06-01 00:00:00")
    got = {r.job_id: r for r in again.collect()}
    assert got[1].outcome == "refused" and got[1].lease_token == "t" and got[2].lease_token is got[2].lease_until is None and (got[2].status, got[2].error_message) == ("queued", "")
    v = spark.createDataFrame([(7, "failed", "e"), (8, "failed", "e"), (9, "failed", "e")], "version_id long, extraction_status string, error_code string")
    assert sorted(map(tuple, state.reset_requeued(v, again).collect())) == [(7, "failed", "e"), (8, "queued", ""), (9, "failed", "e")]


def test_exclusions(spark):
    f = spark.createDataFrame([("D", p.rsplit("\\", 1)[0], p, p.rsplit("\\", 1)[1], "." + p.rsplit(".", 1)[1]) for p in ("C:\\A\\x.txt", "C:\\A\\Temp\\x.txt", "C:\\A\\.git\\x.txt", "C:\\B\\C\\x.txt", "C:\\A\\x.TMP", "C:\\A\\.x.txt", "C:\\BB\\x.txt")], "device_code string, directory_path string, full_path string, file_name string, extension string")
    x = spark.createDataFrame([("D", "folder_path", "temp", True), ("D", "folder_path", "c:\\b\\", True), ("D", "file_extension", "tmp", True), ("D", "folder_name", "A", False), ("E", "folder_name", "BB", True)], "device_code string, exclusion_type string, value string, is_active boolean")
    assert sorted(r.full_path for r in catalog.exclude_files(f, x).collect()) == ["C:\\A\\x.txt", "C:\\BB\\x.txt"]


def test_claims_and_sweeps(spark):
    j = spark.sql("select * from values (1, 1, 'v1', 'running', 0, 5, 5, timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:00:00', ''), (2, 2, 'v1', 'queued', 0, 0, 5, cast(null as timestamp_ntz), timestamp_ntz'2024-01-01 00:00:00', 'x'), (3, 3, 'v1', 'queued', 9, 0, 5, cast(null as timestamp_ntz), timestamp_ntz'2025-01-01 00:00:00', '') as t(job_id, version_id, pipeline_version, status, priority, attempt_count, max_attempts, lease_until, next_attempt_at, error_code)").withColumns({"created_at": F.col("next_attempt_at"), "started_at": F.col("lease_until")})
    v = spark.sql("select * from values (1, '.pdf'), (2, '.PDF'), (3, '.pdf') as t(version_id, file_extension)")
    got = state.claim_batch(j, v, "v1", [".pdf"], 10, "2024-06-01 00:00:00").collect()
    assert [(r.job_id, r.status, r.attempt_count, r.error_code) for r in got] == [(2, "running", 1, "")]
    assert {(r.job_id, r.status) for r in state.sweep_expired(j, "2024-06-01 00:00:00").collect()} == {(1, "dead_letter"), (2, "queued"), (3, "queued")}


def test_dispatch_and_gaps(spark):
    r = spark.sql("select id, 'D' as device_code, 'folder' as request_type, 'pending' as status, timestamp_ntz'2024-01-01 00:00:00' as requested_at from range(7)")
    c = spark.sql("select 1 as id, 'D' as device_code, 'START_SCAN' as command_type, 'completed' as status, timestamp_ntz'2024-01-01 00:00:00' as requested_at")
    assert sorted(x.id for x in fleet.dispatch_commands(r, c).collect()) == [0, 1, 2, 3, 4]
    b = spark.sql("select 'D' as device_code, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 5 as int)) as ts from range(2)")
    assert fleet.silent_gaps(b, 2, "2024-01-01 00:06:00").count() == 1


def test_mime_of_long_and_empty_texts(spark):
    from larkspur.plans import flows

    for i, t, want in ((2, "a" * 8191 + "é", files.OCTETS), (2, "a" * 8190 + "é" * 9, "text/plain"), (2, "", files.OCTETS), (2, None, files.OCTETS), (1, "a" * 8191, files.OCTETS), (1, "a" * 8192, "text/plain"), (4, "é" * 9000, "application/pdf")):
        got = flows.p7_whole(spark.createDataFrame([(i, t)], "doc_id long, text string")).collect()
        assert [(r.detected, r.n) for r in got] == [(want, 1)]


def test_streams_go_on_after_a_restart(spark, tmp_path):
    from larkspur.streaming import streams

    schema = "device_code string, full_path string, seq long, size_bytes long"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: sorted(map(tuple, streams.stream_file_index(streams.files(spark, f"{tmp_path}/in", schema), spark.createDataFrame([], schema), f"{tmp_path}/state").collect()))
    put(("D", "a", 1, 1))
    put(("D", "b", 2, 2))
    assert run() == run() == [("D", "a", 1, 1), ("D", "b", 2, 2)]
    put(("D", "a", 3, 9))
    assert run() == run() == [("D", "a", 3, 9), ("D", "b", 2, 2)]
    assert len([p for p in (tmp_path / "state" / "manifest").iterdir() if p.suffix == ".json"]) == 2


def test_a_batch_writes_what_it_touches_and_only_once(spark, tmp_path, monkeypatch):
    from larkspur.sources import store
    from larkspur.streaming import streams

    schema = "device_code string, full_path string, seq long, size_bytes long"
    start = spark.createDataFrame([("D", f"p{k}", k, k) for k in range(3000)], schema)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "state" / "data").rglob("*.parquet"))
    run = lambda: streams.fold(streams.files(spark, f"{tmp_path}/in", schema), start, state.merge_file_index, f"{tmp_path}/state", ("device_code", "full_path"), kept=9)
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(("D", "p1", 5000, 1))
    assert run().count() == 3000
    before = size()
    put(("D", "p2", 5001, 7), ("D", "p2", 5002, 8), ("D", "new", 5003, 9))
    out = run()
    assert size() - before < before / 10
    assert out.count() == 3001 and {r.size_bytes for r in out.where("full_path = 'p2'").collect()} == {8}
    put(("D", "p3", 5004, 1))
    with monkeypatch.context() as m:  # the batch is published, then the stream fails before it is noted
        m.setattr(store, "vacuum", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run()
    at = store.snapshot(spark, f"{tmp_path}/state")
    assert at.note["batch"] == 2
    out = run()
    assert store.snapshot(spark, f"{tmp_path}/state") == at and {r.seq for r in out.where("full_path = 'p3'").collect()} == {5004}


def test_outputs_are_published_together(spark, tmp_path):
    schema = "version_id long, pipeline_version string, ordinal int, content string"
    rows = [(v, p, k, "old") for v in range(30) for p in ("v0", "v1") for k in range(2)]
    to, key = str(tmp_path / "o"), lambda df: sorted(map(str, df.collect()))
    files.write_outputs(spark.createDataFrame(rows, schema), to, groups=8)
    opened = files.read_outputs(spark, to)
    bad = spark.createDataFrame([(3, "v1", 0, "new"), (4, "v1", 0, "new")], schema)
    with pytest.raises(Exception, match="stop here"):
        files.write_outputs(bad.withColumn("content", F.when(F.col("version_id") == 4, F.raise_error(F.lit("stop here"))).otherwise(F.col("content"))), to)
    assert key(files.read_outputs(spark, to)) == key(spark.createDataFrame(rows, schema))
    empty = spark.createDataFrame([(5, "v0"), (6, "v1"), (77, "v1"), (None, "v1")], "version_id long, pipeline_version string")
    files.write_outputs(spark.createDataFrame([(3, "v1", 9, "new"), (None, "v1", 1, "x")], schema), to, replaced=empty)
    want = [r for r in rows if r[:2] not in ((3, "v1"), (5, "v0"), (6, "v1"))] + [(3, "v1", 9, "new")]
    assert key(files.read_outputs(spark, to)) == key(spark.createDataFrame(want, schema)) and key(opened) == key(spark.createDataFrame(rows, schema))


def test_alerts_come_by_timer(spark, tmp_path):
    from larkspur.operators import fleet
    from larkspur.streaming import streams

    schema = "device_code string, ts timestamp"

    def put(*rows):
        values = ", ".join(f"('{d}', timestamp'2024-01-01 {t}')" for d, t in rows)
        spark.sql(f"select * from values {values} as x(device_code, ts)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        out = streams.stream_alerts(streams.files(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", 2)
        return sorted((r.device_code, f"{r.at:%H:%M:%S}", r.status) for r in out.collect())

    put(("A", "10:00:00"), ("B", "10:00:30"), ("A", "10:01:00"), ("A", "10:00:20"))
    first = [("A", "10:00:00", "online"), ("B", "10:00:30", "online")]
    assert run() == first
    put(("B", "10:01:30"))
    assert run() == first
    put(("B", "10:03:11"))  # the watermark passes A's timer though A is silent
    assert run() == sorted([*first, ("A", "10:03:00", "offline")])
    put(("A", "10:03:05"), ("A", "09:00:00"), ("B", "10:09:00"))  # back; a beat behind the watermark; a silence of B between two beats
    want = sorted([*first, ("A", "10:03:00", "offline"), ("A", "10:03:05", "online"), ("A", "10:05:05", "offline"), ("B", "10:05:11", "offline"), ("B", "10:09:00", "online")])
    assert run() == want and run() == want
    beats = spark.read.parquet(f"{tmp_path}/in").where("ts > '2024-01-01 09:30:00'").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    gaps = fleet.silent_gaps(beats, 2, "2024-01-01 10:09:00").collect()
    assert {(g.device_code, f"{g.offline_at:%H:%M:%S}") for g in gaps} == {x[:2] for x in want if x[2] == "offline"}
