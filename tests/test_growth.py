"""What plans and tasks must not do as tables grow."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from larkspur import fixtures, plans
from larkspur.operators import catalog, state, text
from larkspur.sources import documents


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_listed_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v/{k % 2}", f'{{"é": {k}}}') for k in range(50)], "version_id long, pipeline_version string, json string").repartition(3)
    documents.write_documents(rows, str(tmp_path))
    back = documents.read_documents(spark, str(tmp_path))
    assert "FileScan" not in plan(back), "the driver lists no files"
    assert sorted(map(tuple, back.collect())) == sorted((str(r.version_id), r.pipeline_version, r.json) for r in rows.collect())


def test_chunks_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(text, "BATCH", 50)
    rows = [(k, "ab\ncdé" * k, k * 0.5) for k in range(40)] + [(99, None, 0.0)]
    out = text.chunk_sections(spark.createDataFrame(rows, "section_id long, content string, score double").coalesce(1), 8)
    assert "MapInArrow" in plan(out) and "ArrowEvalPython" not in plan(out), "no batch holds all chunks of its rows"
    want = [(k, c, s, i, len(text.cut_text(c0, 8))) for k, c0, s in rows[:40] for i, c in enumerate(text.cut_text(c0, 8))]
    assert out.columns == ["section_id", "content", "score", "chunk_index", "chunk_count"] and sorted(map(tuple, out.collect())) == sorted(want)


def test_structured_texts_move_once(spark):
    v = spark.createDataFrame([(1, 1, "a", "f", {"k": "v"}, ["w"])], "version_id long, document_id long, file_name string, format string, metadata map<string,string>, warnings array<string>").hint("merge")
    d = spark.createDataFrame([(1, "s", "d")], "document_id long, source_type string, device_code string")
    s = spark.createDataFrame([(1, "v1", k, "t", "h", f"c{k}", "") for k in range(3)], "version_id long, pipeline_version string, ordinal int, section_type string, heading string, content string, ocr_content string")
    out = text.structured_json(v, d, s)
    moved = [x for x in plan(out).splitlines() if "Exchange hashpartitioning(version_id" in x]
    assert len(moved) == 2 and not any("pipeline_version" in x for x in moved), "sections by their version, and versions"
    assert out.where(F.get_json_object("json", "$.sections[2].content") == "c2").count() == 1


def test_backfill_moves_versions_as_ids(spark):
    cols = "object_key string, size_bytes long, {} timestamp_ntz, object_version_id string, etag string, sha256 string"
    at = datetime(2024, 1, 1)
    s = [(k, "automatic_upload" if k % 2 else "old_user_data", "completed" if k < 8 else "failed", at, f"o{k}", k, at, "", "e", "h") for k in range(9)]
    s[7] = (*s[7][:7], None, "e", "h")
    d = [(k, r[1], k) for k, r in enumerate(s)]
    v = [(k, k, f"o{k}", k + (k == 3), at, "any", "e" if k != 4 else "f", "h") for k in range(9)] + [(20, 3, "o3", 3, at, "v", "e", "h")]
    s = spark.createDataFrame(s, "id long, source_type string, status string, updated_at timestamp_ntz, " + cols.format("modified_at"))
    d = spark.createDataFrame(d, "document_id long, source_type string, source_record_id long")
    v = spark.createDataFrame(v, "version_id long, document_id long, " + cols.format("source_modified_at")).repartition(4, "document_id")
    j = spark.createDataFrame([(k, "v0" if k == 6 else "v1") for k in (0, 1, 1, 3, 4, 5, 6, 7, 20)], "version_id long, pipeline_version string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = catalog.backfill_candidates(s, d, v, j, "v1", 10)
        moved = [x for x in plan(out).splitlines() if "Exchange hashpartitioning" in x]
        assert not any("object_key" in x for x in moved) and sum("REPARTITION" in x for x in moved) == 1 and sum("version_id" in x for x in moved) == 2, "only ids of versions move"
        assert [(r.id, r.position) for r in out.orderBy("position").collect()] == [(7, 1), (2, 2), (4, 3), (6, 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def dealt(df):
    """The numbers of parts of the shuffles that are asked for, and all shuffles."""
    moved = [x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x]
    return [int(re.search(r", (\d+)\), REPARTITION_BY_NUM", x)[1]) for x in moved if "REPARTITION_BY_NUM" in x], moved


def test_joins_are_dealt_by_the_size_of_the_input(spark):
    where = "/root/testdata/sf0.001"
    assert fixtures.parts(spark, where, "fx_jobs", "fx_versions") == 8 * spark.read.parquet(f"{where}/lineitem.parquet").rdd.getNumPartitions()
    for name in ("a1_storage_stats", "m10_completed_outputs"):
        assert set(dealt(plans.QUERIES[name](spark, where))[0]) == {fixtures.parts(spark, where, "fx_documents", "fx_versions")}, name


def test_storage_is_counted_by_breakdown(spark):
    d = spark.createDataFrame([(k, f"d{k % 3}", "", "s", k == 5) for k in range(6)], "document_id long, device_code string, department string, source_type string, is_deleted boolean")
    v = spark.createDataFrame([(k % 6, ".PDF" if k % 2 else "", k) for k in range(60)], "document_id long, file_extension string, size_bytes long")
    out = catalog.storage_stats(d, v, parts=3)
    assert not any("file_extension" in x and "device_code" in x for x in dealt(out)[1]), "no shuffle of rows by all keys at once"
    got = {(r.breakdown, r.key): (r.documents, r.versions, r.bytes) for r in out.collect()}
    assert got[("total", "")] == (5, 50, sum(k for k in range(60) if k % 6 != 5)) and got[("device", "d2")] == (None, 10, sum(k for k in range(60) if k % 6 == 2))
    assert got == {(r.breakdown, r.key): (r.documents, r.versions, r.bytes) for r in catalog.storage_stats(d, v).collect()} and len(got) == 8


def test_completed_outputs_in_parts(spark):
    at, late = "2024-01-01 00:00:00", datetime(2030, 1, 1)
    j = spark.createDataFrame([(k, k % 4, "p" if k < 4 else "q", "running" if k != 2 else "queued", late, k, "") for k in range(8)], "job_id long, version_id long, pipeline_version string, status string, lease_until timestamp_ntz, lease_token long, error_code string")
    v = spark.createDataFrame([(k, "queued", "", "", "", 0, 0, "") for k in range(4)], "version_id long, extraction_status string, object_version_id string, etag string, sha256 string, page_count int, section_count long, pipeline_version string")
    of = lambda text, n: j.select("version_id", "pipeline_version", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("ordinal"), F.lit(text).alias("content"))
    r = j.where("job_id % 2 = 0").select("job_id", F.when(F.col("job_id") == 6, -1).otherwise(F.col("lease_token")).alias("token"), F.lit("o").alias("object_version_id"), F.lit("e").alias("etag"), F.lit("h").alias("sha256"), F.lit(1).alias("page_count"))
    for parts in (None, 3):
        out = state.apply_completions(j, v, of("old", 1), of("old", 1), r.unionByName(r), of("new", 2), of("new", 1), at, parts)
        hit = {(0, "p"), (0, "q")}  # of 2 the job does not run, of 6 the token is stale
        want = sorted((x, p, n, "new" if (x, p) in hit else "old") for x in range(4) for p in "pq" for n in ((1, 2) if (x, p) in hit else (1,)))
        assert sorted(map(tuple, out["sections"].collect())) == want and out["derivatives"].where("content = 'new'").count() == 2
