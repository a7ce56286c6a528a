"""Queries over sources, sinks and streams: they write data derived from the tables to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur import fixtures
from larkspur.fixtures import ONLINE_MINUTES
from larkspur.plans.registry import query, source
from larkspur.plans.state import INDEX, beats
from larkspur.sources import documents, files, tables
from larkspur.streaming import streams


def counted(tables):
    """name, n and filled: rows, and values that are not null, of each table."""
    out = None
    for name, t in tables.items():
        filled = sum((F.count(c) for c in t.columns), F.lit(0)).cast("long")
        n = t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), filled.alias("filled"))
        out = n if out is None else out.unionByName(n)
    return out


def filled_sql(tables):
    """The same in SQL, for a table or view and its columns."""
    return " union all ".join(f"select '{name}' as name, count(*) as n, {' + '.join(f'count({c})' for c in columns)} as filled from {view}" for name, view, columns in tables)


@source("s1_read_tables", filled_sql((t, t, [c.split()[0] for c in ddl.split(", ")]) for t, ddl in fixtures.GIVEN.items()))
def s1(spark, sf_dir):
    return counted(tables.read_tables(spark, sf_dir, fixtures.TABLES, fixtures.GIVEN))


#: Tables of the catalogue that the fixtures have, and which of their columns.
STORED_AS = (
    ("devices", "fx_devices", ("device_code", "nickname", "hostname", "username", "agent_version", "last_seen_at", "registered_at", "is_active")),
    ("documents", "fx_documents", ("document_id", "source_type", "source_record_id", "device_code", "display_name", "classification", "department", "is_deleted", "created_at", "updated_at")),
    ("versions", "fx_versions", ("version_id", "document_id", "version_number", "file_name", "file_extension", "size_bytes", "source_modified_at", "extraction_status")),
    ("jobs", "fx_jobs", ("job_id", "version_id", "pipeline_version", "status", "priority", "attempt_count", "max_attempts", "lease_until", "next_attempt_at", "error_code", "created_at", "updated_at", "started_at")),
    ("sections", "fx_sections", ("section_id", "version_id", "pipeline_version", "ordinal", "section_type", "heading", "content", "ocr_content")),
)


@query("s1_catalogue_tables", filled_sql(STORED_AS), *(view for _, view, _ in STORED_AS))
def s1_catalogue(*views):
    """Tables written with ids as text, read again with the fixed schemas: columns that are not there are null."""
    spark, to = views[0].sparkSession, files.shared_folder(views[0].sparkSession)
    for (name, _, columns), v in zip(STORED_AS, views, strict=True):
        kinds = dict(x.split() for x in tables.SCHEMAS[name].split(", "))
        v.select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns)).write.parquet(f"{to}/{name}.parquet")
    return counted(tables.read_tables(spark, to, [name for name, _, _ in STORED_AS]))


@query("s2_read_delimited", "select cast(k as int) as col_no, v as value, count(*) as n from (select unnest([0, 1, 2]) as k, unnest([p_name, 'a \"q\", ' || p_brand, '']) as v from part) group by all", "part")
def s2(part):
    spark, to = part.sparkSession, files.shared_folder(part.sparkSession)
    line = F.concat("p_name", F.lit(',"a ""q"", '), "p_brand", F.lit('",'))
    part.select(line.alias("value")).repartition(4).write.text(to)
    cells = files.read_delimited(spark, f"{to}/*.txt")
    return cells.groupBy("col_no", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s4_read_agent_log",
    "select cast(id as varchar) as request_id, case when upper(trim(level)) = '' then 'INFO' else upper(trim(level)) end as level, device_code as device, category as step, 'done | ' || category as message from fx_logs",
    "fx_logs",
)
def s4(logs):
    spark, to = logs.sparkSession, files.shared_folder(logs.sparkSession)
    line = F.concat(F.lit("2024-01-01 | "), "level", F.lit(" | Device="), "device_code", F.lit(" | RequestId="), F.col("id").cast("string"), F.lit(" | Step="), "category", F.lit(" | done | "), "category", F.lit(" | Details=-"))
    logs.select(line.alias("value")).write.text(to)
    return files.read_agent_log(spark, f"{to}/*.txt").select("request_id", "level", "device", "step", "message")


@query("s5_write_outputs", "select section_id, version_id, case when document_id % 5 = 0 then 'new' else content end as content from fx_sections where document_id % 5 <> 0 or ordinal = 0", "fx_sections")
def s5(s):
    spark, to = s.sparkSession, files.shared_folder(s.sparkSession)
    s = s.select("section_id", "version_id", "pipeline_version", "document_id", "ordinal", "content")
    files.write_outputs(s, to)
    files.write_outputs(s.where("document_id % 5 = 0 and ordinal = 0").withColumn("content", F.lit("new")), to)
    return files.read_outputs(spark, to).select("section_id", "version_id", "content")


@query("s5_outputs_removed", "select section_id, version_id, content from fx_sections where document_id % 7 <> 3", "fx_sections")
def s5_removed(s):
    """Pairs that are replaced by nothing, among others that are replaced by themselves."""
    spark, to = s.sparkSession, files.shared_folder(s.sparkSession)
    s = s.select("section_id", "version_id", "pipeline_version", "document_id", "content")
    files.write_outputs(s, to)
    files.write_outputs(s.where("document_id % 7 = 4"), to, replaced=s.where("document_id % 7 = 3"))
    return files.read_outputs(spark, to).select("section_id", "version_id", "content")


@query(
    "p7_mime_detect_whole",
    """
    with d as (select doc_id % 4 as i, coalesce(text, '') as t from documents), h as (select i, strlen(t) as size, substr(hex(encode(t)), 16385, 1) in ('8', '9', 'A', 'B') as torn from d)
    select case when i = 0 then 'application/pdf' when torn or size = 0 or (i = 1 and size < 8192) then 'application/octet-stream' else 'text/plain' end as detected, count(*) as n from h group by 1
    """,
    "documents",
)
def p7_whole(d):
    """Long and empty documents too: the head may end inside a character, or before the NUL."""
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    text = F.when(i % 4 == 0, F.concat(F.lit("%PDF-"), t)).when(i % 4 == 1, F.concat(t, F.lit("\x00"))).otherwise(t)
    raw = d.select(F.encode(text, "UTF-8").alias("content"))
    return files.mime_detect(raw.withColumn("head", F.substring("content", 1, files.HEAD))).groupBy("detected").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p8_mime_gate",
    """
    with f as (select version_id, lower(file_extension) as e, case version_id % 3 when 0 then 'application/pdf' when 1 then 'text/plain' else 'application/octet-stream' end as detected, case version_id % 4 when 0 then '' when 1 then 'text/plain' when 2 then 'Application/PDF' else 'image/png' end as declared from fx_versions)
    select version_id, case when e not in ('.pdf', '.docx', '.xlsx', '.csv', '.txt') then 'unsupported_format' when not ((e = '.pdf' and detected = 'application/pdf') or (e in ('.csv', '.txt') and detected = 'text/plain')) then 'mime_mismatch'
      when declared = '' or (e = '.pdf' and lower(declared) = 'application/pdf') or (e in ('.csv', '.txt') and declared = 'text/plain') then 'accepted' else 'declared_mime_mismatch' end as code from f
    """,
    "fx_versions",
)
def p8(v):
    i = F.col("version_id")
    detected = F.when(i % 3 == 0, "application/pdf").when(i % 3 == 1, "text/plain").otherwise(files.OCTETS)
    declared = F.when(i % 4 == 0, "").when(i % 4 == 1, "text/plain").when(i % 4 == 2, "Application/PDF").otherwise("image/png")
    return files.mime_gate(v.select("version_id", F.concat(F.lit("x"), "file_extension").alias("name"), detected.alias("detected"), declared.alias("declared"))).select("version_id", "code")


@query(
    "t1_stream_heartbeats",
    """
    with b as (select device_code, max(struct_pack(t := created_at, h := 'h' || cast(request_id as varchar))) as m, min(created_at) as f from fx_logs group by 1), d as (select * from fx_devices)
    select coalesce(d.device_code, b.device_code) as device_code, coalesce(case when b.m is not null and (last_seen_at is null or m.t >= last_seen_at) then m.h else hostname end, '') as hostname, case when b.m is not null and (last_seen_at is null or m.t >= last_seen_at) then m.t else last_seen_at end as last_seen_at from d full outer join b on b.device_code = d.device_code
    """,
    "fx_logs", "fx_devices",
)
def t1(logs, d):
    spark, to = logs.sparkSession, files.shared_folder(logs.sparkSession)
    beats(logs).repartition(3).write.parquet(f"{to}/in")
    devices = d.select("device_code", "hostname", "username", "agent_version", "last_seen_at", "registered_at")
    out = streams.stream_heartbeats(streams.files(spark, f"{to}/in", beats(logs).schema), devices, f"{to}/state")
    return out.select("device_code", F.coalesce("hostname", F.lit("")).alias("hostname"), "last_seen_at")


@query("t2_stream_file_index", "select device_code, full_path, seq, size_bytes, is_deleted from fx_file_events qualify row_number() over (partition by device_code, full_path order by seq desc) = 1", "fx_file_events")
def t2(f):
    spark, to = f.sparkSession, files.shared_folder(f.sparkSession)
    rows = f.select(*INDEX)
    n = rows.agg(F.max("seq")).first()[0] // 3 + 1
    for k in range(3):  # arrivals in order, each one micro-batch of several files; the stream goes on from where it was
        rows.where(F.floor(F.col("seq") / n) == k).repartition(8).write.mode("append").parquet(f"{to}/in")
        out = streams.stream_file_index(streams.files(spark, f"{to}/in", rows.schema, 1000), rows.limit(0), f"{to}/state")
    return out.select("device_code", "full_path", "seq", "size_bytes", "is_deleted")


@query("t3_stream_logs", "select id, device_code, case when upper(trim(level)) = '' then 'INFO' else upper(trim(level)) end as level from fx_logs", "fx_logs")
def t3(logs):
    spark, to = logs.sparkSession, files.shared_folder(logs.sparkSession)
    logs.repartition(2).write.parquet(f"{to}/in")
    return streams.stream_logs(streams.files(spark, f"{to}/in", logs.schema), f"{to}/out").select("id", "device_code", "level")


@query(
    "t4_stream_offline",
    f"""
    with b as (select device_code, created_at as ts from fx_logs), g as (select *, case when ts > lag(ts) over w + interval {ONLINE_MINUTES} minutes then 1 else 0 end as cut from b window w as (partition by device_code order by ts)), s as (select *, sum(cut) over (partition by device_code order by ts) as k from g)
    select device_code, min(ts) as online_at, max(ts) + interval {ONLINE_MINUTES} minutes as offline_at, count(*) as beats from s group by device_code, k having max(ts) + interval {ONLINE_MINUTES} minutes <= (select max(ts) from b) - interval 1 hour
    """,
    "fx_logs",
)
def t4_stream(logs):
    spark, to = logs.sparkSession, files.shared_folder(logs.sparkSession)
    logs.select("device_code", F.col("created_at").cast("timestamp").alias("ts")).write.parquet(f"{to}/in")
    out = streams.stream_offline(streams.files(spark, f"{to}/in", "device_code string, ts timestamp", 1000), f"{to}/out", ONLINE_MINUTES)
    return out.select("device_code", F.col("online_at").cast("timestamp_ntz").alias("online_at"), F.col("offline_at").cast("timestamp_ntz").alias("offline_at"), "beats")


@query(
    "s3_read_heads",
    "select case when k = 0 then 'application/pdf' when k = 1 then 'image/gif' else 'text/plain' end as detected, count(*) as n, cast(sum(strlen(text) + 7) as bigint) as bytes from (select p_partkey % 3 as k, string_agg(p_name, '') as text from part group by p_partkey // 50, p_partkey % 3) group by all",
    "part",
)
def s3_heads(part):
    """A file of each 50 parts and kind, told by its first bytes."""
    spark, to = part.sparkSession, files.shared_folder(part.sparkSession)
    k = F.col("p_partkey") % 3
    mark = F.when(k == 0, "%PDF-1").when(k == 1, "GIF89a").otherwise("words:")
    text = part.groupBy(F.floor(F.col("p_partkey") / 50).alias("f"), k.alias("k"), mark.alias("mark")).agg(F.array_join(F.collect_list("p_name"), "").alias("t"))
    documents.write_documents(text.select(F.col("f").alias("version_id"), F.col("k").alias("pipeline_version"), F.concat("mark", "t", F.lit("\n")).alias("json")), to)
    found = files.mime_detect(files.read_heads(spark, f"{to}/[0-9a-f]*"))  # the folders of the write's tasks
    return found.groupBy("detected").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@query(
    "t4_stream_alerts",
    f"""
    with d as (select distinct device_code, created_at as ts from fx_logs), b as (select *, lag(ts) over w as before, lead(ts) over w as after from d window w as (partition by device_code order by ts))
    select device_code, ts as at_time, 'online' as status from b where before is null or ts > before + interval {ONLINE_MINUTES} minutes
    union all select device_code, ts + interval {ONLINE_MINUTES} minutes, 'offline' from b where after > ts + interval {ONLINE_MINUTES} minutes or (after is null and ts + interval {ONLINE_MINUTES} minutes < (select max(ts) from d) - interval 10 seconds)
    """,
    "fx_logs",
)
def t4_alerts(logs):
    spark, to = logs.sparkSession, files.shared_folder(logs.sparkSession)
    logs.select("device_code", F.col("created_at").cast("timestamp").alias("ts")).write.parquet(f"{to}/in")
    out = streams.stream_alerts(streams.files(spark, f"{to}/in", "device_code string, ts timestamp", 1000), f"{to}/out", ONLINE_MINUTES)
    return out.select("device_code", F.col("at").cast("timestamp_ntz").alias("at_time"), "status")


@query("s3_read_raw", "select cast(sum(strlen(p_name) + 1) as bigint) as bytes from part", "part")
def s3(part):
    spark, to = part.sparkSession, files.shared_folder(part.sparkSession)
    part.select("p_name").write.text(to)
    raw = files.read_raw(spark, f"{to}/*.txt")
    return raw.where(F.length("head") <= files.HEAD).agg(F.sum("length").alias("bytes"))
