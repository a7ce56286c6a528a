"""Queries over state tables and the fleet, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.fixtures import AS_OF, EVENTS_AS_OF, ONLINE_MINUTES
from larkspur.functions import scalars as S
from larkspur.operators import fleet, state
from larkspur.plans.catalog import DERIVED, STORED, derivatives, stored_parts
from larkspur.operators.catalog import part_plan
from larkspur.plans.registry import query
from larkspur.sources import store
from larkspur.sources.files import shared_folder

INDEX = ["device_code", "full_path", "seq", "size_bytes", "is_deleted", "updated_at"]


@query(
    "m1_merge_file_index",
    "select device_code, full_path, seq, size_bytes, is_deleted from fx_file_events where trim(full_path) <> '' qualify row_number() over (partition by device_code, full_path order by seq % 2 desc, seq desc) = 1",
    "fx_file_events",
)
def m1(f):
    cur = bucketed(state.newest(f.where("seq % 2 = 0").select(*INDEX), ["device_code", "full_path"], "seq"))
    return state.merge_file_index(cur, f.where("seq % 2 = 1").select(*INDEX)).select("device_code", "full_path", "seq", "size_bytes", "is_deleted")


def bucketed(current, keys=("device_code", "full_path")):
    """current as a table dealt by its keys, which merges leave where it is."""
    spark = current.sparkSession
    return store.save_bucketed(current, shared_folder(spark), keys, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))


LOCAL = """cur as (select *, case when attempt_count % 2 = 0 then 'synced' else 'pending' end as sync_status from fx_file_events where seq % 2 = 0 qualify row_number() over (partition by device_code, full_path order by seq desc) = 1),
    sc as (select *, case when seq % 5 = 0 then size_bytes else 1 end as z from fx_file_events where seq % 2 = 1 qualify row_number() over (partition by device_code, full_path order by seq desc) = 1)"""


def local(f):
    cur = state.newest(f.where("seq % 2 = 0"), ["device_code", "full_path"], "seq").withColumn("sync_status", F.when(F.col("attempt_count") % 2 == 0, "synced").otherwise("pending"))
    return cur.withColumn("last_seen", F.col("updated_at"))


@query(
    "m2_merge_scan",
    f"""
    with {LOCAL}, sc2 as (select sc.*, coalesce(case when sc.seq % 4 = 1 then cur.size_bytes end, sc.size_bytes) as z2, coalesce(case when sc.seq % 4 = 1 then cur.updated_at end, sc.updated_at) as t2, case when sc.seq % 8 = 1 and cur.seq is not null then cur.created_at else sc.created_at end as c2 from sc left join cur using (device_code, full_path))
    select coalesce(c.device_code, s.device_code) as device_code, coalesce(c.full_path, s.full_path) as full_path, coalesce(s.z2, c.size_bytes) as size_bytes,
      case when s.seq is null then c.sync_status when c.seq is null or c.is_deleted or c.size_bytes <> s.z2 or c.updated_at <> s.t2 or c.created_at is distinct from s.c2 then 'pending' else c.sync_status end as sync_status,
      case when s.seq is null then c.attempt_count when c.seq is null or c.size_bytes <> s.z2 or c.updated_at <> s.t2 then 0 else c.attempt_count end as attempt_count, case when s.seq is null then c.is_deleted else false end as is_deleted, case when s.seq is null then c.created_at else s.c2 end as created_at
    from cur c full outer join sc2 s on c.device_code = s.device_code and c.full_path = s.full_path
    """,
    "fx_file_events",
)
def m2(f):
    cur = bucketed(local(f))
    scan = state.newest(f.where("seq % 2 = 1"), ["device_code", "full_path"], "seq").withColumn("last_seen", F.col("updated_at"))
    old = cur.select("device_code", "full_path", F.col("size_bytes").alias("oz"), F.col("updated_at").alias("ot"), F.col("created_at").alias("oc"))
    scan = scan.join(old, ["device_code", "full_path"], "left")
    again = F.col("seq") % 4 == 1
    scan = scan.withColumn("size_bytes", F.coalesce(F.when(again, F.col("oz")), "size_bytes")).withColumn("updated_at", F.coalesce(F.when(again, F.col("ot")), "updated_at"))
    scan = scan.withColumn("created_at", F.when((F.col("seq") % 8 == 1) & F.col("oz").isNotNull(), F.col("oc")).otherwise(F.col("created_at"))).drop("oz", "ot", "oc")
    return state.merge_scan(cur, scan).select("device_code", "full_path", "size_bytes", "sync_status", "attempt_count", "is_deleted", "created_at")


@query(
    "m3_mark_missing",
    f"with {LOCAL} select c.device_code, c.full_path, c.is_deleted or g.full_path is not null as is_deleted, case when g.full_path is not null then 'pending' else sync_status end as sync_status, case when g.full_path is not null then 'missing' else 'none' end as upload_status from cur c left join (select distinct device_code, full_path from fx_file_events where event_kind = 3) g using (device_code, full_path)".replace("event_kind = 3", "attempt_count = 3"),
    "fx_file_events",
)
def m3(f):
    return state.mark_missing(local(f).withColumn("upload_status", F.lit("none")), f.where("attempt_count = 3")).select("device_code", "full_path", "is_deleted", "sync_status", "upload_status")


@query(
    "m4_decide_uploads",
    """
    with cur as (select device_code, upper(replace(full_path, chr(92), '/')) as p, size_bytes, modified_at, sha256, status, case when id % 3 = 0 then '' else 'm' end as multi from fx_sources where id % 4 <> 3),
    inc as (select id, device_code, upper(replace(full_path, chr(92), '/')) as p, size_bytes + case when id % 5 = 0 then 1 else 0 end as size_bytes, modified_at, case when id % 7 = 0 then 'x' else upper(sha256) end as sha256 from fx_sources),
    j as (select i.id, c.p is not null and c.size_bytes = i.size_bytes and c.modified_at = i.modified_at and (i.sha256 = '' or c.sha256 = '' or lower(i.sha256) = lower(c.sha256)) as same, c.status, coalesce(c.multi, '') <> '' as open from inc i left join cur c on c.device_code = i.device_code and c.p = i.p)
    select id, case when same and status = 'completed' then 'skip' when same and status <> 'aborted' and open then 'resume' else 'start' end as decision, open and not (same and status = 'completed') and not (same and status <> 'aborted' and open) as abort_open from j
    """,
    "fx_sources",
)
def m4(s):
    path = S.path_identity("full_path").alias("path_identity")
    cur = s.where("id % 4 <> 3").select("device_code", path, "size_bytes", "modified_at", "sha256", "status", F.when(F.col("id") % 3 == 0, "").otherwise("m").alias("multipart_id"))
    inc = s.select("id", "device_code", path, (F.col("size_bytes") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("size_bytes"), "modified_at", F.when(F.col("id") % 7 == 0, "x").otherwise(F.upper("sha256")).alias("sha256"))
    return state.decide_uploads(cur, inc).select("id", "decision", "abort_open")


@query(
    "m4_decide_archive",
    """
    with s as (select *, case when id % 8 = 1 then 'aborted' else status end as st from fx_sources where source_type = 'old_user_data'), cur as (select import_job_id, full_path, size_bytes, modified_at, sha256, st, case when id % 3 = 0 then '' else 'm' end as multi from s where id % 4 <> 3),
    inc as (select id, import_job_id, full_path, size_bytes + case when id % 5 = 0 then 1 else 0 end as size_bytes, modified_at, case when id % 7 = 0 then 'x' else upper(sha256) end as sha256 from s),
    j as (select i.id, c.full_path is not null and c.size_bytes = i.size_bytes and c.modified_at = i.modified_at and (i.sha256 = '' or c.sha256 = '' or lower(i.sha256) = lower(c.sha256)) as same, c.st, coalesce(c.multi, '') <> '' as open from inc i left join cur c using (import_job_id, full_path))
    select id, case when same and st = 'completed' then 'skip' when same and open then 'resume' else 'start' end as decision, open and not same as abort_open from j
    """,
    "fx_sources",
)
def m4_archive(s):
    i = F.col("id")
    s = s.where("source_type = 'old_user_data'").withColumn("status", F.when(i % 8 == 1, "aborted").otherwise(F.col("status")))
    cur = s.where("id % 4 <> 3").withColumn("multipart_id", F.when(i % 3 == 0, "").otherwise("m"))
    inc = s.select("id", "import_job_id", "full_path", (F.col("size_bytes") + F.when(i % 5 == 0, 1).otherwise(0)).alias("size_bytes"), "modified_at", F.when(i % 7 == 0, "x").otherwise(F.upper("sha256")).alias("sha256"))
    return state.decide_uploads(cur, inc, archive=True).select("id", "decision", "abort_open")


@query(
    "m5_validate_parts",
    f"""
    with {STORED}, b as (select coalesce(p.upload_id, s.upload_id) as upload_id, coalesce(p.part_number, s.part_number) as n, p.part_length as want, s.part_length as got from planned p full outer join stored s on p.upload_id = s.upload_id and p.part_number = s.part_number)
    select upload_id, case when count(want) <> count(got) then 'part_count' when min(n) filter (want <> got) is not null then 'size ' || cast(min(n) filter (want <> got) as varchar) else '' end as error from b group by 1 having count(want) > 0
    """,
    "fx_plan",
)
def m5(plan):
    return state.validate_parts(part_plan(plan), stored_parts(plan))


@query(
    "m6_ensure_documents",
    """
    with d as (select * from fx_documents where document_id % 3 <> 0), s as (select *, device_code || 'X' as dv from fx_sources where id % 2 = 0)
    select coalesce(cast(d.document_id as varchar), sha256(s.source_type || ':' || cast(s.id as varchar))) as document_id, coalesce(d.source_type, s.source_type) as source_type, coalesce(d.source_record_id, s.id) as source_record_id, coalesce(s.dv, d.device_code) as device_code,
      coalesce(classification, 'unclassified') as classification, coalesce(department, '') as department from d full outer join s on d.source_type = s.source_type and d.source_record_id = s.id
    """,
    "fx_sources", "fx_documents",
)
def m6(s, d):
    out = state.ensure_documents(s.where("id % 2 = 0").withColumn("device_code", F.concat("device_code", F.lit("X"))), d.where("document_id % 3 <> 0"))
    return out.select("document_id", "source_type", "source_record_id", "device_code", "classification", "department")


@query(
    "w4_assign_versions",
    """
    with old as (select document_id, cast(size_bytes as varchar) as k, row_number() over (partition by document_id order by version_number) as version_number from fx_versions where version_number <= 2),
    n as (select document_id, cast(size_bytes as varchar) as k, max(l_shipdate) as t from fx_versions v where not exists (select 1 from old o where o.document_id = v.document_id and o.k = cast(v.size_bytes as varchar)) group by 1, 2)
    select n.document_id, n.k as source_version_key, cast(coalesce(m, 0) + row_number() over (partition by n.document_id order by t, k) as int) as version_number from n left join (select document_id, max(version_number) as m from old group by 1) o on o.document_id = n.document_id
    """,
    "fx_versions",
)
def w4(v):
    k = F.col("size_bytes").cast("string").alias("source_version_key")
    return state.assign_versions(v.select("document_id", k, F.col("l_shipdate").alias("modified_at")), v.where("version_number <= 2").select("document_id", k, "version_number")).select("document_id", "source_version_key", "version_number")


@query("m7_ensure_jobs", "select version_id, 'v1' as pipeline_version, case when extraction_status = 'completed' then 'completed' else 'queued' end as status, 0 as attempt_count from fx_versions where version_id not in (select version_id from fx_jobs where pipeline_version = 'v1')", "fx_versions", "fx_jobs")
def m7(v, j):
    return state.ensure_jobs(v, j, "v1", F.col("extraction_status") == "completed").select("version_id", "pipeline_version", "status", "attempt_count")


DEAD = f"status = 'running' and lease_until <= timestamp '{AS_OF}' and attempt_count >= max_attempts"


@query("m8_sweep_expired", f"select job_id, case when {DEAD} then 'dead_letter' else status end as status, case when {DEAD} then 'lease_expired' else error_code end as error_code from fx_jobs", "fx_jobs")
def m8(j):
    return state.sweep_expired(j, AS_OF).select("job_id", "status", "error_code")


@query(
    "w5_claim_batch",
    f"""
    select job_id, attempt_count + 1 as attempt_count, row_number() over w as position, row_number() over w % 3 as owner, coalesce(started_at, timestamp '{AS_OF}') as started_at, sha256(job_id || ':' || (attempt_count + 1) || ':{AS_OF}') as lease_token
    from fx_jobs join fx_versions using (version_id) where pipeline_version = 'v1' and attempt_count < max_attempts and lower(file_extension) in ('.pdf', '.xlsx') and version_id % 7 <> 0 and version_id % 11 <> 0 and ((status in ('queued', 'retry_wait') and next_attempt_at <= timestamp '{AS_OF}') or (status = 'running' and lease_until <= timestamp '{AS_OF}'))
    window w as (order by priority desc, next_attempt_at, created_at, job_id) order by position limit 300
    """,
    "fx_jobs", "fx_versions",
)
def w5(j, v):
    i = F.col("version_id")
    v = v.withColumn("object_version_id", F.when(i % 7 == 0, "").otherwise("v")).withColumn("sha256", F.when(i % 11 == 0, "zz").otherwise(F.sha2(i.cast("string"), 256)))
    return state.claim_batch(j, v, "v1", [".pdf", ".xlsx"], 300, AS_OF, 3, trusted=True).select("job_id", "attempt_count", "position", "owner", "started_at", "lease_token")


@query(
    "m9_apply_failures",
    f"""
    with j as (select *, job_id % 10 as token from fx_jobs), f as (select job_id, case job_id % 4 when 0 then 'reject' when 1 then 'dead_letter' when 2 then 'release' else 'retry' end as d, case when job_id % 5 = 0 then -1 else token end as ft from j where priority < 3),
    k as (select j.*, d, coalesce(status = 'running' and ft = token, false) as hit, case when d = 'reject' then 'rejected' when d = 'dead_letter' then 'dead_letter' when d = 'release' or attempt_count < max_attempts then 'retry_wait' else 'dead_letter' end as ns from j left join f using (job_id))
    select job_id, case when hit then ns else status end as status, case when hit and d = 'release' then greatest(attempt_count - 1, 0) else attempt_count end as attempt_count,
      case when hit and ns = 'retry_wait' then timestamp '{AS_OF}' + to_seconds(cast(least(30 * pow(2, least(greatest(attempt_count - 1, 0), 30)), 1800) as int)) when hit then timestamp '{AS_OF}' else next_attempt_at end as next_attempt_at,
      case when not hit then token end as lease_token, case when not hit then lease_until end as lease_until, case when hit and ns <> 'retry_wait' then timestamp '{AS_OF}' end as completed_at, case when hit then 'why' end as error_message,
      case when not hit then '' when ns = 'retry_wait' then 'queued' when ns = 'rejected' then 'rejected' else 'failed' end as version_status from k
    """,
    "fx_jobs",
)
def m9(j):
    j = j.withColumn("lease_token", F.col("job_id") % 10)
    d = F.element_at(F.array(*(F.lit(x) for x in ("reject", "dead_letter", "release", "retry"))), (F.col("job_id") % 4 + 1).cast("int"))
    f = j.where("priority < 3").select("job_id", F.when(F.col("job_id") % 5 == 0, -1).otherwise(F.col("lease_token")).alias("token"), d.alias("disposition"), F.lit("x").alias("error"), F.lit("why").alias("message"))
    f = f.unionByName(f).unionByName(f.withColumn("token", F.lit(-2).cast("long")))  # repeated, and of an earlier lease
    return state.apply_failures(j, f, AS_OF).select("job_id", "status", "attempt_count", "next_attempt_at", "lease_token", "lease_until", "completed_at", "error_message", "version_status")


@query(
    "m10_replace_outputs",
    "select section_id, version_id, ordinal, content from fx_sections where document_id % 3 <> 0 union all select section_id, version_id, ordinal, left(content, 20) from fx_sections where document_id % 3 = 0 and ordinal < 2",
    "fx_sections",
)
def m10(s):
    new = s.where("document_id % 3 = 0 and ordinal < 2").withColumn("content", F.substring("content", 1, 20))
    return state.replace_outputs(s, new).select("section_id", "version_id", "ordinal", "content")


@query(
    "m11_validate_outputs",
    """
    with s as (select version_id, pipeline_version, case when section_id % 50 = 0 then -1 else ordinal // 2 end as ordinal, case when section_id % 31 = 0 then '' else content end as content, case when section_id % 17 = 0 then 'z' else sha256(content) end as sha256, case when section_id % 13 = 0 then '{' else '{"a":1}' end as locator, case when section_id % 23 = 0 then ' ' else section_type end as section_type, case when section_id % 29 = 0 then repeat('h', 1001) else heading end as heading from fx_sections)
    select version_id, ordinal, 'duplicate ordinal' as problem from s group by version_id, pipeline_version, ordinal having count(*) > 1
    union all select version_id, ordinal, case when ordinal < 0 then 'negative ordinal' when length(content) = 0 then 'no text' when length(content) > 2000 then 'too long' when length(sha256) <> 64 then 'bad sha' when trim(section_type) = '' then 'bad type' when length(heading) > 1000 then 'long heading' else 'bad json' end from s
      where ordinal < 0 or length(content) = 0 or length(content) > 2000 or length(sha256) <> 64 or trim(section_type) = '' or length(heading) > 1000 or locator = '{'
    """,
    "fx_sections",
)
def m11(s):
    i = F.col("section_id")
    s = s.withColumns({"ordinal": F.when(i % 50 == 0, -1).otherwise(F.floor(F.col("ordinal") / 2).cast("int")), "sha256": F.when(i % 17 == 0, "z").otherwise(F.sha2("content", 256)), "content": F.when(i % 31 == 0, "").otherwise(F.col("content")), "locator": F.when(i % 13 == 0, "{").otherwise('{"a":1}'), "section_type": F.when(i % 23 == 0, " ").otherwise(F.col("section_type")), "heading": F.when(i % 29 == 0, F.repeat(F.lit("h"), 1001)).otherwise(F.col("heading"))})
    return state.validate_outputs(s, 2000).select("version_id", "ordinal", "problem")


@query(
    "m11_validate_derivatives",
    f"""
    with d as (select version_id, 'v1' as pipeline_version, case when version_id % 5 = 0 then ' ' else 'image' end as kind, case when version_id % 3 = 0 then 0 else ordinal end as ordinal, case when version_id % 7 = 0 and ordinal = 1 then -1 else 1 end as size_bytes, case when version_id % 11 = 0 then '' else object_key end as object_key, case when version_id % 13 = 0 then 'z' else sha256(object_key) end as sha256 from {DERIVED})
    select version_id, kind, ordinal, 'duplicate ordinal' as problem from d group by all having count(*) > 1
    union all select version_id, kind, ordinal, case when size_bytes < 0 then 'negative number' when trim(kind) = '' then 'bad kind' when object_key = '' then 'no object key' else 'bad sha' end from d where size_bytes < 0 or trim(kind) = '' or object_key = '' or length(sha256) <> 64
    """,
    "fx_versions",
)
def m11_derivatives(v):
    i, n = F.col("version_id"), F.col("ordinal")
    d = derivatives(v).withColumn("sha256", F.when(i % 13 == 0, "z").otherwise(F.sha2("object_key", 256))).withColumn("size_bytes", F.when((i % 7 == 0) & (n == 1), -1).otherwise(1)).withColumn("object_key", F.when(i % 11 == 0, "").otherwise(F.col("object_key")))
    d = d.withColumns({"pipeline_version": F.lit("v1"), "kind": F.when(i % 5 == 0, " ").otherwise("image"), "ordinal": F.when(i % 3 == 0, 0).otherwise(n)})
    return state.validate_derivatives(d).select("version_id", "kind", "ordinal", "problem")


def completed(j, v, parts=None):
    """Results of running jobs; one in 5 with a stale token, one in 3 of the leases over."""
    i = F.col("job_id")
    j = j.withColumn("lease_token", i % 10).withColumn("lease_until", F.when(i % 3 == 0, S.ntz("1990-01-01 00:00:00")).otherwise(S.ntz("2030-01-01 00:00:00")))
    v = v.select("version_id", "extraction_status", F.when(F.col("version_id") % 2 == 0, "").otherwise("old").alias("object_version_id"), F.lit("").alias("etag"), F.lit("s").alias("sha256"), F.lit(0).alias("page_count"), F.lit(0).cast("long").alias("section_count"), F.lit("").alias("pipeline_version"))
    r = j.where("priority < 3").select("job_id", F.when(i % 5 == 0, -1).otherwise(F.col("lease_token")).alias("token"), F.lit("new").alias("object_version_id"), F.lit("e").alias("etag"), F.sha2(i.cast("string"), 256).alias("sha256"), F.lit(7).alias("page_count"))
    of = lambda text, n: j.select("version_id", "pipeline_version", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("ordinal"), F.lit(text).alias("content"))
    return state.apply_completions(j, v, of("old", 1), of("old", 1), r.unionByName(r), of("new", 2), of("new", 1), AS_OF, parts)


HIT = "h as (select *, priority < 3 and job_id % 5 <> 0 and job_id % 3 <> 0 and status = 'running' as hit from fx_jobs)"


@query("m10_completed_jobs", f"with {HIT} select job_id, case when hit then 'completed' else status end as status, case when hit then '' else error_code end as error_code from h", "fx_jobs", "fx_versions")
def m10_jobs(j, v):
    return completed(j, v)["jobs"].select("job_id", "status", "error_code")


@query(
    "m10_completed_versions",
    f"with {HIT} select v.version_id, case when hit then 'completed' else extraction_status end as extraction_status, case when v.version_id % 2 = 0 then case when hit then 'new' else '' end else 'old' end as object_version_id, case when hit then 'e' else '' end as etag, case when hit then sha256(cast(job_id as varchar)) else 's' end as sha256, cast(case when hit then 7 else 0 end as int) as page_count, cast(case when hit then 2 else 0 end as bigint) as section_count, case when hit then pipeline_version else '' end as pipeline_version from fx_versions v left join h on h.version_id = v.version_id",
    "fx_jobs", "fx_versions",
)
def m10_versions(j, v):
    return completed(j, v)["versions"]


@query("m10_completed_outputs", f"with {HIT} select 'section' as what, version_id, case when hit then 'new' else 'old' end as content, count(*) as n from h, range(2) as r(k) where hit or k = 0 group by all union all select 'derivative', version_id, case when hit then 'new' else 'old' end, 1 from h", "fx_jobs", "fx_versions", dealt=True)
def m10_outputs(j, v, parts):
    out = completed(j, v, parts)
    n = lambda name, what: out[name].repartition(parts, "version_id", "content").groupBy("version_id", "content").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "version_id", "content", "n")
    return n("sections", "section").unionByName(n("derivatives", "derivative"))


@query("m7_reset_versions", "select version_id, case when extraction_status <> 'completed' and version_id not in (select version_id from fx_jobs where pipeline_version = 'v1') then 'queued' else extraction_status end as extraction_status from fx_versions", "fx_versions", "fx_jobs")
def m7_versions(v, j):
    return state.reset_versions(v, state.ensure_jobs(v, j, "v1", F.col("extraction_status") == "completed")).select("version_id", "extraction_status")


@query("m8_fail_versions", f"select v.version_id, case when {DEAD} then 'failed' else extraction_status end as extraction_status from fx_versions v left join fx_jobs j on j.version_id = v.version_id", "fx_versions", "fx_jobs")
def m8_versions(v, j):
    return state.fail_versions(v, j, AS_OF).select("version_id", "extraction_status")


@query("m12_requeue", "select job_id, case when status = 'running' then 'refused' else 'queued' end as outcome, case when status = 'running' then status else 'queued' end as status, case when status = 'running' then attempt_count else 0 end as attempt_count, case when status = 'running' then 't' end as lease_token, case when status = 'running' then lease_until end as lease_until from fx_jobs where job_id % 7 = 0", "fx_jobs")
def m12(j):
    j = j.withColumn("lease_token", F.lit("t"))
    return state.requeue(j, j.where("job_id % 7 = 0").select("job_id"), AS_OF).select("job_id", "outcome", "status", "attempt_count", "lease_token", "lease_until")


@query("m12_reset_requeued", "select v.version_id, case when j.job_id is not null then 'queued' else extraction_status end as extraction_status, case when j.job_id is null then 'e' else '' end as error_code from fx_versions v left join (select * from fx_jobs where job_id % 7 = 0 and status <> 'running') j on j.version_id = v.version_id", "fx_jobs", "fx_versions")
def m12_reset(j, v):
    asked = state.requeue(j, j.where("job_id % 7 = 0").select("job_id"), AS_OF)
    return state.reset_requeued(v.withColumn("error_code", F.lit("e")), asked).select("version_id", "extraction_status", "error_code")


@query(
    "m13_resume_import",
    """
    with f as (select *, import_job_id * 100 + id % 60 as job from fx_sources where source_type = 'old_user_data'), j as (select job, case when job % 5 = 0 then 'completed' else 'paused' end as status, job % 3 <> 0 as scan_done, count(*) filter (status in ('failed', 'missing')) as again from f group by 1)
    select job as import_job_id, case when status = 'completed' then 'refused' when not scan_done then 'pending' else 'uploading' end as outcome, case when status <> 'completed' and scan_done then again else 0 end as again from j
    """,
    "fx_sources",
)
def m13(s):
    f = s.where("source_type = 'old_user_data'").withColumn("import_job_id", F.col("import_job_id") * 100 + F.col("id") % 60)
    j = f.select("import_job_id").distinct().select("import_job_id", F.when(F.col("import_job_id") % 5 == 0, "completed").otherwise("paused").alias("status"), (F.col("import_job_id") % 3 != 0).alias("scan_done"))
    return state.resume_import(j, f).select("import_job_id", "outcome", "again")


@query(
    "m12_requeue_versions",
    f"""
    with j as (select * from fx_jobs where priority <> 3), v as (select version_id, case when version_id % 2 = 0 then 'v9' else 'v0' end as own from fx_versions where version_id % 7 = 0)
    select v.version_id, case when j.job_id is null then sha256(v.version_id || ':' || own) else cast(j.job_id as varchar) end as job_id, coalesce(j.pipeline_version, own) as pipeline_version, case when status = 'running' then 'running' else 'queued' end as status, case when status = 'running' then attempt_count else 0 end as attempt_count,
      case when status = 'running' then 't' else '' end as lease_token, case when status = 'running' then lease_until end as lease_until, case when status = 'running' then next_attempt_at else timestamp '{AS_OF}' end as next_attempt_at, case when j.job_id is null then 'created' when status = 'running' then 'refused' else 'queued' end as outcome from v left join j using (version_id)
    """,
    "fx_jobs", "fx_versions",
)
def m12_versions(j, v):
    v = v.withColumn("pipeline_version", F.when(F.col("version_id") % 2 == 0, " ").otherwise("v0"))
    out = state.requeue_versions(j.where("priority <> 3").withColumn("lease_token", F.lit("t")), v, v.where("version_id % 7 = 0").select("version_id"), AS_OF, "v9")
    return out.drop("error_code")


def imports(s):
    """Files dealt to import jobs, some finished, some with their scan under way."""
    f = s.where("source_type = 'old_user_data'").withColumn("import_job_id", F.col("import_job_id") * 100 + F.col("id") % 60).withColumn("error", F.lit("e"))
    i = F.col("import_job_id")
    status = F.when(i % 5 == 0, "completed").when(i % 7 == 0, "completed_with_errors").otherwise("paused")
    return f, f.select("import_job_id").distinct().select("import_job_id", status.alias("status"), (i % 3 != 0).alias("scan_done"))


IMPORTS = "f as (select *, import_job_id * 100 + id % 60 as job from fx_sources where source_type = 'old_user_data')"


@query("m13_resume_files", f"with {IMPORTS}, g as (select *, job % 5 <> 0 and job % 3 <> 0 and status in ('failed', 'missing') as again from f) select id, case when again then 'indexed' else status end as status, case when again then '' else 'e' end as error from g", "fx_sources")
def m13_files(s):
    f, j = imports(s)
    return state.resume_files(j, f).select("id", "status", "error")


@query(
    "m13_pause_import",
    f"with {IMPORTS}, j as (select distinct job, case when job % 5 = 0 then 'completed' when job % 7 = 0 then 'completed_with_errors' else 'uploading' end as status from f) select job as import_job_id, case when job % 2 = 0 and status = 'uploading' then 'paused' else status end as status, case when job % 2 <> 0 then '' when status = 'uploading' then 'paused' else 'refused' end as outcome from j",
    "fx_sources",
)
def m13_pause(s):
    j = imports(s)[1].withColumn("status", F.regexp_replace("status", "^paused$", "uploading"))
    return state.pause_import(j, j.where("import_job_id % 2 = 0")).select("import_job_id", "status", "outcome")


def beats(logs):
    return logs.select("device_code", F.concat(F.lit("h"), F.col("request_id").cast("string")).alias("hostname"), F.lit("u").alias("username"), F.concat(F.lit("1."), (F.col("id") % 4).cast("string")).alias("agent_version"), F.col("created_at").alias("ts"))


@query(
    "m14_fold_heartbeats",
    """
    with b as (select device_code, max(struct_pack(t := created_at, h := 'h' || cast(request_id as varchar), v := '1.' || cast(id % 4 as varchar))) as m, min(created_at) as f from fx_logs group by 1),
    d as (select * from fx_devices)
    select coalesce(d.device_code, b.device_code) as device_code, coalesce(case when b.m is not null and (last_seen_at is null or m.t >= last_seen_at) then m.h else hostname end, '') as hostname,
      case when b.m is not null and (last_seen_at is null or m.t >= last_seen_at) then m.t else last_seen_at end as last_seen_at, coalesce(registered_at, f) as registered_at from d full outer join b on b.device_code = d.device_code
    """,
    "fx_devices", "fx_logs",
)
def m14(d, logs):
    out = state.fold_heartbeats(d, beats(logs))
    return out.select("device_code", F.coalesce("hostname", F.lit("")).alias("hostname"), "last_seen_at", "registered_at")


@query(
    "m15_index_archive",
    """
    select id, 'OLD-' || regexp_replace(upper(trim(user_folder)), '[^A-Z0-9_.-]', '_', 'g') as device_code, split_part(relative_path, '/', 1) as user_folder, extension, 'archive/' || user_folder || '/' || relative_path as object_key, case when size_bytes > 9000000 then 'skipped' else 'indexed' end as status
    from fx_sources where extension in ('.pdf', '.txt')
    """,
    "fx_sources",
)
def m15(s):
    return state.index_archive(s, [".pdf", ".txt"], 9_000_000, 5_000_000).select("id", "device_code", "user_folder", "extension", "object_key", "status")


@query(
    "m16_command_results",
    """
    with r as (select c.*, n as seq, case n when 0 then case id % 4 when 0 then 'logs' when 1 then 'complete' when 2 then 'fail' else 'diagnostics' end when 1 then 'fail' else 'complete' end as kind, 'e' || n as error, requested_at + to_hours(n) as tm from fx_commands c, (values (0), (1), (2)) as x(n) where id % 3 <> 1 and id % 6 <> 0 and (n = 0 or (n = 1 and id % 5 = 0) or (n = 2 and id % 7 = 0))),
    k as (select *, min(case when kind = 'fail' then seq end) over (partition by id) as ff from r),
    d as (select *, (kind = 'logs' and command_type = 'REQUEST_LOGS') or (kind = 'diagnostics' and command_type = 'RUN_DIAGNOSTICS') or (kind = 'complete' and command_type in ('START_SCAN', 'STOP_SCAN', 'START_FILE_UPLOAD') and (status in ('sent_to_agent', 'failed', 'completed') or coalesce(seq > ff, false))) as ends from k),
    f as (select id, bool_or(ends) as done, min_by(tm, seq) filter (ends) as done_at, max_by(error, seq) filter (kind = 'fail') as e, max_by(tm, seq) filter (kind = 'fail') as bad_at from d group by 1), c as (select *, case when status in ('completed', 'failed') then requested_at end as ca from fx_commands)
    select id, case when status = 'completed' or coalesce(done, false) then 'completed' when e is not null then 'failed' else status end as status, case when status = 'completed' or coalesce(done, false) or e is null then '' else e end as error, case when status = 'completed' then ca when coalesce(done, false) then done_at when e is not null then bad_at else ca end as completed_at from c left join f using (id)
    """,
    "fx_commands",
)
def m16(c):
    """Up to three results a command: a first one of any kind, a failure, a completion."""
    i, n = F.col("id"), F.col("seq")
    r = c.where("id % 3 <> 1").withColumn("seq", F.explode(F.filter(F.array(F.lit(0), F.when(i % 5 == 0, 1), F.when(i % 7 == 0, 2)), lambda x: x.isNotNull())))
    kind = F.when(n == 1, "fail").when(n == 2, "complete").when(i % 4 == 0, "logs").when(i % 4 == 1, "complete").when(i % 4 == 2, "fail").otherwise("diagnostics")
    r = r.select(i.alias("command_id"), F.when(i % 6 == 0, "x").otherwise(F.col("device_code")).alias("device_code"), kind.alias("kind"), F.concat(F.lit("e"), n.cast("string")).alias("error"), "seq", (F.col("requested_at") + F.make_dt_interval(hours=n)).alias("at"))
    c = c.withColumn("completed_at", F.when(F.col("status").isin("completed", "failed"), F.col("requested_at")))
    return state.apply_command_results(c, r).select("id", "status", "error", "completed_at")


@query(
    "m17_request_results",
    "with r as (select id, max(k) as k, max_by(case when k % 2 = 0 then 'completed' else 'failed' end, k) as o from (select id, unnest([request_id, request_id + id % 3]) as k from fx_logs where id % 4 = 0) group by 1) select id, case when o is null then 'pending' else o end as status, case when o = 'failed' then 'bad' else '' end as error, case when o = 'completed' then 'f' || k else '' end as file_name, case when o = 'completed' then 'up/f' || k else '' end as server_path, case when o is not null then created_at end as completed_at from fx_logs left join r using (id)",
    "fx_logs",
)
def m17(logs):
    r = logs.where("id % 4 = 0").select("id", F.col("created_at").alias("at"), F.explode(F.array(F.col("request_id").cast("long"), F.col("request_id") + F.col("id") % 3)).alias("seq"))
    name = F.concat(F.lit("f"), F.col("seq").cast("string"))
    r = r.select("id", "seq", "at", F.when(F.col("seq") % 2 == 0, "completed").otherwise("failed").alias("outcome"), F.lit("bad").alias("error"), name.alias("file_name"), F.concat(F.lit("up/"), name).alias("server_path"))
    q = logs.select("id", F.lit("pending").alias("status"), F.lit("").alias("file_name"), F.lit("").alias("server_path"), F.lit(None).cast(logs.schema["created_at"].dataType).alias("completed_at"))
    return state.apply_request_results(q, r).select("id", "status", "error", "file_name", "server_path", "completed_at")


@query(
    "m17_dispatch_requests",
    f"with r as (select id, created_at, request_id % 2 = 0 as due, row_number() over (partition by device_code, request_id % 2 order by created_at, id) as n from fx_logs) select id, case when not due then 'completed' when n <= 5 then 'sent_to_agent' else 'pending' end as status, case when due and n <= 5 then timestamp '{EVENTS_AS_OF}' when not due then created_at end as started_at from r",
    "fx_logs",
)
def m17_dispatch(logs):
    due = F.col("request_id") % 2 == 0
    r = logs.select("id", "device_code", F.when(due, "pending").otherwise("completed").alias("status"), F.col("created_at").alias("requested_at"), F.when(~due, F.col("created_at")).alias("started_at"))
    return state.dispatch_requests(r, EVENTS_AS_OF).select("id", "status", "started_at")


@query(
    "m18_insert_versions",
    """
    with p as (select p_partkey as k, '1.' || p_partkey % 50 || '.' || p_size as version, p_partkey % 4 = 1 as asks from part), o as (select distinct version from p where k % 3 = 0),
    n as (select *, case when version in (select version from o) or row_number() over (partition by version order by k) > 1 then 'refused' else 'added' end as outcome from p where k % 3 <> 0)
    select k, version, outcome, outcome = 'added' and k = (select max(k) from n where asks and outcome = 'added') as is_active from n
    """,
    "part",
)
def m18_insert(part):
    v = F.concat(F.lit("1."), (F.col("p_partkey") % 50).cast("string"), F.lit("."), F.col("p_size").cast("string"))
    p = part.select(v.alias("version"), F.col("p_partkey").alias("created_at"), (F.col("p_partkey") % 4 == 1).alias("is_active"))
    out = state.insert_agent_versions(p.where("created_at % 3 = 0"), p.where("created_at % 3 <> 0"))
    return out.select(F.col("created_at").alias("k"), "version", "outcome", "is_active")


AGENT = "(select '1.' || cast(p_partkey % 3 as varchar) || '.' || cast(p_size as varchar) as version, p_partkey as k, p_partkey % 2 = 0 as is_active from part)"


def agent_versions(part):
    v = F.concat(F.lit("1."), (F.col("p_partkey") % 3).cast("string"), F.lit("."), F.col("p_size").cast("string"))
    return part.select(v.alias("version"), F.col("p_partkey").alias("created_at"), (F.col("p_partkey") % 2 == 0).alias("is_active"))


@query("m18_activate_version", f"select k, version, version = '1.1.7' as is_active from {AGENT}", "part")
def m18(p):
    return state.activate_version(agent_versions(p), "1.1.7").select(F.col("created_at").alias("k"), "version", "is_active")


UPDATE = f"""n as (select max_by(version, k) as newest from {AGENT} where is_active), d as (select *, case when regexp_matches(trim(agent_version), '^[0-9]{{1,9}}([.][0-9]{{1,9}}){{1,3}}$') then list_resize(cast(string_split(trim(agent_version), '.') as int[]), 4, -1) end as v from fx_devices),
    u as (select device_code, case when trim(nickname) = '' then device_code else nickname end as display_name, agent_version, case when v is null then 'unknown' when v = list_resize(cast(string_split(newest, '.') as int[]), 4, -1) then 'latest' when v < list_resize(cast(string_split(newest, '.') as int[]), 4, -1) then 'outdated' else 'newer' end as update_status,
      coalesce(last_seen_at > timestamp '{EVENTS_AS_OF}' - interval 720 minutes, false) as online from d, n)"""


@query("p12_update_status", f"with {UPDATE} select * from u", "fx_devices", "part")
def p12(d, n):
    return fleet.device_update_status(d, agent_versions(n), EVENTS_AS_OF, ONLINE_MINUTES)


@query(
    "a4_version_summary",
    f"with {UPDATE} select 'total' as kind, case when online then 'online' else 'offline' end as name, count(*) as n from u group by all union all select 'status', update_status, count(*) from u group by all union all select 'version', case when trim(agent_version) = '' then 'unknown' else trim(agent_version) end, count(*) from u group by all",
    "fx_devices", "part",
)
def a4(d, n):
    return fleet.version_summary(d, agent_versions(n), EVENTS_AS_OF, ONLINE_MINUTES)


@query(
    "w6_dispatch",
    """
    with a as (select 0 as source, id, device_code, case when category in ('click', 'error') then 'UPLOAD_ZIP' else 'UPLOAD_FILE' end as command_type, created_at as t from fx_logs where request_id % 2 = 0 union all select 1, id, device_code, command_type, requested_at from fx_commands where status = 'pending')
    select source, id, device_code, command_type, row_number() over (partition by device_code, source order by t, id) as position from a qualify position <= 5
    """,
    "fx_logs", "fx_commands",
)
def w6(logs, c):
    kind = F.when(F.col("category") == "click", "multiple").when(F.col("category") == "error", "folder").otherwise("single")
    r = logs.select("id", "device_code", kind.alias("request_type"), F.when(F.col("request_id") % 2 == 0, "pending").otherwise("sent").alias("status"), F.col("created_at").alias("requested_at"))
    return fleet.dispatch_commands(r, c).select("source", "id", "device_code", "command_type", "position")


@query("w7_active_commands", "select device_code, command_type, max_by(id, struct_pack(t := requested_at, i := id)) as id, count(*) as open_count from fx_commands where status in ('pending', 'sent_to_agent') group by all", "fx_commands")
def w7(c):
    return fleet.active_commands(c)


@query(
    "w7_admit_commands",
    """
    with o as (select device_code, command_type, max_by(id, struct_pack(t := requested_at, i := id)) as id from fx_commands where status in ('pending', 'sent_to_agent') and id % 3 <> 1 group by all),
    r as (select *, first_value(id) over (partition by device_code, command_type order by requested_at, id) as f from fx_commands where id % 3 = 1)
    select r.id as request_id, coalesce(o.id, case when f <> r.id then f end) as twin, case when o.id is null and f = r.id then 'admitted' else 'duplicate' end as outcome from r left join o using (device_code, command_type)
    """,
    "fx_commands",
)
def w7_admit(c):
    r = c.where("id % 3 = 1").select(F.col("id").alias("request_id"), "device_code", "command_type", "requested_at")
    return fleet.admit_commands(c.where("id % 3 <> 1"), r).select("request_id", "twin", "outcome")


@query("w8_recent_logs", "select id, device_code, row_number() over (partition by device_code order by created_at desc, id desc) as position from fx_logs qualify position <= 10", "fx_logs")
def w8(logs):
    return fleet.recent_per_device(logs, 10).select("id", "device_code", "position")


@query(
    "w9_request_timeline",
    "select id, request_id, row_number() over w as position, coalesce(epoch_us(created_at) - epoch_us(lag(created_at) over w), 0) as step_micros from fx_logs window w as (partition by request_id order by created_at, id)",
    "fx_logs",
)
def w9(logs):
    return fleet.request_timeline(logs).select("id", "request_id", "position", "step_micros")


@query(
    "w10_import_progress",
    """
    with l as (select *, (epoch_us(taken_at) - epoch_us(lag(taken_at) over w)) / 1e6 as s, uploaded_count - lag(uploaded_count) over w as f, uploaded_bytes - lag(uploaded_bytes) over w as b from fx_snapshots window w as (partition by job_id order by taken_at, uploaded_count))
    select job_id, uploaded_count, ((uploaded_count * 20000 + indexed_count) // (2 * indexed_count)) / 100.0::double as percent, case when s > 0 and f > 0 then round(f / s, 4) else -1 end as files_s, case when s > 0 and f > 0 then round((indexed_count - uploaded_count) * s / f, 2) else -1 end as eta_s from l
    """,
    "fx_snapshots",
)
def w10(s):
    return fleet.import_progress(s).select("job_id", "uploaded_count", "percent", "files_s", "eta_s")


@query("u15_norm_logs", "select id, case when upper(trim(level)) = '' then 'INFO' else upper(trim(level)) end as level from fx_logs", "fx_logs")
def u15(logs):
    return logs.select("id", S.norm_level("level").alias("level"))


@query(
    "t4_offline_gaps",
    f"with d as (select distinct device_code, created_at as ts from fx_logs), n as (select *, coalesce(lead(ts) over (partition by device_code order by ts), timestamp '{EVENTS_AS_OF}') as nx from d) select device_code, ts + interval 720 minutes as offline_at, nx as online_at from n where nx > ts + interval 720 minutes",
    "fx_logs",
)
def t4(logs):
    return fleet.silent_gaps(logs.select("device_code", F.col("created_at").alias("ts")), ONLINE_MINUTES, EVENTS_AS_OF)


@query(
    "w4_fill_hashes",
    """
    with v as (select version_id, document_id, case version_id % 3 when 0 then '' when 1 then 'aa' else 'bb' end as sha, case version_id % 4 when 0 then '' when 1 then 'AA' else 'cc' end as got from fx_versions)
    select version_id, case when sha = '' then lower(got) else sha end as sha256, sha <> '' and got <> '' and sha <> lower(got) as sha_conflict from v
    """,
    "fx_versions",
)
def w4_fill(v):
    i, k = F.col("version_id"), F.col("version_id").cast("string").alias("source_version_key")
    old = v.select("version_id", "document_id", k, F.when(i % 3 == 0, "").when(i % 3 == 1, "aa").otherwise("bb").alias("sha256"))
    new = v.select("document_id", k, F.when(i % 4 == 0, "").when(i % 4 == 1, "AA").otherwise("cc").alias("sha256"))
    return state.fill_hashes(old, new).select("version_id", "sha256", "sha_conflict")
