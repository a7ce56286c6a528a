"""Queries over the catalogue fixtures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.fixtures import AS_OF, EVENTS_AS_OF, ONLINE_MINUTES
from larkspur.functions import scalars as S
from larkspur.operators import catalog as C
from larkspur.plans.registry import query

EXTS = [".pdf", ".docx", ".xlsx", ".txt"]
INLIST = "('.pdf', '.docx', '.xlsx', '.txt')"


@query(
    "u_scalars",
    """
    select id, upper(trim(device_code)) as device, upper(rtrim(replace(trim(full_path), chr(92), '/'), '/')) as path_identity,
      case when position('/' in relative_path) > 0 then split_part(relative_path, '/', 1) else '_ROOT' end as user_folder,
      case when position('/' in relative_path) > 0 then substring(relative_path, position('/' in relative_path) + 1) else relative_path end as rest,
      'archive/' || user_folder || '/' || relative_path as object_key,
      sha256(length(source_type) || ':' || source_type || length(cast(id as varchar)) || ':' || cast(id as varchar) || length(sha256) || ':' || sha256) as version_key,
      case extension when '.pdf' then 'application/pdf' when '.docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
        when '.xlsx' then 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' when '.csv' then 'text/csv' when '.txt' then 'text/plain' else 'application/octet-stream' end as content_type,
      case when size_bytes >= 1048576 then regexp_replace(cast(cast(floor(cast(size_bytes as double) / 1048576 * 10 + 0.5) as bigint) // 10 as varchar) || '.' || cast(cast(floor(cast(size_bytes as double) / 1048576 * 10 + 0.5) as bigint) % 10 as varchar), '[.]0$', '') || ' MB'
        when size_bytes >= 1024 then regexp_replace(cast(cast(floor(cast(size_bytes as double) / 1024 * 10 + 0.5) as bigint) // 10 as varchar) || '.' || cast(cast(floor(cast(size_bytes as double) / 1024 * 10 + 0.5) as bigint) % 10 as varchar), '[.]0$', '') || ' KB' else cast(size_bytes as varchar) || ' B' end as human,
      trim(regexp_replace(replace(file_name, '_', '  '), '\\s+', ' ', 'g')) as collapsed,
      least(30 * pow(2, least(greatest(id % 12 - 1, 0), 30)), 1800)::bigint as delay_s, cast(ceil(size_bytes / 5000000.0) as bigint) as parts, case when id % 5 = 0 then timestamp '1998-06-01 00:00:00' else modified_at end as loaded_at
    from fx_sources
    """,
    "fx_sources",
)
def u_scalars(s):
    return s.select(
        "id", S.norm_device("device_code").alias("device"), S.path_identity("full_path").alias("path_identity"), S.user_folder("relative_path").alias("user_folder"), S.below_user_folder("relative_path").alias("rest"),
        S.object_key("archive", "user_folder", "relative_path").alias("object_key"), S.length_prefixed_sha256("source_type", "id", "sha256").alias("version_key"), S.content_type("extension").alias("content_type"),
        S.human_size("size_bytes").alias("human"), S.collapse_ws(F.regexp_replace("file_name", "_", "  ")).alias("collapsed"), S.retry_delay(F.col("id") % 12).alias("delay_s"), S.part_count("size_bytes", F.lit(5_000_000)).alias("parts"),
        S.to_utc(F.when(F.col("id") % 5 != 0, F.col("modified_at")), AS_OF).alias("loaded_at"),
    )


@query(
    "u_versions",
    f"""
    with p as (select device_code, agent_version, last_seen_at, case when regexp_matches(trim(agent_version), '^[0-9]{{1,9}}([.][0-9]{{1,9}}){{1,3}}$') then cast(string_split(trim(agent_version), '.') as int[]) end as v from fx_devices)
    select device_code, case when v is null then 'unknown' when list_resize(v, 4, -1) = [1, 1, 2, -1] then 'latest' when list_resize(v, 4, -1) < [1, 1, 2, -1] then 'outdated' else 'newer' end as status,
      coalesce(last_seen_at > timestamp '{EVENTS_AS_OF}' - interval 720 minutes, false) as online from p
    """,
    "fx_devices",
)
def u_versions(d):
    return d.select("device_code", S.version_status("agent_version", F.lit("1.1.2")).alias("status"), S.online("last_seen_at", EVENTS_AS_OF, ONLINE_MINUTES).alias("online"))


@query(
    "u_types",
    """
    select file, row_no, col_no, case when trim(value) = '' then 'null' when regexp_matches(lower(trim(value)), '^(true|false)$') then 'boolean' when regexp_matches(trim(value), '^[+-]?[0-9]{1,18}$') then 'integer'
      when regexp_matches(trim(value), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') then 'number' else 'string' end as type,
      case when col_no * 30 < 26 then chr(cast(65 + col_no * 30 as int)) else chr(cast(64 + (col_no * 30) // 26 as int)) || chr(cast(65 + (col_no * 30) % 26 as int)) end as col
    from fx_cells
    """,
    "fx_cells",
)
def u_types(cells):
    return cells.select("file", "row_no", "col_no", S.infer_type("value").alias("type"), S.column_name(F.col("col_no") * 30).alias("col"))


@query(
    "u_parts",
    """
    select upload_id, n as part_number, (n - 1) * part_size as part_offset, least(part_size, size_bytes - (n - 1) * part_size)::bigint as part_length
    from (select *, unnest(range(1, cast(ceil(size_bytes * 1.0 / part_size) as bigint) + 1)) as n from fx_plan)
    """,
    "fx_plan",
)
def u_parts(plan):
    return C.part_plan(plan)


STORED = """stored as (select upload_id, n as part_number, least(part_size, size_bytes - (n - 1) * part_size) - case when n = parts and upload_id % 11 = 0 then 1 else 0 end as part_length from
      (select *, cast(ceil(size_bytes * 1.0 / part_size) as bigint) as parts, unnest(range(1, cast(ceil(size_bytes * 1.0 / part_size) as bigint) + 1)) as n from fx_plan) where not (n = 1 and upload_id % 7 = 0)),
    planned as (select upload_id, n as part_number, least(part_size, size_bytes - (n - 1) * part_size) as part_length from (select *, unnest(range(1, cast(ceil(size_bytes * 1.0 / part_size) as bigint) + 1)) as n from fx_plan))"""


def stored_parts(plan):
    parts = C.part_plan(plan)
    last = parts.groupBy("upload_id").agg(F.max("part_number").alias("last"))
    out = parts.join(last, "upload_id").where(~((F.col("part_number") == 1) & (F.col("upload_id") % 7 == 0)))
    return out.withColumn("part_length", F.col("part_length") - F.when((F.col("part_number") == F.col("last")) & (F.col("upload_id") % 11 == 0), 1).otherwise(0)).drop("last")


@query("j5_pending_parts", f"with {STORED} select upload_id, part_number from planned p where not exists (select 1 from stored s where s.upload_id = p.upload_id and s.part_number = p.part_number)", "fx_plan")
def j5(plan):
    return C.pending_parts(C.part_plan(plan), stored_parts(plan)).select("upload_id", "part_number")


SPEC = {"extension": "pdf", "min_size": 5_000_000}


@query(
    "p1_document_filter",
    """
    select document_id, device_code, display_name from fx_documents d where not is_deleted and classification like '%%'
      and exists (select 1 from fx_versions v where v.document_id = d.document_id and lower(v.file_extension) = '.pdf')
      and exists (select 1 from fx_versions v where v.document_id = d.document_id and v.size_bytes >= 5000000)
    """,
    "fx_documents", "fx_versions", "fx_sources",
)
def p1(d, v, s):
    return C.document_filter(d, v, s, SPEC).select("document_id", "device_code", "display_name")


@query(
    "p1_document_filter_all",
    """
    select document_id from fx_documents d where source_type = 'old_user_data' and department = 'BUILDING' and lower(display_name) like '%1%'
      and source_record_id in (select id from fx_sources where lower(full_path) like '%customer%')
      and exists (select 1 from fx_versions v where v.document_id = d.document_id and extraction_status = 'completed')
      and exists (select 1 from fx_versions v where v.document_id = d.document_id and source_modified_at >= timestamp '1993-01-01 00:00:00')
      and exists (select 1 from fx_versions v where v.document_id = d.document_id and size_bytes <= 3000000)
    """,
    "fx_documents", "fx_versions", "fx_sources",
)
def p1_all(d, v, s):
    spec = {"source_type": "Old_User_Data", "department": "BUILDING", "name": "1", "path": "CUSTOMER", "extraction_status": "Completed", "modified_after": "1993-01-01 00:00:00", "max_size": 3_000_000, "include_deleted": True}
    return C.document_filter(d, v, s, spec).select("document_id")


@query(
    "p3_policy",
    f"""
    select id, case when size_bytes <= 0 then 'empty' when size_bytes > 20000000 then 'over limit' when size_bytes > 1000 * 10000 then 'too many parts' else '' end as reason,
      case when size_bytes <= 0 or size_bytes > 10000000 then 'skipped' else 'indexed' end as policy_status
    from fx_sources where extension in {INLIST}
    """,
    "fx_sources",
)
def p3(s):
    return C.policy_classify(s, EXTS, 20_000_000, 1000).select("id", "reason", "policy_status")


@query(
    "p4_exclusions",
    """
    with x as (select device_code, exclusion_type as t, lower(rtrim(trim(value), chr(92) || '/')) as v from fx_exclusions where is_active),
    f as (select *, string_split(lower(directory_path), chr(92)) as parts from fx_file_events)
    select seq, device_code, full_path from f where not exists (select 1 from x where x.device_code = f.device_code and (
        (t = 'folder_name' and list_contains(parts[2:], v)) or (t = 'folder_path' and (v = lower(directory_path) or starts_with(lower(directory_path), v || chr(92))))
        or (t = 'file_extension' and lower(extension) = '.' || ltrim(v, '.'))))
    """,
    "fx_file_events", "fx_exclusions",
)
def p4(f, x):
    return C.exclude_files(f, x).select("seq", "device_code", "full_path")


@query(
    "p5_exclusion_sets",
    """
    with d as (select distinct device_code from fx_exclusions), b as (
      select device_code, exclusion_type, value from fx_exclusions where is_active
      union all select device_code, t, v from d, (values ('folder_name', 'Temp'), ('folder_name', 'signup'), ('file_extension', '.tmp')) as x(t, v)),
    n as (select device_code, exclusion_type, case when exclusion_type = 'file_extension' then '.' || lower(ltrim(trim(value), '.')) else rtrim(trim(value), chr(92) || '/') end as value from b),
    o as (select device_code, exclusion_type, lower(value) as k, min(value) as value from n where value <> '' group by all)
    select device_code, exclusion_type, row_number() over (partition by device_code, exclusion_type order by k) as ordinal, value from o
    """,
    "fx_exclusions",
)
def p5(x):
    return C.exclusion_sets(x, {"folder_name": ["Temp", "signup"], "file_extension": [".tmp"]})


@query(
    "p5_exclusion_names",
    """
    with x as (select device_code, case id % 8 when 0 then 'path' when 1 then ' Excluded-Folders ' when 2 then 'name' when 3 then 'excluded_folder_name' when 4 then 'Extension' when 5 then 'excludedFileExtensions' when 6 then 'folder-path' else 'other' end as t, '..' || value || '/' as value from fx_exclusions where is_active),
    n as (select device_code, case when t in ('path', ' Excluded-Folders ', 'folder-path') then 'folder_path' when t in ('name', 'excluded_folder_name') then 'folder_name' else 'file_extension' end as exclusion_type, value from x where t <> 'other'),
    c as (select device_code, exclusion_type, case when exclusion_type = 'file_extension' then '.' || lower(ltrim(rtrim(value, chr(92) || '/'), '.')) else rtrim(value, chr(92) || '/') end as value from n)
    select device_code, exclusion_type, cast(row_number() over (partition by device_code, exclusion_type order by lower(value)) as int) as ordinal, value from c
    """,
    "fx_exclusions",
)
def p5_names(x):
    names = F.array(*(F.lit(n) for n in ("path", " Excluded-Folders ", "name", "excluded_folder_name", "Extension", "excludedFileExtensions", "folder-path", "other")))
    x = x.withColumns({"exclusion_type": F.element_at(names, (F.col("id") % 8 + 1).cast("int")), "value": F.concat(F.lit(".."), "value", F.lit("/"))})
    return C.exclusion_sets(x, {"folder_name": []})


@query(
    "p6_upload_candidates",
    f"""
    select seq, device_code, full_path from fx_file_events where not is_deleted and lower(extension) in ('.pdf', '.txt') and (uploaded_size_bytes is null or uploaded_updated_at is null or uploaded_size_bytes <> size_bytes or uploaded_updated_at <> updated_at)
      and (attempt_count = 0 or last_attempt_at is null or (attempt_count <= 2 and last_attempt_at < timestamp '{EVENTS_AS_OF}' - interval 15 minutes) or (attempt_count <= 4 and last_attempt_at < timestamp '{EVENTS_AS_OF}' - interval 2 hours)
        or (attempt_count <= 7 and last_attempt_at < timestamp '{EVENTS_AS_OF}' - interval 12 hours) or last_attempt_at < timestamp '{EVENTS_AS_OF}' - interval 7 days)
    """,
    "fx_file_events",
)
def p6(f):
    return C.upload_candidates(f, [".pdf", ".txt"], EVENTS_AS_OF).select("seq", "device_code", "full_path")


@query(
    "p9_verify_identity",
    """
    with j as (select v.version_id, d.is_deleted, case when s.id % 5 = 0 then '' else s.object_version_id end as jv, s.sha256 as js, v.size_bytes as jz,
        case when s.id % 9 = 0 then 'other' when s.id % 5 = 0 then '' else s.object_version_id end as gv, case when s.id % 8 = 0 then 'x' else upper(s.sha256) end as gs, v.size_bytes + case when s.id % 10 = 3 then 1 else 0 end as gz
      from fx_versions v join fx_documents d using (document_id) join fx_sources s on s.id = d.source_record_id)
    select version_id, case when is_deleted then 'document_deleted' when jv = '' and gv = '' then 'source_version_identity_missing' when jv <> '' and jv <> gv then 'source_version_mismatch'
      when js <> '' and lower(js) <> lower(gs) then 'checksum_mismatch' when gz > 9000000 then 'source_too_large' when jz <> gz then 'source_size_mismatch' else 'ok' end as code from j
    """,
    "fx_versions", "fx_documents", "fx_sources",
)
def p9(v, d, s):
    j = v.join(d.select("document_id", "source_record_id", "is_deleted"), "document_id").join(s.select(F.col("id").alias("source_record_id"), "object_version_id", "sha256"), "source_record_id")
    i = F.col("source_record_id")
    j = j.select(
        "version_id", "is_deleted", F.when(i % 5 == 0, "").otherwise(F.col("object_version_id")).alias("job_version_id"), F.lit("").alias("job_etag"), F.col("sha256").alias("job_sha"), F.col("size_bytes").alias("job_size"),
        F.when(i % 9 == 0, "other").when(i % 5 == 0, "").otherwise(F.col("object_version_id")).alias("got_version_id"), F.lit('"e"').alias("got_etag"), F.when(i % 8 == 0, "x").otherwise(F.upper("sha256")).alias("got_sha"),
        (F.col("size_bytes") + F.when(i % 10 == 3, 1).otherwise(0)).alias("got_size"),
    )
    return C.verify_identity(j, 9_000_000).select("version_id", "code")


@query(
    "p10_validate_sources",
    "select id, case when trim(file_name) = '' then 'blank file name' when trim(object_key) = '' then 'blank object key' when size_bytes <= 0 then 'empty' when sha256 <> '' and not regexp_matches(sha256, '^[0-9A-Fa-f]{64}$') then 'bad sha' else '' end as reason from (select id, file_name, case when id % 13 = 0 then ' ' else object_key end as object_key, size_bytes, case when id % 4 = 1 then 'zz' else sha256 end as sha256 from fx_sources)",
    "fx_sources",
)
def p10(s):
    odd = s.withColumn("object_key", F.when(F.col("id") % 13 == 0, " ").otherwise(F.col("object_key"))).withColumn("sha256", F.when(F.col("id") % 4 == 1, "zz").otherwise(F.col("sha256")))
    return C.validate_sources(odd).select("id", "reason")


@query("p11_search_file_index", "select seq, full_path from fx_file_events where contains(file_name, 'file1') or contains(full_path, 'file1') order by updated_at desc, seq limit 100", "fx_file_events")
def p11(f):
    return C.search_file_index(f, "file1").orderBy(F.desc("updated_at"), "seq").limit(100).select("seq", "full_path")


@query("p11_search_device_files", "select seq, full_path from fx_file_events where device_code = 'DEV-000007' and (contains(lower(full_path), 'click') or contains(lower(directory_path), 'click')) and lower(extension) = '.pdf' and not is_deleted", "fx_file_events")
def p11_device(f):
    return C.search_file_index(f, "CLICK", "DEV-000007", ".pdf", False).select("seq", "full_path")


@query("j1_source_paths", "select d.document_id, coalesce(s.full_path, '') as source_path from fx_documents d left join (select * from fx_sources where id % 3 <> 0) s on s.id = d.source_record_id and s.source_type = d.source_type", "fx_documents", "fx_sources")
def j1(d, s):
    return C.source_paths(d, s.where("id % 3 <> 0")).select("document_id", "source_path")


LIVE = "live as (select * from fx_documents where not is_deleted)"


@query(
    "j4_device_rollup",
    f"""
    with {LIVE}, d as (select device_code, count(*) as documents from live group by 1), b as (select device_code, count(*) as versions, sum(size_bytes) as bytes from live join fx_versions using (document_id) group by 1)
    select device_code, coalesce(documents, 0) as documents, coalesce(versions, 0) as versions, cast(coalesce(bytes, 0) as bigint) as bytes from fx_devices left join d using (device_code) left join b using (device_code)
    """,
    "fx_devices", "fx_documents", "fx_versions",
)
def j4(dev, d, v):
    return C.device_rollup(dev, d, v).select("device_code", "documents", "versions", "bytes")


@query(
    "a3_device_summary",
    f"""
    with {LIVE}, d as (select device_code, count(*) as documents from live group by 1), b as (select device_code, sum(size_bytes) as bytes from live join fx_versions using (document_id) group by 1)
    select device_code, case when coalesce(last_seen_at > timestamp '{EVENTS_AS_OF}' - interval 720 minutes, false) then 'online' else 'offline' end as status, coalesce(documents, 0) as documents, cast(coalesce(bytes, 0) as bigint) as bytes,
      row_number() over (order by coalesce(last_seen_at, registered_at) desc nulls last, device_code) - 1 as position from fx_devices left join d using (device_code) left join b using (device_code) where is_active order by position limit 500
    """,
    "fx_devices", "fx_documents", "fx_versions",
)
def a3(dev, d, v):
    out = C.device_summary(dev, d, v, EVENTS_AS_OF, ONLINE_MINUTES)
    return C.page(out, C.summary_order(), 0, 500).select("device_code", "status", "documents", "bytes", "position")


@query(
    "j6_backfill",
    """
    with v as (select v.*, d.source_type, d.source_record_id, s.object_key, case when v.version_id % 3 = 0 then '' else s.object_version_id end as object_version_id, s.sha256 from fx_versions v join fx_documents d using (document_id) join fx_sources s on s.id = d.source_record_id
      where v.version_id in (select version_id from fx_jobs where pipeline_version = 'v1')),
    m as (select s.* from (select *, size_bytes - size_bytes % 1000000 as z from fx_sources) s where status = 'completed' and not exists (select 1 from v where v.source_type = s.source_type and v.source_record_id = s.id and v.object_key = s.object_key
      and v.size_bytes - v.size_bytes % 1000000 = s.z and (s.object_version_id = '' or s.object_version_id = v.object_version_id) and (s.sha256 = '' or s.sha256 = v.sha256)))
    select id, source_type, row_number() over (order by case source_type when 'automatic_upload' then 0 else 1 end, updated_at, id) as position from m order by position limit 500
    """,
    "fx_sources", "fx_documents", "fx_versions", "fx_jobs",
)
def j6(s, d, v, j):
    key = s.select(F.col("id").alias("source_record_id"), "object_key", "object_version_id", F.lit("").alias("etag"), "sha256")
    million = F.col("size_bytes") - F.col("size_bytes") % 1_000_000
    v = v.join(d.select("document_id", "source_record_id").join(key, "source_record_id").drop("source_record_id"), "document_id")
    v = v.withColumn("object_version_id", F.when(F.col("version_id") % 3 == 0, "").otherwise(F.col("object_version_id"))).withColumn("size_bytes", million).withColumn("source_modified_at", S.ntz(AS_OF))
    s = s.withColumn("size_bytes", million).withColumn("modified_at", S.ntz(AS_OF)).withColumn("etag", F.lit(""))
    return C.backfill_candidates(s, d, v, j, "v1", 500).select("id", "source_type", "position")


@query(
    "j7_reconcile",
    "select s.id, case when trim(s.object_key) = '' then 'no_key' when i.size_bytes is null then 'missing' when i.size_bytes <> s.size_bytes then 'size_mismatch' else 'ok' end as storage_status from fx_sources s left join fx_inventory i using (object_key)",
    "fx_sources", "fx_inventory",
)
def j7(s, i):
    return C.reconcile_storage(s, i).select("id", "storage_status")


@query(
    "j9_due_log_devices",
    f"""
    select device_code from fx_devices where is_active and last_seen_at > timestamp '{EVENTS_AS_OF}' - interval 720 minutes and upper(device_code) not in (select upper(device_code) from fx_commands
      where command_type = 'REQUEST_LOGS' and (status in ('pending', 'sent_to_agent') or requested_at > timestamp '2024-01-30 00:00:00')) order by device_code limit 50
    """,
    "fx_devices", "fx_commands",
)
def j9(d, c):
    return C.due_log_devices(d, c, EVENTS_AS_OF, ONLINE_MINUTES, "2024-01-30 00:00:00", 50).select("device_code")


@query(
    "a1_storage_stats",
    """
    with r as (select lower(file_extension) as e, device_code as v, department as p, source_type as s, size_bytes from fx_versions join fx_documents using (document_id) where not is_deleted),
    u as (select 'total' as breakdown, '' as k, size_bytes from r union all select 'extension', e, size_bytes from r union all select 'device', v, size_bytes from r union all select 'department', p, size_bytes from r union all select 'source_type', s, size_bytes from r),
    g as (select breakdown, k, count(*) as versions, cast(sum(size_bytes) as bigint) as bytes from u group by all), n as (select *, row_number() over (partition by breakdown order by bytes desc, k) as rank from g)
    select breakdown, rank, case when k = '' and breakdown = 'extension' then '(none)' when k = '' and breakdown = 'department' then '(unassigned)' else k end as key, case when breakdown = 'total' then (select count(*) from fx_documents where not is_deleted) end as documents, versions, bytes from n where rank <= 25
    """,
    "fx_documents", "fx_versions", dealt=True,
)
def a1(d, v, parts):
    return C.storage_stats(d, v, parts=parts)


@query("a2_extraction_overview", "select kind, status, cast(sum(n) as bigint) as n from (select 'job' as kind, status, 1 as n from fx_jobs union all select 'version', extraction_status, 1 from fx_versions union all select 'job', s, 0 from (values ('queued'), ('running'), ('dead_letter')) x(s)) group by all", "fx_jobs", "fx_versions")
def a2(j, v):
    return C.extraction_overview(j, v)


ARCHIVE = "(select * from fx_sources where source_type = 'old_user_data')"


@query(
    "a5_import_users",
    f"""
    select import_job_id, user_folder, device_code, count(*) filter (status <> 'skipped') as indexed_files, cast(coalesce(sum(size_bytes) filter (status <> 'skipped'), 0) as bigint) as indexed_bytes, count(*) filter (status = 'completed') as completed_files,
      cast(coalesce(sum(size_bytes) filter (status = 'completed'), 0) as bigint) as completed_bytes, count(*) filter (status in ('failed', 'missing')) as failed_files, count(*) filter (status = 'skipped') as skipped_files from {ARCHIVE} group by all
    """,
    "fx_sources",
)
def a5(s):
    return C.import_user_breakdown(s.where("source_type = 'old_user_data'"))


@query(
    "a6_import_jobs",
    f"""
    select import_job_id, files, bytes, completed, failed, skipped, open, case when open > 0 then '' when failed > 0 then 'completed_with_errors' else 'completed' end as final_status from (select import_job_id * 100 + id % 60 as import_job_id, count(*) as files, cast(sum(size_bytes) as bigint) as bytes,
      count(*) filter (status = 'completed') as completed, count(*) filter (status in ('failed', 'missing')) as failed, count(*) filter (status = 'skipped') as skipped, count(*) filter (status in ('indexed', 'uploading')) as open from {ARCHIVE} group by 1)
    """,
    "fx_sources",
)
def a6(s):
    return C.import_job_rollup(s.where("source_type = 'old_user_data'").withColumn("import_job_id", F.col("import_job_id") * 100 + F.col("id") % 60))


@query(
    "a7_scan_summary",
    f"""
    select user_folder, count(*) filter (extension in {INLIST} and size_bytes > 0 and size_bytes <= 9000000) as files, cast(coalesce(sum(size_bytes) filter (extension in {INLIST} and size_bytes > 0 and size_bytes <= 9000000), 0) as bigint) as bytes,
      count(*) filter (extension in {INLIST} and not (size_bytes > 0 and size_bytes <= 9000000)) as skipped, count(*) filter (extension not in {INLIST}) as ignored from fx_sources group by 1
    """,
    "fx_sources",
)
def a7(s):
    return C.scan_summary(s, EXTS, 9_000_000)


@query(
    "a8_folder_history",
    """
    with c as (select import_job_id as root, user_folder as folder, count(*) as files from fx_sources group by all), h as (select root, folder, n - root % 2 as files, failed, skipped, stopped from (select import_job_id as root, user_folder as folder, count(*) as n, count(*) filter (status = 'failed') as failed,
      count(*) filter (status = 'skipped') as skipped, bool_or(status = 'missing') as stopped from fx_sources where id % 5 <> 0 group by all))
    select root, folder, case when failed > 0 then 'failed' when stopped then 'stopped' when c.files - coalesce(h.files, 0) > 0 then 'new ' || cast(c.files - coalesce(h.files, 0) as varchar) when skipped > 0 then 'done_skipped' else 'done' end as state from c left join h using (root, folder)
    """,
    "fx_sources",
)
def a8(s):
    cur = s.groupBy(F.col("import_job_id").alias("root"), F.col("user_folder").alias("folder")).agg(F.count(F.lit(1)).alias("files"))
    h = s.where("id % 5 <> 0").groupBy(F.col("import_job_id").alias("root"), F.col("user_folder").alias("folder"))
    h = h.agg((F.count(F.lit(1)) - F.first("import_job_id") % 2).alias("files"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.bool_or(F.col("status") == "missing").alias("stopped"))
    return C.folder_history(cur, h).select("root", "folder", "state")


DERIVED = "(select version_id, 'kind' || cast(n as varchar) as kind, n as ordinal, 'derivatives/' || cast(version_id as varchar) as object_key from (select version_id, unnest(range(0, quantity % 3)) as n from fx_versions))"


def derivatives(v):
    n = F.when(F.col("quantity") % 3 > 0, F.sequence(F.lit(0), F.col("quantity") % 3 - 1)).otherwise(F.array().cast("array<int>"))
    return v.select("version_id", F.explode(n).alias("ordinal")).select("version_id", F.concat(F.lit("kind"), F.col("ordinal").cast("string")).alias("kind"), "ordinal", F.concat(F.lit("derivatives/"), F.col("version_id").cast("string")).alias("object_key"))


@query(
    "a10_document_detail",
    f"""
    with k as (select version_id, string_agg(distinct kind, ',' order by kind) as kinds from {DERIVED} group by 1)
    select document_id, row_number() over (partition by document_id order by version_number desc) as position, version_number, version_id, size_bytes, coalesce(kinds, '') as kinds from fx_documents join fx_versions using (document_id) left join k using (version_id)
    """,
    "fx_documents", "fx_versions",
)
def a10(d, v):
    out = C.document_detail(d.select("document_id"), v, derivatives(v)).select("document_id", F.posexplode("versions").alias("p", "x"))
    return out.select("document_id", (F.col("p") + 1).alias("position"), "x.version_number", "x.version_id", "x.size_bytes", F.array_join("x.kinds", ",").alias("kinds"))


@query(
    "j8_file_metadata",
    f"select v.version_id, d.display_name, v.file_name, coalesce(x.n, 0) as derivatives, coalesce(x.names, '') as names, case when v.version_id % 2 = 0 then 'application/pdf' else 'text/plain' end as content_type from fx_versions v join fx_documents d using (document_id) left join (select y.version_id, count(*) as n, string_agg(regexp_replace(file_name, '[.][^.]*$', '') || '-' || kind || '-' || cast(ordinal as varchar), ',' order by kind, ordinal) as names from {DERIVED} y join fx_versions z on z.version_id = y.version_id group by 1) x on x.version_id = v.version_id",
    "fx_versions", "fx_documents",
)
def j8(v, d):
    odd = v.withColumn("detected_content_type", F.when(F.col("version_id") % 2 == 0, "application/pdf").otherwise(" ")).withColumn("declared_content_type", F.lit("text/plain"))
    return C.file_metadata(odd, d, derivatives(v)).select("version_id", "display_name", "file_name", F.size("derivatives").cast("long").alias("derivatives"), F.array_join("derivatives", ",").alias("names"), "content_type")


@query("w1_latest_version", "select document_id, version_id, size_bytes, extraction_status from fx_versions qualify row_number() over (partition by document_id order by version_number desc) = 1", "fx_versions")
def w1(v):
    return C.latest_version(v).select("document_id", "version_id", "size_bytes", "extraction_status")


@query(
    "k1_page",
    "select version_id, (select count(*) from fx_versions) as total_count, row_number() over (order by size_bytes desc, version_id) - 1 as position, cast(60 as bigint) as next_offset from fx_versions order by size_bytes desc, version_id limit 20 offset 40",
    "fx_versions",
)
def k1(v):
    return C.page(v, [F.desc("size_bytes"), F.asc("version_id")], 40, 20).select("version_id", "total_count", "position", "next_offset")


K2 = """
    with p as (select document_id, count(*) as version_count, max(size_bytes) as max_size from fx_versions group by 1), l as (select * from fx_versions qualify row_number() over (partition by document_id order by version_number desc) = 1)
    select d.document_id, display_name, coalesce(full_path, '') as source_path, coalesce(version_count, 0) as version_count, coalesce(max_size, 0) as max_size, coalesce(l.file_name, display_name) as file_name, coalesce(file_extension, '') as file_extension,
      coalesce(l.size_bytes, 0) as size_bytes, coalesce(l.extraction_status, 'none') as extraction_status from fx_documents d left join fx_sources s on s.id = d.source_record_id and s.source_type = d.source_type left join p using (document_id) left join l using (document_id) where not is_deleted
"""


@query("k2_list_documents", K2, "fx_documents", "fx_versions", "fx_sources")
def k2(d, v, s):
    return C.list_documents(d, v, s, {}).drop("created_at", "updated_at", "modified_at")


@query("k2_seek_page", f"with k as ({K2}) select document_id, max_size from k qualify row_number() over (order by max_size desc, document_id) between 101 and 200", "fx_documents", "fx_versions", "fx_sources")
def k2_seek(d, v, s):
    """The page after the first 100."""
    rows, order = C.list_documents(d, v, s, {}), C.listing_order("size")
    key = C.seek_page(rows, order, 100).orderBy("max_size", F.desc("document_id")).select("continuation").first()[0]
    return C.seek_page(rows, order, 100, key).select("document_id", "max_size")


@query("k3_recent_failures", "select job_id, document_id, status, error_code from fx_jobs j join fx_versions v using (version_id) where status in ('dead_letter', 'retry_wait') or error_code <> '' order by j.updated_at desc, job_id limit 200", "fx_jobs", "fx_versions")
def k3(j, v):
    return C.recent_failures(j, v, 200).select("job_id", "document_id", "status", "error_code")


@query("k4_sync_batches", "select seq, device_code, (row_number() over (partition by device_code order by seq) - 1) // 20 as batch from fx_file_events where attempt_count % 3 <> 1", "fx_file_events")
def k4(f):
    return C.sync_batches(f.withColumn("sync_status", F.when(F.col("attempt_count") % 3 != 1, "pending").otherwise("synced")), 20).select("seq", "device_code", "batch")


@query("k5_claimable_imports", f"select id, import_job_id, row_number() over (partition by import_job_id order by user_folder, full_path, id) as position from {ARCHIVE} where status in ('indexed', 'uploading') qualify position <= 20", "fx_sources")
def k5(s):
    return C.claimable_import_files(s.where("source_type = 'old_user_data'"), 20).select("id", "import_job_id", "position")


@query("k6_list_imports", f"select id, full_path from {ARCHIVE} where status = 'completed' and (contains(lower(file_name), 'blue') or contains(lower(relative_path), 'blue'))", "fx_sources")
def k6(s):
    return C.list_import_files(s.where("source_type = 'old_user_data'"), None, "completed", "BLUE").select("id", "full_path")


@query("o1_ingestion_feed", "select s.id, s.source_type, status, coalesce(document_id, -1) as document_id, updated_at as at from fx_sources s left join (select source_type, source_record_id, document_id from fx_documents where document_id % 4 <> 1) d on d.source_type = s.source_type and d.source_record_id = s.id", "fx_sources", "fx_documents")
def o1(s, d):
    return C.ingestion_feed(s, d.where("document_id % 4 <> 1")).select("id", "source_type", "status", F.coalesce("document_id", F.lit(-1).cast("long")).alias("document_id"), "at")


@query(
    "o1_feed_page",
    """
    with f as (select s.id, s.source_type, status, coalesce(document_id, -1) as document_id, s.updated_at as "at" from fx_sources s left join fx_documents d on d.source_type = s.source_type and d.source_record_id = s.id where s.source_type = 'automatic_upload' and status = 'completed')
    select *, (select count(*) from f) as total_count, row_number() over (order by "at" desc, id) - 1 as position, case when (select count(*) from f) > 120 then cast(120 as bigint) end as next_offset from f qualify position between 20 and 119
    """,
    "fx_sources", "fx_documents",
)
def o1_page(s, d):
    feed = C.ingestion_feed(s, d, source=" Automatic_Upload", status="completed").select("id", "source_type", "status", F.coalesce("document_id", F.lit(-1).cast("long")).alias("document_id"), "at")
    out = C.page(feed, [F.col(c).desc() if down else F.col(c).asc() for c, down in C.FEED_ORDER], 20, 100)
    return out.withColumns({c: F.col(c).cast("long") for c in ("position", "total_count", "next_offset")})


@query(
    "o3_distinct_paths",
    "select distinct device_code, trim(p) as path from (select device_code, unnest([full_path, ' ' || full_path || ' ', ' ', directory_path]) as p from fx_file_events) where trim(p) <> ''",
    "fx_file_events",
)
def o3(f):
    paths = F.to_json(F.array("full_path", F.concat(F.lit(" "), "full_path", F.lit(" ")), F.lit(" "), "directory_path"))
    out = C.distinct_paths(f.select("device_code", paths.alias("requested_paths_json")))
    return out.select("device_code", F.explode("paths").alias("path")).distinct()


@query("j3_attach_document_ids", "select s.id, s.source_type, coalesce(document_id, -1) as document_id from fx_sources s left join (select * from fx_documents where document_id % 3 = 0) d on d.source_type = s.source_type and d.source_record_id = s.id", "fx_sources", "fx_documents")
def j3(s, d):
    out = C.attach_document_ids(s.select("id", "source_type"), d.where("document_id % 3 = 0"))
    return out.select("id", "source_type", F.coalesce("document_id", F.lit(-1).cast("long")).alias("document_id"))


@query(
    "o2_due_except",
    f"select upper(device_code) as device_code from fx_devices where is_active and last_seen_at > timestamp '{EVENTS_AS_OF}' - interval 14400 minutes except select upper(device_code) from fx_commands where command_type = 'REQUEST_LOGS' and status = 'pending'",
    "fx_devices", "fx_commands",
)
def o2(d, c):
    return C.due_log_devices(d, c.where("status = 'pending'"), EVENTS_AS_OF, 14_400, "2030-01-01 00:00:00", None).select("device_code")


@query(
    "u_keys_and_names",
    """
    with s as (select *, case id % 4 when 0 then '' when 1 then ' ..PDF ' when 2 then 'Txt' else '.Csv' end as e, substr('ABCXYZ', cast(1 + id % 6 as int), 1) || case when id % 2 = 0 then '' else substr('AMZ', cast(1 + id % 3 as int), 1) end as l from fx_sources)
    select id, case id % 4 when 0 then '' when 1 then '..pdf' when 2 then '.txt' else '.csv' end as ext, case id % 4 when 1 then '.csv,.pdf' when 2 then '.csv,.txt' else '.csv' end as exts, case when length(l) = 1 then ascii(l) - 65 else (ascii(l[1:1]) - 64) * 26 + ascii(l[2:2]) - 65 end as col,
      'devices/' || device_code || '/' || sha256(upper(replace(full_path, chr(92), '/'))) || '/' || sha256(size_bytes || ':' || (cast(epoch_us(modified_at) as bigint) * 10 + 621355968000000000) || ':' || sha256) || '/' || file_name as object_key from s
    """,
    "fx_sources",
)
def u_keys(s):
    """U2 in its catalogue and list forms, U5 hashed, U13 inverse."""
    i = F.col("id")
    pick = lambda text, n: F.substring(F.lit(text), (i % n + 1).cast("int"), F.lit(1))
    ext = F.when(i % 4 == 0, "").when(i % 4 == 1, " ..PDF ").when(i % 4 == 2, "Txt").otherwise(".Csv")
    cell = F.concat(pick("ABCXYZ", 6), F.when(i % 2 == 0, "").otherwise(pick("AMZ", 3)), F.lit("12"))
    return s.select(
        "id", S.norm_ext_catalogue(ext).alias("ext"), F.array_join(S.norm_ext_list(F.array(ext, F.lit("CSV"), F.lit(" "))), ",").alias("exts"), S.column_index(cell).alias("col"),
        S.hashed_object_key("device_code", "full_path", "file_name", "size_bytes", "modified_at", "sha256").alias("object_key"),
    )
