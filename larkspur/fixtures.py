"""Catalogue tables derived from the driver's tables, as SQL that Spark and DuckDB both run.

Integer keys stand for ids; blank strings are never turned into nulls. ``chr(92)`` is a backslash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
#: Columns of the driver's tables.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}
#: Reference times of the catalogue and of the events, and the online window in minutes.
AS_OF, EVENTS_AS_OF, ONLINE_MINUTES = "1998-06-01 00:00:00", "2024-01-30 12:00:00", 720

VIEWS = {
    "fx_devices": """
select 'DEV-' || lpad(cast(c_custkey as string), 6, '0') as device_code,
       case when c_custkey % 3 = 0 then '' else c_name end as nickname,
       lower(c_name) as hostname, c_mktsegment as username,
       case when c_custkey % 11 = 0 then '' when c_custkey % 13 = 0 then 'dev'
            else '1.' || cast(c_nationkey % 3 as string) || '.' || cast(c_custkey % 4 as string) end as agent_version,
       c_acctbal >= 0 as is_active, e.last_seen_at, o.registered_at
from customer
left join (select user_id, max(ts) as last_seen_at from events group by user_id) e on e.user_id = c_custkey
left join (select o_custkey, min(o_orderdate) as registered_at from orders group by o_custkey) o on o.o_custkey = c_custkey""",
    "fx_sources": """
select o_orderkey as id,
       case when o_orderkey % 2 = 0 then 'automatic_upload' else 'old_user_data' end as source_type,
       'DEV-' || lpad(cast(o_custkey as string), 6, '0') as device_code,
       year(o_orderdate) as import_job_id, c_name as user_folder,
       lower(c_mktsegment) || '/' || replace(p_name, ' ', '_') || '_' || cast(o_orderkey as string) as relative_path,
       'C:' || chr(92) || 'Users' || chr(92) || c_name || chr(92) || replace(p_name, ' ', '_') || '_' || cast(o_orderkey as string) as full_path,
       replace(p_name, ' ', '_') || '_' || cast(o_orderkey as string) as file_name,
       case p_type when 'ECONOMY' then '.pdf' when 'SMALL' then '.docx' when 'LARGE' then '.xlsx'
                   when 'STANDARD' then '.csv' when 'PROMO' then '.txt' else '' end as extension,
       cast(round(o_totalprice * 100) as bigint) as size_bytes,
       o_orderdate as modified_at, o_orderdate as updated_at,
       'obj/' || cast(o_orderkey as string) as object_key,
       case when o_orderkey % 7 = 0 then '' else 'v' || cast(o_orderkey as string) end as object_version_id,
       case when o_orderkey % 6 = 0 then '' else sha2_hex end as sha256,
       case o_orderstatus when 'F' then 'completed'
            when 'O' then case when o_orderkey % 2 = 0 then 'uploading' when o_orderkey % 5 = 0 then 'missing' else 'failed' end
            else case when o_orderkey % 2 = 0 then case when o_orderkey % 4 = 0 then 'failed' else 'completed' end
                      when o_orderkey % 3 = 0 then 'skipped' else 'indexed' end end as status
from (select *, md5(cast(o_orderkey as string)) || md5(o_orderpriority) as sha2_hex from orders) o
join customer on c_custkey = o_custkey
join part on p_partkey = o_orderkey % 200""",
    "fx_documents": """
select s.id as document_id, s.source_type, s.id as source_record_id, s.device_code, s.file_name as display_name,
       lower(o_orderpriority) as classification,
       case when s.id % 10 = 0 then '' else c_mktsegment end as department,
       s.id % 17 = 0 as is_deleted, o_orderdate as created_at, o_orderdate as updated_at
from fx_sources s join orders on o_orderkey = s.id join customer on c_custkey = o_custkey""",
    "fx_versions": """
select document_id * 100 + version_number as version_id, *
from (select l_orderkey as document_id,
             cast(row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey,
                  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as int) as version_number,
             replace(p_name, ' ', '_') as file_name,
             case p_type when 'ECONOMY' then '.pdf' when 'SMALL' then '.docx' when 'LARGE' then '.XLSX'
                         when 'STANDARD' then '.csv' when 'PROMO' then '.txt' else '' end as file_extension,
             cast(round(l_extendedprice * 100) as bigint) as size_bytes,
             case when l_linenumber = 7 then null else l_shipdate end as source_modified_at,
             case l_returnflag || l_linestatus when 'AF' then 'completed' when 'RO' then 'completed' when 'AO' then 'queued'
                  when 'NF' then 'failed' when 'NO' then 'processing' else 'rejected' end as extraction_status,
             cast(l_quantity as int) as quantity, l_linenumber, l_shipdate
      from lineitem join part on p_partkey = l_partkey) x""",
    "fx_jobs": """
select version_id as job_id, version_id, case when quantity % 9 = 0 then 'v0' else 'v1' end as pipeline_version,
       case l_linenumber when 2 then 'running' when 3 then 'retry_wait' when 4 then 'completed'
            when 5 then 'rejected' when 6 then 'dead_letter' else 'queued' end as status,
       quantity % 4 as priority, quantity % 6 as attempt_count, 5 as max_attempts,
       case when l_linenumber = 2 then l_shipdate end as lease_until,
       l_shipdate as next_attempt_at, l_shipdate as updated_at,
       case when quantity % 2 = 0 then l_shipdate - interval 3 days else l_shipdate end as created_at, case when l_linenumber = 2 then l_shipdate end as started_at,
       case when l_linenumber in (3, 5, 6) then 'e' || cast(quantity % 3 as string) else '' end as error_code
from fx_versions""",
    "fx_file_events": """
select event_id as seq, 'DEV-' || lpad(cast(user_id as string), 6, '0') as device_code,
       'C:' || chr(92) || 'Users' || chr(92) || 'u' || cast(user_id as string) || chr(92) || event_type as directory_path,
       'C:' || chr(92) || 'Users' || chr(92) || 'u' || cast(user_id as string) || chr(92) || event_type || chr(92)
         || 'file' || cast(k % 5 as string) || case k % 4 when 0 then '.pdf' when 1 then '.txt' when 2 then '.tmp' else '' end as full_path,
       'file' || cast(k % 5 as string) || case k % 4 when 0 then '.pdf' when 1 then '.txt' when 2 then '.tmp' else '' end as file_name,
       case k % 4 when 0 then '.pdf' when 1 then '.txt' when 2 then '.tmp' else '' end as extension,
       cast(round(value * 100) as bigint) as size_bytes, ts as updated_at, event_type = 'error' as is_deleted,
       case when k % 2 = 0 then ts end as created_at, k % 10 as attempt_count, case when k % 3 = 0 then null else ts end as last_attempt_at,
       case k % 3 when 0 then null when 1 then cast(round(value * 100) as bigint) else 0 end as uploaded_size_bytes,
       case when k % 3 = 0 then null when k % 7 = 1 then ts + interval 1 day else ts end as uploaded_updated_at
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e""",
    "fx_exclusions": """
select c_custkey as id, 'DEV-' || lpad(cast(c_custkey as string), 6, '0') as device_code,
       case c_custkey % 3 when 0 then 'folder_name' when 1 then 'folder_path' else 'file_extension' end as exclusion_type,
       case c_custkey % 3 when 0 then 'Signup'
            when 1 then 'c:' || chr(92) || 'users' || chr(92) || 'u' || cast(c_custkey as string) || chr(92) || 'click' || chr(92)
            else 'TMP' end as value,
       c_acctbal >= 0 as is_active
from customer""",
    "fx_logs": """
select event_id as id, 'DEV-' || lpad(cast(user_id as string), 6, '0') as device_code,
       case event_type when 'error' then 'error' when 'view' then ' warning ' else '' end as level,
       event_type as category, cast(regexp_extract(props, '([0-9]+)', 1) as int) as request_id, ts as created_at
from events""",
    "fx_commands": """
select id, device_code,
       case category when 'signup' then 'REQUEST_LOGS' when 'click' then 'RUN_DIAGNOSTICS' when 'view' then 'START_SCAN'
            when 'purchase' then 'STOP_SCAN' else 'START_FILE_UPLOAD' end as command_type,
       case request_id % 5 when 0 then 'pending' when 1 then 'sent_to_agent' when 2 then 'completed' when 3 then 'failed' else 'expired' end as status,
       created_at as requested_at
from fx_logs""",
    "fx_snapshots": """
select user_id - user_id % 10 as job_id, ts as taken_at, 1000000 as indexed_count,
       row_number() over (partition by user_id - user_id % 10 order by ts, event_id) * 10 as uploaded_count,
       sum(cast(round(value * 100) as bigint)) over (partition by user_id - user_id % 10 order by ts, event_id
           rows between unbounded preceding and current row) as uploaded_bytes
from events""",
    "fx_cells": """
with p as (select cast(floor(p_partkey / 200) as bigint) as file, * from part), r as (select row_number() over (partition by file order by p_partkey) as row_no, * from p)
select file, 0 as row_no, c.col_no, c.name as value
  from (select distinct file from r) f
  cross join (select 0 as col_no, 'Name' as name union all select 1, 'name' union all select 2, '' union all select 3, 'Size' union all select 4, 'Price') c
union all select file, row_no, 0, p_name from r
union all select file, row_no, 1, p_brand from r
union all select file, row_no, 2, '' from r
union all select file, row_no, 3, cast(p_size as string) from r
union all select file, row_no, 4, cast(cast(p_retailprice as decimal(12, 2)) as string) from r""",
    "fx_inventory": """
select object_key, size_bytes + case when id % 19 = 0 then 1 else 0 end as size_bytes from fx_sources where id % 17 <> 0""",
    "fx_plan": """
select id as upload_id, size_bytes, 5000000 as part_size from fx_sources where source_type = 'automatic_upload'""",
    "fx_queries": """
select 1 as query_id, 'the of' as query union all select 2, 'and -the' union all select 3, '"of the"' union all select 4, 'licensed OR apache'""",
}
_LINES = {
    "spark": """
select doc_id, pos as ordinal, trim(line) as content from documents lateral view posexplode(split(text, '\\n')) t as pos, line where length(trim(line)) > 0""",
    "duckdb": """
select doc_id, ord - 1 as ordinal, trim(line) as content from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ord from documents) where length(trim(line)) > 0""",
}
_SECTIONS = """
select doc_id * 100000 + ordinal as section_id, doc_id * 100 + 1 as version_id, doc_id as document_id, 'v1' as pipeline_version, cast(ordinal as int) as ordinal, 'text' as section_type, '' as heading, content, '' as ocr_content from fx_lines"""
_BLOCKS = """
select doc_id as doc, cast(ordinal as int) as block_no, content as text,
       case when length(content) % 7 = 0 then 1 when length(content) % 5 = 0 then 2 when length(content) % 3 = 0 then 3 end as level from fx_lines"""


def definitions(dialect: str) -> dict[str, str]:
    return VIEWS | {"fx_lines": _LINES[dialect], "fx_sections": _SECTIONS, "fx_blocks": _BLOCKS}


def needed(sql: str, dialect: str) -> list[str]:
    """The views that sql uses, those that they use first."""
    have, out = definitions(dialect), []

    def add(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in have and name not in out:
                add(have[name])
                out.append(name)

    add(sql)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or one of the driver's tables, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    have = definitions("spark")
    text = " ".join([name, *(have[v] for v in needed(name, "spark"))])
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for v in needed(name, "spark"):
        spark.sql(have[v]).createOrReplaceTempView(v)
    return spark.table(name)


def parts(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Into how many parts rows of these views are dealt so that a part stays small whatever the input: as many as the session's shuffle partitions, and eight times the parts that their largest table is read in."""
    have = definitions("spark")
    text = " ".join(have.get(v, v) for name in names for v in (name, *needed(name, "spark")))
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), *(8 * spark.read.parquet(f"{sf_dir}/{t}.parquet").rdd.getNumPartitions() for t in used))


def oracle(sql: str) -> str:
    """sql for DuckDB, with the fixture views that it uses as common table expressions."""
    have = definitions("duckdb")
    views = ",\n".join(f"{v} as ({have[v]})" for v in needed(sql, "duckdb"))
    sql = sql.strip()
    if not views:
        return sql
    if sql[:15].lower() == "with recursive ":
        return f"with recursive {views}, {sql[15:]}"
    return f"with {views}, {sql[5:]}" if sql[:5].lower() == "with " else f"with {views}\n{sql}"
