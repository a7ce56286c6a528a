"""The tables of the catalogue with fixed schemas, from Parquet or over JDBC in ranges of a column."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIMES = "created_at timestamp_ntz, updated_at timestamp_ntz"
_OBJECT = "object_key string, object_version_id string, etag string"
_FILE = "device_code string, full_path string"

#: Columns and types of each table; ids are text, times are UTC without zone.
SCHEMAS = {
    "devices": "id string, device_code string, nickname string, hostname string, username string, agent_version string, status string, last_seen_at timestamp_ntz, registered_at timestamp_ntz, is_active boolean",
    "file_index": f"id string, {_FILE}, directory_path string, file_name string, extension string, size_bytes long, {_TIMES}, last_indexed_at timestamp_ntz, is_deleted boolean",
    "local_files": f"{_FILE}, directory_path string, file_name string, extension string, size_bytes long, {_TIMES}, last_seen timestamp_ntz, sync_status string, attempt_count int, last_attempt_at timestamp_ntz, upload_status string, uploaded_size_bytes long, uploaded_updated_at timestamp_ntz, is_deleted boolean",
    "uploads": f"id string, {_FILE}, path_identity string, file_name string, extension string, size_bytes long, modified_at timestamp_ntz, content_type string, {_OBJECT}, sha256 string, multipart_id string, part_size long, status string, error_message string, {_TIMES}, completed_at timestamp_ntz",
    "import_jobs": f"import_job_id string, root_path string, root_path_identity string, source_label string, status string, indexed_count long, indexed_bytes long, uploaded_count long, uploaded_bytes long, failed_count long, error_message string, {_TIMES}, scan_completed_at timestamp_ntz, completed_at timestamp_ntz",
    "import_files": f"id string, import_job_id string, user_folder string, {_FILE}, relative_path string, file_name string, extension string, size_bytes long, {_TIMES}, content_type string, {_OBJECT}, sha256 string, multipart_id string, part_size long, uploaded_bytes long, status string, attempt_count int, error_message string, indexed_at timestamp_ntz, upload_started_at timestamp_ntz, lease_until timestamp_ntz, completed_at timestamp_ntz",
    "documents": f"document_id string, source_type string, source_record_id string, device_code string, display_name string, classification string, department string, is_deleted boolean, {_TIMES}",
    "versions": f"version_id string, document_id string, version_number int, source_version_key string, file_name string, file_extension string, bucket_name string, {_OBJECT}, size_bytes long, source_modified_at timestamp_ntz, declared_content_type string, detected_content_type string, sha256 string, extraction_status string, page_count int, section_count int, pipeline_version string, metadata string, derivative_prefix string, error_code string, error_message string, {_TIMES}, extracted_at timestamp_ntz",
    "jobs": f"job_id string, version_id string, pipeline_version string, status string, priority int, attempt_count int, max_attempts int, lease_owner string, lease_token string, lease_until timestamp_ntz, heartbeat_at timestamp_ntz, next_attempt_at timestamp_ntz, error_code string, error_message string, {_TIMES}, started_at timestamp_ntz, last_attempt_at timestamp_ntz, completed_at timestamp_ntz",
    "sections": "section_id string, version_id string, pipeline_version string, ordinal int, section_type string, section_number int, heading string, content string, ocr_content string, sha256 string, characters int, tokens int, language string, locator string, metadata string, created_at timestamp_ntz",
    "derivatives": f"derivative_id string, version_id string, pipeline_version string, kind string, ordinal int, bucket_name string, {_OBJECT}, content_type string, size_bytes long, sha256 string, metadata string, created_at timestamp_ntz",
    "exclusions": "id string, device_code string, exclusion_type string, value string, created_by string, created_at timestamp_ntz, is_active boolean",
    "commands": "id string, device_code string, command_type string, payload string, status string, requested_by string, requested_at timestamp_ntz, sent_at timestamp_ntz, completed_at timestamp_ntz, error_message string",
    "file_requests": "id string, device_code string, requested_path string, requested_by string, reason string, status string, requested_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, server_path string, original_name string, error_message string, request_type string, requested_paths_json string",
    "agent_logs": "id string, device_code string, request_id string, level string, category string, message string, step string, details string, created_at timestamp_ntz",
    "diagnostics": "id string, device_code string, command_id string, agent_version string, service_status string, windows_version string, service_account string, internet_working boolean, api_reachable boolean, free_bytes long, current_task string, last_request string, last_error string, last_heartbeat_at timestamp_ntz, pending_count int, details string, created_at timestamp_ntz",
    "agent_versions": "id string, version string, download_url string, sha256 string, is_mandatory boolean, is_active boolean, release_notes string, created_at timestamp_ntz",
    "upload_policy": "id string, is_enabled boolean, extensions_json string, max_size_bytes long, updated_at timestamp_ntz",
}


class Database(NamedTuple):
    """A database: its JDBC address and properties, the column by whose ranges a table is read (a number, date or time) and in how many parts; tables without that column are read in one part."""

    url: str
    column: str = "created_at"
    parts: int = 8
    properties: dict[str, str] = {}


def read_tables(spark: SparkSession, where: str | Database, names: list[str] | tuple[str, ...], schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The named tables with their fixed schemas (SCHEMAS unless given, as DDL): no schema is taken from the data. where is a folder of name.parquet, or a database.

    Columns that a file lacks are null; others than those of the schema are not read.
    """
    return {n: (_from_database if isinstance(where, Database) else _from_files)(spark, where, n, (schemas or SCHEMAS)[n]) for n in names}


def _from_files(spark: SparkSession, path: str, name: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(f"{path}/{name}.parquet")


def _from_database(spark: SparkSession, db: Database, name: str, ddl: str) -> DataFrame:
    read = lambda table: spark.read.format("jdbc").options(url=db.url, dbtable=table, **db.properties)
    wanted = T.StructType.fromDDL(ddl)
    ask = read(name)
    if db.column in wanted.names and db.parts > 1:
        column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(db.url).quoteIdentifier(db.column)
        low, high = read(f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {name}) range_of_table").load().first()
        if low is not None and low != high:
            ask = ask.options(partitionColumn=db.column, lowerBound=str(low), upperBound=str(high), numPartitions=db.parts)  # rows with null are in the first part
    rows = ask.load()
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*((F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields))
