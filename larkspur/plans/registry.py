"""The queries of the library by name, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Columns whose integer width is not the one that the SQL gives (row numbers and lengths are 64 bits there), cast at the end of the query.
AS_LONG = {
    "p5_exclusion_sets": ["ordinal"], "a3_device_summary": ["position"], "j6_backfill": ["position"], "a1_storage_stats": ["rank"], "a5_import_users": ["import_job_id"], "a8_folder_history": ["root"], "a10_document_detail": ["position"],
    "k1_page": ["position"], "k5_claimable_imports": ["import_job_id", "position"], "w5_claim_batch": ["position", "owner"], "w6_dispatch": ["position"], "w8_recent_logs": ["position"], "w9_request_timeline": ["position"],
    "w10_import_progress": ["uploaded_count"], "d1_plain_sections": ["characters", "lines"], "d4_chunk_totals": ["characters"], "d5_map_sections": ["characters"], "w3_read_content": ["position"], "w12_markdown_sections": ["section"],
    "f1_term_index": ["first_position"], "f1_stored_index": ["first_position"], "f9_search_stored": ["rank"], "f5_rank_flat": ["rank"], "f5_top_sections": ["rank"], "f6_rank_grouped": ["rank"], "f9_search": ["rank"], "f9_search_flat": ["rank"], "m11_validate_derivatives": ["ordinal"],
}
AS_INT = {"d6_extraction_summary": ["pages"]} | {n: ["query_id"] for n in ("f3_search_match", "f4_search_score", "a9_search_totals", "f5_rank_flat", "f6_rank_grouped", "f9_search", "f9_search_flat", "f9_search_stored", "f5_top_sections")}


def query(name: str, sql: str | None, *tables: str, dealt: bool = False):
    """Register build(*tables as DataFrames) as query name; sql is for DuckDB and may use the fixture views. If dealt, build also takes parts (fixtures.parts)."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            how = {"parts": fixtures.parts(spark, sf_dir, *tables)} if dealt else {}
            df = build(*(fixtures.table(spark, sf_dir, t) for t in tables), **how)
            for kind, columns in (("long", AS_LONG), ("int", AS_INT)):
                df = df.withColumns({c: df[c].cast(kind) for c in columns.get(name, [])})
            return df

        QUERIES[name] = run
        if sql:
            SQL[name] = fixtures.oracle(sql)
        return build

    return register


def source(name: str, sql: str):
    """Register read(spark, sf_dir) as query name, for queries that read files themselves."""

    def register(read: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], SQL[name] = read, fixtures.oracle(sql)
        return read

    return register
