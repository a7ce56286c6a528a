"""Queries over document text and search, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import postings, search, text
from larkspur.plans.registry import query
from larkspur.sources import documents, files


@query("d1_plain_sections", "select doc_id, length(text) as characters, case when length(text) = 0 then 0 else length(text) - length(replace(text, chr(10), '')) + 1 end as lines from documents", "documents")
def d1(d):
    return text.plain_sections(d).select("doc_id", "characters", "lines")


@query(
    "d2_split_pages",
    """
    with g as (select doc_id, ordinal // 3 as p, string_agg(content, ' ' order by ordinal) as t from fx_lines group by all), f as (select doc_id, string_agg(t, chr(12) order by p) || chr(12) as text from g group by 1),
    s as (select doc_id, list_transform(string_split(text, chr(12)), lambda x: trim(x)) as pages from f), c as (select doc_id, case when len(pages) > 1 and pages[-1] = '' then pages[:-2] else pages end as pages from s)
    select doc_id, cast(generate_subscripts(pages, 1) as int) as page, unnest(pages) as content, false as needs_ocr from c
    """,
    "fx_lines",
)
def d2(lines):
    g = lines.groupBy("doc_id", F.floor(F.col("ordinal") / 3).alias("p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), " ").alias("t"))
    f = g.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), "\f"), F.lit("\f")).alias("text"))
    return text.split_pages(f)


SHAPES = "(select doc_id as doc, ordinal // 6 as slide, case ordinal % 6 when 4 then 'table' when 5 then 'notes' else 'box' end as part, ordinal as seq, case ordinal % 6 when 0 then 'title' when 1 then 'footer' else '' end as placeholder, content as text from fx_lines)"


def shapes(lines):
    k = F.col("ordinal") % 6
    part, place = F.when(k == 4, "table").when(k == 5, "notes").otherwise("box"), F.when(k == 0, "title").when(k == 1, "footer").otherwise("")
    return lines.select(F.col("doc_id").alias("doc"), F.floor(F.col("ordinal") / 6).alias("slide"), part.alias("part"), F.col("ordinal").alias("seq"), place.alias("placeholder"), F.col("content").alias("text"))


@query(
    "d3_slide_text",
    f"""
    with s as (select * from {SHAPES} where trim(text) <> ''), h as (select doc, slide, min_by(text, seq) as heading from s where placeholder = 'title' group by all),
    o as (select doc, slide, text, min(struct_pack(l := part = 'notes', q := seq)) as pl from s where placeholder <> 'footer' group by all), c as (select doc, slide, string_agg(text, chr(10) order by pl) as content from o group by all)
    select doc, slide, coalesce(heading, '') as heading, content from c left join h using (doc, slide)
    """,
    "fx_lines",
)
def d3(lines):
    return text.slide_text(shapes(lines))


@query("d4_chunk_totals", "select section_id, version_id, length(content) as characters, sha256(content) as hash from fx_sections", "fx_sections")
def d4(s):
    """The chunks put together again are the sections."""
    c = text.chunk_sections(s, 2000).groupBy("section_id", "version_id")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "")
    return c.agg(whole.alias("w")).select("section_id", "version_id", F.length("w").alias("characters"), F.sha2("w", 256).alias("hash"))


def chunks_sql(source):
    """Chunks of 2,000 characters of source (section_id, content), one after the other: cut after the last line feed among the last 500, if there is one."""
    feed = "strpos(reverse(substring(content, {0} + 1501, 500)), chr(10))"
    end = f"case when length(content) - {{0}} <= 2000 then length(content) when {feed} > 0 then {{0}} + 2001 - {feed} else {{0}} + 2000 end"
    return f"""with recursive s as ({source}), c(section_id, k, a, b) as (select section_id, 0, 0, {end.format("0")} from s union all select c.section_id, k + 1, c.b, {end.format("c.b")} from c join s on s.section_id = c.section_id where c.b < length(content))
    select c.section_id, k as chunk_index, cast(count(*) over (partition by c.section_id) as int) as chunk_count, cast(b - a as int) as characters, sha256(substring(content, a + 1, b - a)) as hash from c join s on s.section_id = c.section_id"""


def chunks(s):
    return text.chunk_sections(s, 2000).select("section_id", "chunk_index", "chunk_count", F.length("content").alias("characters"), F.sha2("content", 256).alias("hash"))


@query("d4_chunk_sections", chunks_sql("select section_id, content from fx_sections"), "fx_sections")
def d4_chunks(s):
    return chunks(s)


@query("d4_chunk_documents", chunks_sql("select doc_id as section_id, text as content from documents"), "documents")
def d4_documents(d):
    """Whole documents, which have line feeds to be cut at."""
    return chunks(d.select(F.col("doc_id").alias("section_id"), F.col("text").alias("content")))


@query(
    "d5_map_sections",
    """
    with s as (select *, case ordinal % 3 when 0 then '' when 1 then 'ocr_page' else 'page' end as t, ' ' || left(content, 20) as h from fx_sections), m as (select version_id, cast(row_number() over (partition by version_id order by ordinal, section_id) - 1 as int) as ordinal, case when t = '' then 'section' else t end as section_type, trim(h) as heading,
      case when t = 'ocr_page' then '' else content end as content, case when t = 'ocr_page' then content else '' end as ocr_content from s)
    select *, length(content) + length(ocr_content) as characters, sha256(length(section_type) || ':' || section_type || length(heading) || ':' || heading || length(content) || ':' || content || length(ocr_content) || ':' || ocr_content) as content_hash, '{"ordinal":' || ordinal || '}' as locator from m
    """,
    "fx_sections",
)
def d5(s):
    k = F.col("ordinal") % 3
    s = s.withColumns({"section_type": F.when(k == 0, "").when(k == 1, "ocr_page").otherwise("page"), "heading": F.concat(F.lit(" "), F.substring("content", 1, 20))})
    return text.map_sections(s)


@query("d6_extraction_summary", "select version_id, count(*) as sections, max(ordinal // 2) as pages, cast(sum(length(content)) as bigint) as characters from fx_sections group by 1", "fx_sections")
def d6(s):
    return text.extraction_summary(s.withColumn("section_number", F.floor(F.col("ordinal") / 2)))


@query(
    "d6_extraction_report",
    "select v.version_id, lower(file_extension) as format, count(s.version_id) as sections, case when v.version_id % 3 = 0 then v.quantity end as page_count, case when v.version_id % 2 = 0 then 'w' else '' end as warnings from fx_versions v left join fx_sections s on s.version_id = v.version_id group by v.version_id, file_extension, v.quantity",
    "fx_versions", "fx_sections",
)
def d6_report(v, s):
    i = F.col("version_id")
    pages = F.when(i % 3 == 0, F.create_map(F.lit("page_count"), F.col("quantity").cast("string"))).when(i % 3 == 1, F.create_map(F.lit("page_count"), F.lit("many"))).otherwise(F.create_map().cast("map<string,string>"))
    v = v.withColumns({"format": F.lower("file_extension"), "metadata": pages, "warnings": F.when(i % 2 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))})
    return text.extraction_report(v, s).select("version_id", "format", "sections", "page_count", F.array_join("warnings", ",").alias("warnings"))


@query("d7_text_budget", "select section_id, left(content, 500) as content, length(content) > 500 as truncated from fx_sections", "fx_sections")
def d7(s):
    return text.text_budget(s, 500).select("section_id", "content", "truncated")


@query(
    "w2_active_pipeline",
    """
    with s as (select version_id, case when section_id % 5 < 2 then 'v0' else 'v1' end as p from fx_sections), v as (select distinct version_id, case when version_id % 3 = 0 then 'v9' else 'v0' end as declared from fx_sections),
    n as (select version_id, p, count(*) as n from s group by all), b as (select version_id, p from n join v using (version_id) qualify row_number() over (partition by version_id order by p <> declared, n desc, p) = 1)
    select version_id, coalesce(p, declared) as pipeline from v left join b using (version_id)
    """,
    "fx_sections",
)
def w2(s):
    v = s.select("version_id").distinct().withColumn("declared", F.when(F.col("version_id") % 3 == 0, "v9").otherwise("v0"))
    return text.active_pipeline(v, s.withColumn("pipeline_version", F.when(F.col("section_id") % 5 < 2, "v0").otherwise("v1")))


@query(
    "w3_read_content",
    """
    with r as (select version_id, section_id, content, length(content) as n, row_number() over (partition by version_id order by ordinal, section_id) - 2 as position from fx_sections), u as (select *, sum(n) over (partition by version_id order by position rows between unbounded preceding and current row) as used, count(*) over (partition by version_id) as rest from r where position >= 0),
    k as (select *, count(*) over (partition by version_id) as kept from u where position < 120 and (position = 0 or used <= 3000))
    select version_id, section_id, position, left(content, 3000) as content, n > 3000 as truncated, cast(least(used, 3000) as bigint) as consumed, case when kept < rest then kept + 1 end as next_offset from k
    """,
    "fx_sections",
)
def w3(s):
    return text.read_content(s, 1, 3000)


@query(
    "w11_heading_path",
    """
    with b as (select *, max(case when level = 1 then block_no end) over w as p1, max(case when level = 2 then block_no end) over w as p2, max(case when level = 3 then block_no end) over w as p3,
      max(case when level < 2 then block_no end) over w as s2, max(case when level < 3 then block_no end) over w as s3 from fx_blocks where trim(text) <> '' window w as (partition by doc order by block_no rows between unbounded preceding and current row)),
    k as (select b.doc, b.block_no, t1.text as h1, case when s2 is null or p2 > s2 then t2.text end as h2, case when s3 is null or p3 > s3 then t3.text end as h3 from b left join fx_blocks t1 on t1.doc = b.doc and t1.block_no = p1 left join fx_blocks t2 on t2.doc = b.doc and t2.block_no = p2 left join fx_blocks t3 on t3.doc = b.doc and t3.block_no = p3)
    select doc, block_no, sha256(concat_ws('|', h1, h2, h3)) as path_hash, cast((h1 is not null)::int + (h2 is not null)::int + (h3 is not null)::int as int) as depth, coalesce(h3, h2, h1, '') as heading from k
    """,
    "fx_blocks",
)
def w11(b):
    return text.heading_path(b).select("doc", "block_no", F.sha2(F.array_join("path", "|"), 256).alias("path_hash"), F.size("path").alias("depth"), "heading")


@query(
    "w12_markdown_sections",
    """
    with l as (select doc, block_no as i, level, case when level is null then text else repeat('#', level) || ' ' || text end as line, level is not null as head from fx_blocks), g as (select *, sum(head::int) over (partition by doc order by i rows between unbounded preceding and current row) as g from l),
    a as (select doc, g, max(case when head then level end) as level, max(case when head then regexp_replace(line, '^#{1,6} ', '') end) as heading, trim(coalesce(string_agg(case when not head then line end, chr(10) order by i), '')) as body from g group by all), t as (select *, max(g) over (partition by doc) as total from a)
    select doc as doc_id, row_number() over (partition by doc order by g) as section, coalesce(level, 0) as level, trim(coalesce(heading, '')) as heading, body from t where g > 0 or body <> '' or total = 0
    """,
    "fx_blocks",
)
def w12(b):
    line = F.when(F.col("level").isNull(), F.col("text")).otherwise(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text"))
    t = b.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return text.markdown_sections(t.withColumnRenamed("doc", "doc_id"))


TYPE = "case when trim(value) = '' then 0 when regexp_matches(trim(value), '^[+-]?[0-9]{1,18}$') then 2 when regexp_matches(trim(value), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') then 4 else 32 end"
NAMED = "select file, col_no, case when k = 1 then base else base || '_' || k end as name from (select file, col_no, base, row_number() over (partition by file, lower(base) order by col_no) as k from (select file, col_no, case when trim(value) = '' then 'Column' || (col_no + 1) else trim(value) end as base from fx_cells where row_no = 0))"


@query(
    "a11_csv_profile",
    f"""
    with n as ({NAMED}), t as (select file, col_no, bit_or({TYPE}) as bits from fx_cells where row_no > 0 group by all), r as (select file, count(distinct row_no) as rows, max(col_no) as last from fx_cells where row_no > 0 group by 1)
    select file, col_no, name, case bits when 0 then 'null' when 2 then 'integer' when 4 then 'number' when 6 then 'number' else 'string' end as type, rows, 'A1:' || chr(cast(65 + last as int)) || (rows + 1) as boundary from n join t using (file, col_no) join r using (file)
    """,
    "fx_cells",
)
def a11(cells):
    return text.csv_profile(cells)


@query(
    "a12_sheet_profile",
    f"""
    with n as ({NAMED}), t as (select file, col_no, bit_or({TYPE}) as bits from fx_cells where row_no between 1 and 10 group by all), r as (select file, count(distinct row_no) as rows from fx_cells where row_no > 0 group by 1)
    select file, col_no, name, case bits when 0 then 'null' when 2 then 'integer' when 4 then 'number' when 6 then 'number' else 'string' end as type, rows from n join t using (file, col_no) join r using (file)
    """,
    "fx_cells",
)
def a12(cells):
    """Rows two apart, with blank ones between."""
    sheet = cells.withColumn("sheet", F.lit("s"))
    both = sheet.withColumn("row_no", F.col("row_no") * 2).unionByName(sheet.withColumn("row_no", F.col("row_no") * 2 + 1).withColumn("value", F.lit(" ")))
    return text.sheet_profile(both).drop("sheet")


CELLS = "c as (select file, row_no, col_no, value from fx_cells where not (col_no = 4 and row_no % 3 = 2) union all select file, row_no, 7, 'beyond' from fx_cells where col_no = 0 and row_no % 4 = 1)"


def uneven(cells):
    """Some rows are short, some have a cell beyond the header."""
    short = cells.where("NOT (col_no = 4 AND row_no % 3 = 2)").select("file", "row_no", "col_no", "value")
    return short.unionByName(cells.where("col_no = 0 AND row_no % 4 = 1").select("file", "row_no", F.lit(7).alias("col_no"), F.lit("beyond").alias("value")))


@query(
    "a11_csv_sections",
    f"""
    with n as ({NAMED}), {CELLS}, r as (select distinct file, row_no from fx_cells where row_no between 1 and 10), j as (select file, row_no, '{{' || string_agg('"' || name || '":' || coalesce('"' || c.value || '"', 'null'), ',' order by col_no) || '}}' as row from r join n using (file) left join c using (file, row_no, col_no) group by all),
    s as (select file, string_agg(row, '|' order by row_no) as sample_rows from j group by 1), t as (select file, 'Columns: ' || string_agg(name, ', ' order by col_no) as content from n group by 1)
    select file, content, sample_rows, '' as warning from t join s using (file) union all select -1 - file, null, null, 'The file is empty.' from t
    """,
    "fx_cells",
)
def a11_sections(cells):
    files = cells.select("file").distinct()
    out = text.csv_sections(files.unionByName(files.select((-1 - F.col("file")).alias("file"))), uneven(cells))
    return out.withColumn("sample_rows", F.array_join("sample_rows", "|"))


WIDE = f"n0 as ({NAMED}), n as (select file, col_no, name from n0 union all select file, k, 'Column' || (k + 1) from (select distinct file from fx_cells where row_no = 12), (values (5), (6)) as x(k))"


def wide(cells):
    """A cell of the seventh column in row 12, after the sample; blank rows between."""
    sheet = cells.select("file", "row_no", "col_no", "value").unionByName(cells.where("row_no = 12 AND col_no = 0").select("file", "row_no", F.lit(6).alias("col_no"), F.lit("x").alias("value"))).withColumn("sheet", F.lit("s"))
    return sheet.withColumn("row_no", F.col("row_no") * 2).unionByName(sheet.withColumn("row_no", F.col("row_no") * 2 + 1).withColumn("value", F.lit(" ")))


@query(
    "a12_sheet_profile_wide",
    f"""
    with {WIDE}, t as (select file, col_no, bit_or({TYPE}) as bits from fx_cells where row_no between 1 and 10 group by all), r as (select file, max(row_no) as rows from fx_cells group by 1)
    select file, col_no, name, case coalesce(bits, 0) when 0 then 'null' when 2 then 'integer' when 4 then 'number' when 6 then 'number' else 'string' end as type, rows from n left join t using (file, col_no) join r using (file)
    """,
    "fx_cells",
)
def a12_wide(cells):
    return text.sheet_profile(wide(cells)).drop("sheet")


@query(
    "a12_sheet_sections",
    f"""
    with {WIDE}, r as (select distinct file, row_no from fx_cells where row_no between 1 and 10), j as (select file, row_no, '{{' || string_agg('"' || name || '":' || coalesce('"' || c.value || '"', 'null'), ',' order by col_no) || '}}' as row from r join n using (file) left join fx_cells c using (file, row_no, col_no) group by all),
    s as (select file, string_agg(row, '|' order by row_no) as sample_rows from j group by 1), t as (select file, 'Sheet: s' || chr(10) || 'Columns: ' || string_agg(name, ', ' order by col_no) as content, count(*) as column_count from n group by 1) select file, content, column_count, sample_rows from t join s using (file)
    """,
    "fx_cells",
)
def a12_sections(cells):
    return text.sheet_sections(wide(cells)).drop("sheet").withColumn("sample_rows", F.array_join("sample_rows", "|"))


S6 = "with s as (select version_id, pipeline_version, ordinal, content from fx_sections union all select version_id, 'v0', ordinal, 'old' from fx_sections where ordinal < 2) select version_id, s.pipeline_version, s.ordinal, s.content, d.source_type, v.file_name, v.file_extension as format, cast(v.size_bytes as varchar) as size, 'w' as warning from s join fx_versions v using (version_id) join fx_documents d on d.document_id = v.document_id"


def structured(v, d, s):
    """S6 of two pipelines, the older one with the first sections alone."""
    v = v.withColumns({"format": F.col("file_extension"), "metadata": F.create_map(F.lit("size"), F.col("size_bytes").cast("string")), "warnings": F.array(F.lit("w"))})
    both = s.unionByName(s.where("ordinal < 2").withColumn("content", F.lit("old")).withColumn("pipeline_version", F.lit("v0")))
    return text.structured_json(v, d, both)


def opened(rows):
    shape = "struct<source:struct<source_type:string,file_name:string>,format:string,metadata:map<string,string>,warnings:array<string>,sections:array<struct<ordinal:int,content:string>>>"
    out = rows.select("version_id", "pipeline_version", F.from_json("json", shape).alias("j"))
    out = out.select("version_id", "pipeline_version", F.explode("j.sections").alias("x"), "j")
    return out.select("version_id", "pipeline_version", "x.ordinal", "x.content", "j.source.source_type", "j.source.file_name", "j.format", F.col("j.metadata")["size"].alias("size"), F.get("j.warnings", 0).alias("warning"))


@query("s6_structured_json", S6, "fx_versions", "fx_documents", "fx_sections")
def s6(v, d, s):
    return opened(structured(v, d, s))


@query("s6_document_files", S6, "fx_versions", "fx_documents", "fx_sections")
def s6_files(v, d, s):
    """Written as one file for each version and pipeline, and read back."""
    spark, to = s.sparkSession, files.shared_folder(s.sparkSession)
    documents.write_documents(structured(v, d, s), to)
    back = documents.read_documents(spark, to)
    return opened(back.withColumn("version_id", F.col("version_id").cast("long")))


TOKENS = "tok as (select section_id, document_id, unnest(regexp_extract_all(lower(concat_ws(' ', heading, content, ocr_content)), '[\\p{L}\\p{N}]+')) as term, generate_subscripts(regexp_extract_all(lower(concat_ws(' ', heading, content, ocr_content)), '[\\p{L}\\p{N}]+'), 1) as pos from fx_sections)"


@query("f1_term_index", f"with {TOKENS} select section_id, term, count(*) as tf, min(pos) - 1 as first_position, cast(sum(pos - 1) as bigint) as position_sum from tok group by all", "fx_sections")
def f1(s):
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return search.term_index(s).select("section_id", "term", "tf", F.array_min("positions").alias("first_position"), total.alias("position_sum"))


MATCHES = f"""{TOKENS}, has as (select section_id, document_id, bool_or(term = 'the') as the, bool_or(term = 'of') as of_, bool_or(term = 'and') as and_, bool_or(term = 'licensed') as licensed, bool_or(term = 'apache') as apache from tok group by all),
    adj as (select distinct a.section_id from tok a join tok b on a.section_id = b.section_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the'),
    m as (select 1 as query_id, section_id, document_id from has where the and of_ union all select 2, section_id, document_id from has where and_ and not the union all select 3, section_id, document_id from has where section_id in (select section_id from adj) union all select 4, section_id, document_id from has where licensed or apache)"""
SCORED = f"""{MATCHES}, w as (select * from (values (1, 'the'), (1, 'of'), (2, 'and'), (3, 'of'), (3, 'the'), (4, 'licensed'), (4, 'apache')) as x(query_id, term)), tf as (select section_id, term, count(*) as tf from tok group by all), len as (select section_id, count(*) as len from tok group by 1),
    tot as (select count(*) as n, avg(len) as a from len), df as (select term, count(*) as df from tf group by 1),
    sc as (select m.query_id, m.section_id, m.document_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) as score from m join w using (query_id) join tf on tf.section_id = m.section_id and tf.term = w.term join df on df.term = w.term join len on len.section_id = m.section_id, tot group by all)"""


def scored(s, q):
    clauses, wanted = search.query_clauses(q)
    index, whole = search.looked_up(s, search.clause_words(clauses))
    return search.search_score(index, search.search_match(index, clauses), wanted, whole)


def matched(s, q):
    clauses = search.query_clauses(q)[0]
    return search.search_match(search.term_index(s, search.clause_words(clauses)), clauses)


@query("f3_search_match", f"with {MATCHES} select query_id, section_id from m", "fx_sections", "fx_queries")
def f3(s, q):
    return matched(s, q)


@query("f4_search_score", f"with {SCORED} select query_id, section_id, score from sc", "fx_sections", "fx_queries")
def f4(s, q):
    return scored(s, q)


@query("a9_search_totals", f"with {MATCHES} select query_id, count(*) as sections, count(distinct document_id) as documents from m group by 1", "fx_sections", "fx_queries")
def a9(s, q):
    return search.search_totals(matched(s, q), s)


@query("f5_rank_flat", f"with {SCORED} select query_id, section_id, row_number() over (partition by query_id order by score desc, section_id) as rank from sc qualify rank <= 20", "fx_sections", "fx_queries")
def f5(s, q):
    return search.rank_flat(scored(s, q), 20).select("query_id", "section_id", "rank")


GROUPED = f"{SCORED}, g as (select query_id, document_id, max_by(section_id, struct_pack(s := score, i := -section_id)) as section_id, max(score) as score, count(*) as matches from sc group by all)"


@query("f6_rank_grouped", f"with {GROUPED} select query_id, document_id, section_id, matches, row_number() over (partition by query_id order by score desc, section_id) as rank from g qualify rank <= 20", "fx_sections", "fx_queries")
def f6(s, q):
    return search.rank_grouped(scored(s, q), s, 20).select("query_id", "document_id", "section_id", "matches", "rank")


@query(
    "f7_snippet",
    """
    with t as (select section_id, trim(regexp_replace(left(content, 4000), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as t from fx_sections), p as (select *, least(nullif(position('the' in lower(t)), 0), nullif(position('que' in lower(t)), 0)) as p from t),
    s as (select *, case when p is null then 1 else greatest(least(p - 160, length(t) - 319), 1) end as s from p)
    select section_id, case when length(t) <= 320 then t else (case when s > 1 then '…' else '' end) || trim(substring(t, s, 320)) || (case when s + 320 <= length(t) then '…' else '' end) end as snippet from s
    """,
    "fx_sections",
)
def f7(s):
    return search.snippet(s.withColumn("words", F.array(F.lit("the"), F.lit("que"), F.lit("of")))).select("section_id", "snippet")


@query("f8_highlight", None, "fx_sections", "fx_queries")
def f8(s, q):
    words = search.query_clauses(q)[1].groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("words"))
    page = search.rank_flat(scored(s, q), 10).join(s.select("section_id", "content"), "section_id").join(F.broadcast(words), "query_id")
    return search.highlight(page).select("query_id", "section_id", "rank", "highlight")


FOUND = SCORED.replace("from fx_sections)", "from fx_sections where version_id in (select v.version_id from fx_versions v join fx_documents d using (document_id) where not is_deleted))")


F9 = f"""
    with {FOUND}, g as (select query_id, document_id, max_by(section_id, struct_pack(s := score, i := -section_id)) as section_id, max(score) as score, count(*) as matches from sc group by all), r as (select *, row_number() over (partition by query_id order by score desc, section_id) as rank from g qualify rank <= 20)
    select query_id, rank, r.document_id, r.section_id, score, matches, display_name, coalesce(full_path, '') as source_path from r join fx_sections s on s.section_id = r.section_id join fx_versions v on v.version_id = s.version_id join fx_documents d on d.document_id = v.document_id left join fx_sources x on x.id = d.source_record_id and x.source_type = d.source_type
    """


@query("f9_search", F9, "fx_queries", "fx_sections", "fx_versions", "fx_documents", "fx_sources")
def f9(q, s, v, d, x):
    return search.search(q, s, v, d, x).drop("snippet")


def kept_up(s):
    """A stored index of all sections, reached by two rounds of changes: versions that first had other texts or were not there, some of them removed in between. Buckets go with the parts of the table, so that one fits a task at any size."""
    old = s.where("document_id % 3 = 0").unionByName(s.where("document_id % 3 = 1").withColumn("content", F.lit("the old text of the licensed words")))
    index = postings.build(old, files.shared_folder(s.sparkSession), groups=max(16, 8 * s.rdd.getNumPartitions()))
    index = postings.update(index, s.where("document_id % 3 = 1 or document_id % 5 = 0").select("version_id"), s.where("document_id % 3 = 1 and document_id % 5 <> 0"))
    return postings.update(index, s.where("document_id % 3 = 2 or document_id % 5 = 0").select("version_id"), s, writes=2)


@query("f1_stored_index", f"with {TOKENS} select section_id, term, count(*) as tf, min(pos) - 1 as first_position, cast(sum(pos - 1) as bigint) as position_sum from tok group by all", "fx_sections")
def f1_stored(s):
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return postings.postings(s.sparkSession, kept_up(s)).select("section_id", "term", "tf", F.array_min("positions").alias("first_position"), total.alias("position_sum"))


@query("f9_search_stored", F9, "fx_queries", "fx_sections", "fx_versions", "fx_documents", "fx_sources")
def f9_stored(q, s, v, d, x):
    return postings.search_stored(q, kept_up(s), v, d, x).drop("snippet")


@query("f5_top_sections", f"with {SCORED} select query_id, section_id, row_number() over (partition by query_id order by score desc, section_id) as rank from sc qualify rank <= 20", "fx_sections", "fx_queries")
def f5_top(s, q):
    return postings.top_sections(q, kept_up(s), 20).rows.select("query_id", "section_id", "rank")


PICKED = """pv as (select version_id, section_id, case when section_id % 5 < 2 then 'v0' else 'v1' end as p from fx_sections where version_id in (select v.version_id from fx_versions v join fx_documents d using (document_id) where not is_deleted and source_type = 'old_user_data' and lower(display_name) like '%1%')),
    pn as (select version_id, p, count(*) as n from pv group by all), pb as (select version_id, p from pn qualify row_number() over (partition by version_id order by p <> (case when version_id % 3 = 0 then 'v9' else 'v0' end), n desc, p) = 1)"""


@query(
    "f9_search_flat",
    f"""
    with {PICKED}, {SCORED.replace("from fx_sections)", "from fx_sections where section_id in (select section_id from pv join pb using (version_id, p)))")}, r as (select *, row_number() over (partition by query_id order by score desc, section_id) as rank from sc qualify rank <= 20)
    select query_id, rank, r.document_id, r.section_id, score, display_name, coalesce(full_path, '') as source_path, cast(true as boolean) as has_text from r join fx_documents d on d.document_id = r.document_id left join fx_sources x on x.id = d.source_record_id and x.source_type = d.source_type
    """,
    "fx_queries", "fx_sections", "fx_versions", "fx_documents", "fx_sources",
)
def f9_flat(q, s, v, d, x):
    """A document filter, the active pipeline of each version, sections instead of documents, and highlights."""
    s = s.withColumn("pipeline_version", F.when(F.col("section_id") % 5 < 2, "v0").otherwise("v1"))
    declared = v.select("version_id", F.when(F.col("version_id") % 3 == 0, "v9").otherwise("v0").alias("declared"))
    out = search.search(q, s, v, d, x, spec={"source_type": "OLD_user_data", "name": "1"}, declared=declared, grouped=False, highlights=True)
    return out.withColumn("has_text", F.length("highlight") > 0).drop("snippet", "highlight", "matches")


@query(
    "j2_search_hits",
    f"with {SCORED}, p as (select query_id, section_id from sc qualify row_number() over (partition by query_id order by score desc, section_id) <= 20) select p.query_id, p.section_id, s.content, v.file_name, d.display_name from p join fx_sections s using (section_id) join fx_versions v on v.version_id = s.version_id join fx_documents d on d.document_id = v.document_id where not is_deleted",
    "fx_sections", "fx_queries", "fx_versions", "fx_documents",
)
def j2(s, q, v, d):
    page = search.rank_flat(scored(s, q), 20).select(F.col("query_id").cast("int").alias("query_id"), "section_id")
    return search.search_hits(page, s, v, d).select("query_id", "section_id", "content", "file_name", "display_name")
