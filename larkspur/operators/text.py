"""Document text as table jobs: sections from texts, pages, lines, blocks, slides and cells; chunking, hashing and profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import scalars as S

CHUNK = 50_000


def plain_sections(texts: DataFrame) -> DataFrame:
    """Texts (doc_id, text) with character and line counts; an empty text has no line."""
    n = F.length("text")
    return texts.withColumn("characters", n).withColumn("lines", F.when(n == 0, 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1))


def split_pages(texts: DataFrame) -> DataFrame:
    """(doc_id, page, content, needs_ocr): parts between form feeds, one blank part at the end dropped, trimmed, from 1; needs_ocr if all are blank."""
    pages = F.transform(F.split("text", "\f", -1), lambda p: F.trim(p))
    last_blank = (F.size("pages") > 1) & (F.element_at("pages", -1) == "")
    out = texts.withColumn("pages", pages).withColumn("pages", F.when(last_blank, F.slice("pages", 1, F.size("pages") - 1)).otherwise(F.col("pages")))
    out = out.withColumn("needs_ocr", F.forall("pages", lambda p: p == ""))
    return out.select("doc_id", "needs_ocr", F.posexplode("pages").alias("i", "content")).select("doc_id", (F.col("i") + 1).alias("page"), "content", "needs_ocr")


def slide_text(shapes: DataFrame, notes: bool = True) -> DataFrame:
    """D3: (doc, slide, heading, content) from shapes (doc, slide, part, seq, placeholder, text): the first title, and the distinct texts in order, notes last if asked for."""
    s = shapes.where(F.trim("text") != "")
    heading = s.where("placeholder = 'title'").groupBy("doc", "slide").agg(F.min_by("text", "seq").alias("heading"))
    parts = ["box", "table", "notes"] if notes else ["box", "table"]
    body = s.where(F.col("part").isin(*parts) & ~F.coalesce("placeholder", F.lit("")).isin("date", "footer", "number"))
    rank = F.struct((F.col("part") == "notes").alias("last"), F.col("seq"))
    one = body.groupBy("doc", "slide", "text").agg(F.min(rank).alias("at"))
    content = one.groupBy("doc", "slide").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return content.join(heading, ["doc", "slide"], "left").select("doc", "slide", F.coalesce("heading", F.lit("")).alias("heading"), "content")


def cut_text(text: str, most: int) -> list[str]:
    """Chunks of most characters, cut after the last line feed in the window's last quarter if there is one; together they are the text."""
    out, at = [], 0
    while len(text) - at > most:
        feed = text.rfind("\n", at + most - most // 4, at + most)
        end = feed + 1 if feed >= 0 else at + most
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


#: How many characters of chunks a task hands over at once.
BATCH = 2_000_000


def chunk_sections(sections: DataFrame, most: int = CHUNK) -> DataFrame:
    """Sections with long contents cut; chunk_index and chunk_count added. Only long rows go through Python, one text after the other; chunks leave in small batches."""
    names = sections.columns
    at = names.index("content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            parts: list[str] = []
            index: list[int] = []
            count: list[int] = []
            size = 0

            def packed() -> pa.RecordBatch:
                kept = [pa.array(parts, c.type) if k == at else c.take(pa.array(rows, pa.int32())) for k, c in enumerate(batch.columns)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept, pa.array(index, pa.int32()), pa.array(count, pa.int32())], [*names, "chunk_index", "chunk_count"])  # noqa: B023

            for row in range(batch.num_rows):
                found = cut_text(batch.column(at)[row].as_py(), most)
                for k, part in enumerate(found):
                    rows.append(row)
                    parts.append(part)
                    index.append(k)
                    count.append(len(found))
                    size += len(part)
                    if size > BATCH:
                        yield packed()
                        rows, parts, index, count, size = [], [], [], [], 0
            yield packed()

    long_ = F.length("content") > most
    whole = sections.where(~long_).withColumns({"chunk_index": F.lit(0), "chunk_count": F.lit(1)})
    shape = T.StructType([*(T.StructField(f.name, f.dataType) for f in sections.schema), T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_count", T.IntegerType())])
    return whole.unionByName(sections.where(long_).mapInArrow(cut, shape))


def map_sections(sections: DataFrame) -> DataFrame:
    """Ordinals anew for each version, blank types section, OCR texts in their own column, hash and locator."""
    n = (F.row_number().over(Window.partitionBy("version_id").orderBy("ordinal", "section_id")) - 1).cast("int")
    kind = F.substring(F.when(F.trim("section_type") == "", "section").otherwise(F.col("section_type")), 1, 64)
    ocr = F.contains(F.lower(kind), F.lit("ocr"))
    out = sections.withColumn("new_ordinal", n).withColumn("kind", kind)
    out = out.withColumns({"ocr_content": F.when(ocr, F.col("content")).otherwise(""), "content": F.when(ocr, "").otherwise(F.col("content")), "heading": F.substring(F.trim("heading"), 1, 1000)})
    return out.select(
        "version_id", F.col("new_ordinal").alias("ordinal"), F.col("kind").alias("section_type"), "heading", "content", "ocr_content", (F.length("content") + F.length("ocr_content")).alias("characters"),
        S.length_prefixed_sha256("kind", "heading", "content", "ocr_content").alias("content_hash"), F.to_json(F.struct(F.col("new_ordinal").alias("ordinal"))).alias("locator"),
    )


def extraction_summary(sections: DataFrame) -> DataFrame:
    """Sections, pages and characters of each version."""
    return sections.groupBy("version_id").agg(F.count(F.lit(1)).alias("sections"), F.max("section_number").alias("pages"), F.sum(F.length("content")).alias("characters"))


def extraction_report(versions: DataFrame, sections: DataFrame) -> DataFrame:
    """(version_id, format, sections, page_count, metadata, warnings) of each version, those without sections too. versions: version_id, format, metadata (a map), warnings; page_count is what the metadata say, null if that is no number."""
    n = sections.groupBy("version_id").agg(F.count(F.lit(1)).alias("sections"))
    out = versions.select("version_id", "format", "metadata", "warnings").join(n, "version_id", "left")
    page = F.try_element_at("metadata", F.lit("page_count")).try_cast("int")
    return out.select("version_id", "format", F.coalesce("sections", F.lit(0).cast("long")).alias("sections"), page.alias("page_count"), "metadata", "warnings")


def text_budget(rows: DataFrame, most: int, column: str = "content") -> DataFrame:
    """Text cut to most characters, and whether it was."""
    return rows.withColumn("truncated", F.length(column) > most).withColumn(column, F.substring(column, 1, most))


def active_pipeline(versions: DataFrame, sections: DataFrame) -> DataFrame:
    """(version_id, pipeline): the declared one if it has sections, else the one with most sections (then by name), else the declared. versions: version_id, declared."""
    n = sections.groupBy("version_id", "pipeline_version").agg(F.count(F.lit(1)).alias("n")).join(versions.select("version_id", "declared"), "version_id")
    best = F.min_by("pipeline_version", F.struct((F.col("pipeline_version") != F.col("declared")), -F.col("n"), "pipeline_version"))
    out = versions.select("version_id", "declared").join(n.groupBy("version_id").agg(best.alias("best")), "version_id", "left")
    return out.select("version_id", F.coalesce("best", "declared").alias("pipeline"))


def read_content(sections: DataFrame, offset: int, max_chars: int, most: int = 120) -> DataFrame:
    """The sections of each version from row offset on, most at most, while their lengths fit max_chars; at least one, cut to fit; next_offset is null when nothing is left. The windows run over lengths; texts are joined back for kept rows."""
    budget = max(500, min(max_chars, 40_000))
    whole = Window.partitionBy("version_id")
    w = whole.orderBy("ordinal", "section_id")
    rows = sections.select("version_id", "section_id", "ordinal", F.length("content").alias("n")).withColumn("rn", F.row_number().over(w) - 1 - offset).where("rn >= 0")
    rows = rows.withColumn("used", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("left", F.count(F.lit(1)).over(whole))
    rows = rows.where((F.col("rn") < most) & ((F.col("rn") == 0) | (F.col("used") <= budget))).withColumn("kept", F.count(F.lit(1)).over(whole))
    out = rows.join(sections.select("section_id", "content"), "section_id")
    return out.select(
        "version_id", "section_id", F.col("rn").alias("position"), F.substring("content", 1, budget).alias("content"), (F.col("n") > budget).alias("truncated"), F.least("used", F.lit(budget)).alias("consumed"),
        F.when(F.col("kept") < F.col("left"), F.col("kept") + offset).alias("next_offset"),
    )


def heading_path(blocks: DataFrame, levels: int = 9) -> DataFrame:
    """Blocks (doc, block_no, level, text) with path (the headings above and at each block) and heading. A heading clears the deeper ones."""
    w = Window.partitionBy("doc").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.where(F.trim("text") != "")
    cols: dict[str, Column] = {}
    for n in range(1, levels + 1):
        cols[f"_t{n}"] = F.last(F.when(F.col("level") == n, F.col("text")), ignorenulls=True).over(w)
        cols[f"_b{n}"] = F.last(F.when(F.col("level") == n, F.col("block_no")), ignorenulls=True).over(w)
        cols[f"_s{n}"] = F.last(F.when(F.col("level") < n, F.col("block_no")), ignorenulls=True).over(w)
    out = out.withColumns(cols)
    slot = [F.when(F.col(f"_s{n}").isNull() | (F.col(f"_b{n}") > F.col(f"_s{n}")), F.col(f"_t{n}")) for n in range(1, levels + 1)]
    path = F.filter(F.array(*slot), lambda x: x.isNotNull())
    return out.select("doc", "block_no", "level", "text", path.alias("path")).withColumn("heading", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("")))


def markdown_sections(texts: DataFrame) -> DataFrame:
    """(doc_id, section, level, heading, body): # to ###### and a space start a section; the body before the first counts if not blank; a text without headings is one section."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("line").rlike(r"^#{1,6} ")
    lines = lines.withColumn("head", is_head).withColumn("g", F.sum(F.col("head").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("i", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy("doc_id", "g").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("h"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))
    total = F.max("g").over(Window.partitionBy("doc_id"))
    out = out.withColumn("total", total).where((F.col("g") > 0) | (F.col("body") != "") | (F.col("total") == 0))
    level = F.coalesce(F.length(F.regexp_extract("h", r"^(#{1,6}) ", 1)), F.lit(0))
    return out.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("g")).alias("section"), level.alias("level"), F.coalesce(F.trim(F.regexp_replace("h", r"^#{1,6} ", "")), F.lit("")).alias("heading"), "body")


def header_names(header: DataFrame, *keys: str) -> DataFrame:
    """Column names of header cells (keys, col_no, value): blank ones ColumnN, repeats (ignoring case) get _2, _3."""
    name = F.when(F.trim("value") == "", F.concat(F.lit("Column"), (F.col("col_no") + 1).cast("string"))).otherwise(F.trim("value"))
    rank = F.row_number().over(Window.partitionBy(*keys, F.lower("base")).orderBy("col_no"))
    out = header.withColumn("base", name).withColumn("k", rank)
    return out.select(*keys, "col_no", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("k").cast("string"))).alias("name"))


def csv_profile(cells: DataFrame, most: int = 100_000) -> DataFrame:
    """(file, col_no, name, type, rows, boundary) of each column of the header; types over all data rows, by an or of type bits. Cells beyond the header are left out. A file of more than most rows has boundary error."""
    names = header_names(cells.where("row_no = 0"), "file")
    data = cells.where("row_no > 0")
    types = data.groupBy("file", "col_no").agg(F.bit_or(S.type_bits("value")).alias("bits"))
    rows = data.groupBy("file").agg(F.countDistinct("row_no").alias("rows"))
    width = names.groupBy("file").agg((F.max("col_no")).alias("last"))
    out = names.join(types, ["file", "col_no"], "left").join(rows, "file", "left").join(width, "file").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    bound = F.when(F.col("rows") > most, "error").otherwise(F.concat(F.lit("A1:"), S.column_name("last"), (F.col("rows") + 1).cast("string")))
    return out.select("file", "col_no", "name", S.merged_type(F.coalesce("bits", F.lit(0))).alias("type"), "rows", bound.alias("boundary"))


def sample_rows(cells: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample_rows): for each table its rows of cells in order, as JSON objects from name to value; a missing cell is null. cells hold the rows to show only."""
    at = cells.select(*keys, "row_no").distinct().join(names, keys).join(cells.select(*keys, "row_no", "col_no", "value"), [*keys, "row_no", "col_no"], "left")
    row = at.groupBy(*keys, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "name", "value"))).alias("c"))
    row = row.withColumn("row", F.to_json(F.map_from_entries(F.transform("c", lambda x: F.struct(x["name"], x["value"]))), {"ignoreNullFields": "false"}))
    return row.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row"))), lambda x: x["row"]).alias("sample_rows"))


def csv_sections(files: DataFrame, cells: DataFrame, sample: int = 10) -> DataFrame:
    """(file, content, sample_rows, warning) of each of files (file): the section text with the columns' names and the first sample rows; an empty file has a warning and neither."""
    names = header_names(cells.where("row_no = 0"), "file")
    content = names.groupBy("file").agg(F.concat(F.lit("Columns: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "name"))), lambda x: x["name"]), ", ")).alias("content"))
    rows = sample_rows(cells.where((F.col("row_no") > 0) & (F.col("row_no") <= sample)), names, ["file"])
    out = files.select("file").join(content, "file", "left").join(rows, "file", "left")
    warning = F.when(F.col("content").isNull(), "The file is empty.").otherwise("")
    return out.select("file", "content", F.when(F.col("content").isNotNull(), F.coalesce("sample_rows", F.array().cast("array<string>"))).alias("sample_rows"), warning.alias("warning"))


def sheet_parts(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of the rows of a sheet that are not blank, with their rank among these, and the names of all columns up to the largest; those beyond the header are ColumnN."""
    keys = ["file", "sheet"]
    full = cells.where(F.trim("value") != "").select(*keys, "row_no").distinct()
    full = full.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("row_no")))
    c = cells.join(full, [*keys, "row_no"])
    columns = c.groupBy(*keys).agg(F.max("col_no").alias("last")).select(*keys, F.explode(F.sequence(F.lit(0), "last")).alias("col_no"))
    header = columns.join(c.where("rank = 1").select(*keys, "col_no", "value"), [*keys, "col_no"], "left")
    return c, header_names(header.withColumn("value", F.coalesce("value", F.lit(""))), *keys)


def sheet_profile(cells: DataFrame, sample: int = 10) -> DataFrame:
    """As csv_profile for sheets (file, sheet, row_no, col_no, value), but blank rows do not count, the first other row is the header, columns reach to the largest, and types come from the first sample rows after the header."""
    keys = ["file", "sheet"]
    c, names = sheet_parts(cells)
    types = c.where((F.col("rank") > 1) & (F.col("rank") <= sample + 1)).groupBy(*keys, "col_no").agg(F.bit_or(S.type_bits("value")).alias("bits"))
    rows = c.groupBy(*keys).agg((F.max("rank") - 1).cast("long").alias("rows"))
    out = names.join(types, [*keys, "col_no"], "left").join(rows, keys)
    return out.select(*keys, "col_no", "name", S.merged_type(F.coalesce("bits", F.lit(0))).alias("type"), "rows")


def sheet_sections(cells: DataFrame, sample: int = 10) -> DataFrame:
    """(file, sheet, content, column_count, sample_rows) of each sheet that has a row that is not blank."""
    keys = ["file", "sheet"]
    c, names = sheet_parts(cells)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "name"))), lambda x: x["name"]), ", ")
    content = names.groupBy(*keys).agg(F.concat(F.lit("Sheet: "), F.col("sheet"), F.lit("\nColumns: "), listed).alias("content"), F.count(F.lit(1)).alias("column_count"))
    shown = c.where((F.col("rank") > 1) & (F.col("rank") <= sample + 1))
    out = content.join(sample_rows(shown, names, keys), keys, "left")
    return out.withColumn("sample_rows", F.coalesce("sample_rows", F.array().cast("array<string>")))


def structured_json(versions: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(version_id, pipeline_version, json): for each pipeline of a version one document with its source, format, metadata, warnings and ordered sections; snake-case names. versions: also format, metadata (a map) and warnings (an array)."""
    item = F.struct("ordinal", "section_type", "heading", "content", "ocr_content")
    dealt = sections.select("version_id", "pipeline_version", item.alias("item")).repartition("version_id")  # grouping and join then find each version's texts in place
    s = dealt.groupBy("version_id", "pipeline_version").agg(F.array_sort(F.collect_list("item")).alias("sections"))
    v = versions.select("version_id", "document_id", "file_name", "format", "metadata", "warnings").join(documents.select("document_id", "source_type", "device_code"), "document_id").join(s, "version_id")
    source = F.struct("document_id", "version_id", "source_type", "device_code", "file_name")
    return v.select("version_id", "pipeline_version", F.to_json(F.struct(F.lit(1).alias("schema_version"), "pipeline_version", source.alias("source"), "format", "metadata", "warnings", "sections")).alias("json"))
