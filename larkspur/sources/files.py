"""Sources and sinks: delimited files, raw files and their types, agent logs, and replace-together writes."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.sources import ranges, store
from larkspur.sources.delimited import read_delimited  # noqa: F401

HEAD = 8192
OCTETS = "application/octet-stream"
#: First bytes and type, in the order of the tests.
MAGIC = (
    ("255044462D", "application/pdf"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("424D", "image/bmp"),
    ("504B0304", "application/zip"),
    ("504B0506", "application/zip"),
    ("504B0708", "application/zip"),
)
#: Part of a zip that tells its type.
ZIP_PARTS = {"word/document.xml": S.CONTENT_TYPES[".docx"], "ppt/presentation.xml": S.CONTENT_TYPES[".pptx"], "xl/workbook.xml": S.CONTENT_TYPES[".xlsx"]}
#: Extension and the type its content must have.
EXPECTED = {
    ".pdf": "application/pdf",
    ".docx": S.CONTENT_TYPES[".docx"],
    ".pptx": S.CONTENT_TYPES[".pptx"],
    ".xlsx": S.CONTENT_TYPES[".xlsx"],
    ".csv": "text/csv",
    ".tsv": "text/csv",
    ".md": "text/markdown",
    ".txt": "text/plain",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".bmp": "image/bmp",
}
LOOSE = (".csv", ".tsv", ".md")
ZIPS = tuple(magic for magic, kind in MAGIC if kind == "application/zip")
MAX_ENTRIES = 10_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def read_raw(spark: SparkSession, glob: str) -> DataFrame:
    """S3: path, length, content and head (the bytes that are enough to tell the type)."""
    raw = spark.read.format("binaryFile").load(glob)
    return raw.select("path", "length", "content", F.substring("content", 1, HEAD).alias("head"))


def entries_of(file: io.RawIOBase | io.BytesIO, most: int) -> tuple[list[str] | None, str]:
    """The names in a zip, from its directory, and why it is rejected."""
    try:
        names = [x.filename for x in zipfile.ZipFile(file).infolist()]
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        return None, "invalid_archive"
    return (None, "archive_entry_limit_exceeded") if len(names) > most else (names, "")


class Window(io.RawIOBase):
    """A ranges.File as zipfile reads one: it seeks to the end and to the directory there."""

    def __init__(self, file: ranges.File) -> None:
        self.f, self.at = file, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.f.size)[whence]
        return self.at

    def readinto(self, into: memoryview) -> int:
        data = self.f.get(self.at, len(into))
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


HEADS = "path string, length long, head binary, entries array<string>, rejected string, bytes_read long"


def read_heads(spark: SparkSession, glob: str, most: int = MAX_ENTRIES) -> DataFrame:
    """S3 for mime_detect: path, length, head (the first 8,192 bytes), entries (the names in a zip), rejected (why a zip is not taken: no directory, or more than most entries) and bytes_read, which does not depend on how large a file is. Files in stores that only Spark can open: read_raw."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = ranges.File(path)
                head = f.get(0, HEAD)
                names, rejected = entries_of(Window(f), most) if head[:2] == b"PK" and head[:4].hex().upper() in ZIPS else (None, "")
                rows.append({"path": path, "length": length, "head": head, "entries": names, "rejected": rejected, "bytes_read": f.read})
            yield pa.RecordBatch.from_pylist(rows, out)

    out = pa.schema([("path", pa.string()), ("length", pa.int64()), ("head", pa.binary()), ("entries", pa.list_(pa.string())), ("rejected", pa.string()), ("bytes_read", pa.int64())])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.listed(spark, glob).repartition(tasks, "path").mapInArrow(task, HEADS)


def mime_detect(raw: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """Raw files with detected: by first bytes; else text if not empty, without NUL and valid UTF-8; else octet-stream; and rejected, a code for zips that are broken or have more than most entries.

    raw is of read_heads, or has content and head (read_raw); then the names in zips are read from content. Their case does not matter, and a backslash counts as a slash.
    """
    kind = F.when(F.hex(F.substring("head", 9, 4)) == "57454250", F.when(F.startswith(F.hex("head"), F.lit("52494646")), "image/webp"))
    for magic, name in MAGIC:
        kind = F.coalesce(F.when(F.startswith(F.hex(F.substring("head", 1, 16)), F.lit(magic)), name), kind)
    is_text = (F.length("head") > 0) & ~F.hex("head").rlike("^(..)*00") & F.is_valid_utf8(F.col("head").cast("string"))
    out = raw.withColumn("detected", F.coalesce(kind, F.when(is_text, "text/plain"), F.lit(OCTETS)))

    @F.pandas_udf("entries array<string>, rejected string")
    def looked(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([entries_of(io.BytesIO(c), most) for c in contents], columns=["entries", "rejected"])

    zips = F.col("detected") == "application/zip"
    rest, packed = out.where(~zips), out.where(zips)
    if "entries" not in raw.columns:
        rest = rest.withColumn("rejected", F.lit(""))
        packed = packed.withColumn("_zip", looked("content")).withColumns({"entries": F.col("_zip.entries"), "rejected": F.col("_zip.rejected")}).drop("_zip")
    names = F.transform("entries", lambda e: F.lower(F.replace(e, F.lit("\\"), F.lit("/"))))
    office = F.coalesce(*(F.when(F.array_contains(names, part), name) for part, name in ZIP_PARTS.items()), F.lit("application/zip"))
    packed = packed.withColumn("detected", F.when(F.col("rejected") == "", office).otherwise(F.col("detected")))
    return rest.unionByName(packed.select(*rest.columns))


def mime_gate(files: DataFrame) -> DataFrame:
    """Files (name, declared, detected) with code: accepted, unsupported_format, mime_mismatch or declared_mime_mismatch."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^.\\/]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in EXPECTED.items() for x in pair))
    out = files.withColumn("_ext", ext).withColumn("_want", F.try_element_at(known, ext))
    loose, declared = F.col("_ext").isin(*LOOSE), F.lower(F.trim(F.coalesce("declared", F.lit(""))))
    fits = (F.col("detected") == F.col("_want")) | (loose & (F.col("detected") == "text/plain"))
    said = declared.isin("", OCTETS) | (declared == F.col("_want")) | (loose & F.startswith(declared, F.lit("text/")))
    code = F.when(F.col("_want").isNull(), "unsupported_format").when(~fits, "mime_mismatch").when(~said, "declared_mime_mismatch").otherwise("accepted")
    return out.withColumn("code", code).drop("_ext", "_want")


def read_agent_log(spark: SparkSession, glob: str) -> DataFrame:
    """Columns of agent log lines; a line of another form has a null message."""
    lines = spark.read.text(glob)
    return lines.where(F.col("value").rlike(S.LOG_LINE)).select(*S.parse_log_line("value"))


PAIR = ("version_id", "pipeline_version")


def write_outputs(rows: DataFrame, path: str, replaced: DataFrame | None = None, groups: int = 64) -> store.Snapshot:
    """Replace all rows of the (version, pipeline) pairs in rows, and in replaced, by what rows has of them; a pair that is in replaced alone is emptied. Pairs with nulls cannot be replaced and are left out.

    The buckets of the pairs are written anew and published together: readers see all of the old outputs or all of the new ones, and those who
    opened a state (``store.snapshot``) go on seeing it. groups counts for a new path only; choose it so that a bucket fits a task.
    """
    spark = rows.sparkSession
    rows = rows.dropna(subset=[*PAIR])
    now = store.snapshot(spark, path)
    if now is None:
        return store.create(rows, path, [PAIR[0]], groups, PAIR)
    pairs = rows.select(*PAIR)
    pairs = (pairs.unionByName(replaced.select(*PAIR).dropna()) if replaced is not None else pairs).distinct()
    return store.rewrite(spark, now, lambda old: old.join(pairs, [*PAIR], "left_anti").unionByName(rows.select(*old.columns)), store.touched(pairs, now), PAIR)


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """The outputs that are published at path now."""
    return store.read(spark, store.snapshot(spark, path)).drop("bucket")
