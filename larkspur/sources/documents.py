"""One file for each version and pipeline, all of a write published together."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from larkspur.sources.ranges import place

PUBLISHED = "published.json"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class VersionFiles(DataSource):
    """S6, the sink ``version_files``: rows (version_id, pipeline_version, json), each a file of its own below the option path.

    Each task writes into a folder of its own. When all have ended, one file names the folders of this write, and so publishes it whole and replaces what was
    published before; a write that fails publishes nothing, and a task that ran twice counts once.
    """

    @classmethod
    def name(cls) -> str:
        return "version_files"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return VersionWriter(self.options["path"].rstrip("/"))


class VersionWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[Any]) -> Written:
        fs, top = place(self.path)
        folder, n = uuid.uuid4().hex, 0
        fs.create_dir(f"{top}/{folder}", recursive=True)
        for row in iterator:
            with fs.open_output_stream(f"{top}/{folder}/{quote(str(row['version_id']), safe='')}~{quote(str(row['pipeline_version']), safe='')}.json") as out:
                out.write(row["json"].encode())
            n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = place(self.path)
        fs.create_dir(top, recursive=True)
        held = f"{top}/{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(held) as out:
            out.write(json.dumps({m.folder: m.files for m in messages if m and m.files}).encode())
        fs.move(held, f"{top}/{PUBLISHED}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = place(self.path)
        for m in messages:
            if m:
                fs.delete_dir(f"{top}/{m.folder}")


def write_documents(rows: DataFrame, path: str) -> None:
    """structured_json's rows as files below path, published together."""
    rows.sparkSession.dataSource.register(VersionFiles)
    rows.select(F.col("version_id").cast("string").alias("version_id"), F.col("pipeline_version").cast("string").alias("pipeline_version"), "json").write.format("version_files").mode("append").save(path)


#: How many characters of documents a task hands over at once.
BATCH = 4_000_000


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The files that are published at path: (version_id, pipeline_version, json). The driver knows the folders of the write's tasks only; what is in a folder is listed and read by a task."""
    fs, top = place(path)
    with fs.open_input_stream(f"{top}/{PUBLISHED}") as f:
        folders = sorted(json.loads(f.read()))
    schema, root = "version_id string, pipeline_version string, json string", path.rstrip("/")
    if not folders:
        return spark.createDataFrame([], schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                fs, at = place(f"{root}/{folder}")
                rows, size = [], 0
                for file in fs.get_file_info(FileSelector(at)):
                    if not file.base_name.endswith(".json"):
                        continue
                    with fs.open_input_stream(file.path) as f:
                        text = f.read().decode()
                    version, pipeline = map(unquote, file.base_name[:-5].split("~")[:2])
                    rows.append({"version_id": version, "pipeline_version": pipeline, "json": text})
                    size += len(text)
                    if size > BATCH:
                        yield pa.RecordBatch.from_pylist(rows, out)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, out)

    out = pa.schema([(c, pa.string()) for c in ("version_id", "pipeline_version", "json")])
    each = spark.sparkContext.parallelize([(d,) for d in folders], len(folders))  # a task for each folder
    return spark.createDataFrame(each, "folder string").mapInArrow(task, schema)
