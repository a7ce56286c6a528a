"""Files read by ranges inside tasks, so that what is read does not depend on how large a file is."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def place(address: str) -> tuple[Any, str]:
    """The file system of an address as Spark lists it, and the path there. ValueError or OSError if only Spark's own readers can open it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))


def can_range(address: str) -> bool:
    try:
        place(address)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def listed(spark: SparkSession, glob: str) -> DataFrame:
    """path and length of the files, without their contents; Spark leaves out empty files."""
    return spark.read.format("binaryFile").load(glob).select("path", "length")


class File:
    """A file that is read at places; read counts the bytes."""

    def __init__(self, address: str) -> None:
        fs, at = place(address)
        self.file, self.read = fs.open_input_file(at), 0
        self.size = self.file.size()

    def get(self, start: int, length: int) -> bytes:
        data = self.file.read_at(max(0, min(length, self.size - start)), start)
        self.read += len(data)
        return data


class Bytes(File):
    """The same over bytes that are there already."""

    def __init__(self, data: bytes) -> None:
        self.data, self.read, self.size = data, 0, len(data)

    def get(self, start: int, length: int) -> bytes:
        return self.data[start : start + length]
