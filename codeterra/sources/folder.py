"""The files below a folder as a data source: names and sizes, listed by tasks.

    spark.dataSource.register(FolderSource)
    spark.read.format("repository_folder").load("/shared/clone")     # path, bytes
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from codeterra.operators.inventory import SKIPPED_FILES, SKIPPED_FOLDERS

#: Folders that are opened to deal the rest to tasks, unless the option `folders` says otherwise.
FOLDERS = 256
#: Rows of a batch.
ROWS = 4096
_LEFT_OUT = re.compile(SKIPPED_FILES)
_SCHEMA = pa.schema([("path", pa.string()), ("bytes", pa.int64())])


@dataclass
class Part(InputPartition):
    """A folder below the root: all that is below it, or its own files only."""

    folder: str
    whole: bool


def _entries(root: str, folder: str) -> tuple[list[tuple[str, int]], list[str]]:
    """A folder's files that count, with their sizes, and its folders. Names that are not UTF-8 are left out, as are links."""
    files, folders = [], []
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for entry in found:
                path = os.path.join(folder, entry.name)
                if path.encode(errors="replace").decode() != path:
                    continue
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in SKIPPED_FOLDERS:
                        folders.append(path)
                elif entry.is_file(follow_symlinks=False) and not _LEFT_OUT.search(entry.name):
                    files.append((path, entry.stat(follow_symlinks=False).st_size))
    except (PermissionError, FileNotFoundError):  # as os.walk does
        pass
    return files, folders


class FolderReader(DataSourceReader):
    def __init__(self, root: str, folders: int):
        self.root, self.folders = root, folders

    def partitions(self) -> list[Part]:
        """Opens at most so many folders, the upper ones first; those met but not opened are dealt whole."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        own, rest = [], [""]
        while rest and len(own) < self.folders:
            own.append(rest.pop(0))
            rest += sorted(_entries(self.root, own[-1])[1])
        return [Part(folder, False) for folder in own] + [Part(folder, True) for folder in rest]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, rest = [], [partition.folder]
        while rest:
            files, folders = _entries(self.root, rest.pop())
            rows += files
            rest += folders if partition.whole else []
            while len(rows) >= ROWS or (rows and not rest):
                part, rows = rows[:ROWS], rows[ROWS:]
                yield pa.record_batch([pa.array(column, field.type) for column, field in zip(zip(*part), _SCHEMA)], schema=_SCHEMA)


class FolderSource(DataSource):
    """(path, bytes) of the files below `path`, which executors must see; links, generated folders, lock files and minified ones left out."""

    @classmethod
    def name(cls) -> str:
        return "repository_folder"

    def schema(self) -> str:
        return "path string, bytes bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options["path"], max(1, int(self.options.get("folders", FOLDERS))))
