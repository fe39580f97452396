"""Source trees as a Spark data source: ``spark.read.format("source_tree")``.

Lists every file below repository roots on any storage that Arrow's file
systems reach (local or mounted disks, HDFS, S3, GCS, Azure), hidden names
included, which Spark's own file index passes over. What cannot be listed comes
out as a row with its error.

Options: ``roots`` (JSON list of paths or URIs) or ``parent`` (a folder whose
subfolders are the roots), ``skip`` and ``admit`` (JSON lists of directory
names; names that begin with a dot are skipped too), ``splits``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as storage
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING_SCHEMA = "root string, path string, size_bytes bigint, error string"
#: Levels of directories that planning opens at most; below, tasks walk on.
PLANNED_LEVELS = 3


def storage_of(uri: str) -> tuple[storage.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return storage.FileSystem.from_uri(uri)
    return storage.LocalFileSystem(), os.path.abspath(uri)


def children(root: str, path: str) -> list[tuple[str, bool, int, str | None]]:
    """``(path, is_dir, size, error)`` of a directory's entries by name; links to directories are left out."""
    try:
        system, base = storage_of(root)
        folder = f"{base}/{path}" if path else base
        local = isinstance(system, storage.LocalFileSystem)
        if local:  # a selector passes over links that lead nowhere
            found = system.get_file_info([f"{folder}/{name}" for name in os.listdir(folder)])
        else:
            found = system.get_file_info(storage.FileSelector(folder))
    except OSError as failed:
        return [(path, False, 0, str(failed))]
    out = []
    for info in sorted(found, key=lambda i: i.base_name):
        child = f"{path}/{info.base_name}" if path else info.base_name
        if info.type == storage.FileType.Directory:
            if not (local and os.path.islink(info.path)):
                out.append((child, True, 0, None))
        elif info.type == storage.FileType.File:
            out.append((child, False, info.size, None))
        else:
            out.append((child, False, 0, "not found" if info.type == storage.FileType.NotFound else "not a file"))
    return out


@dataclass
class Part(InputPartition):
    """Rows that planning has seen already, and directories to walk."""

    rows: list
    folders: list


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.skip = frozenset(json.loads(options.get("skip", "[]")))
        self.admit = frozenset(json.loads(options.get("admit", "[]")))
        self.splits = int(options.get("splits", "8"))
        self.roots = json.loads(options.get("roots", "[]"))
        self.parent = options.get("parent")

    def _wanted(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return name in self.admit or not (name in self.skip or name.startswith("."))

    def _open(self, root: str, folder: str) -> tuple[list, list]:
        """Rows of a directory's files and errors, and its directories."""
        rows, folders = [], []
        for path, is_dir, size, error in children(root, folder):
            if not is_dir:
                rows.append((root, path, size, error))
            elif self._wanted(path):
                folders.append((root, path))
        return rows, folders

    def partitions(self) -> list[Part]:
        """Open the upper levels until there are a few directories per task, then deal them out.

        So a single large repository is walked by many tasks, and a fleet of
        many repositories is planned by their names alone.
        """
        rows: list = []
        folders = [(root.rstrip("/"), "") for root in self.roots]
        if self.parent:
            above = self.parent.rstrip("/")
            for path, is_dir, _, error in children(above, ""):
                if is_dir:
                    folders.append((f"{above}/{path}", ""))
                elif error:
                    rows.append((above, path, 0, error))
        for _ in range(PLANNED_LEVELS):
            if not folders or len(folders) >= 4 * self.splits:
                break
            opened = [self._open(*folder) for folder in folders]
            rows += [row for found, _ in opened for row in found]
            folders = [below for _, found in opened for below in found]
        n = max(1, min(self.splits, len(rows) + len(folders)))
        return [Part(rows[k::n], folders[k::n]) for k in range(n)]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from partition.rows
        todo = list(partition.folders)
        while todo:
            rows, below = self._open(*todo.pop())
            yield from rows
            todo += below


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
