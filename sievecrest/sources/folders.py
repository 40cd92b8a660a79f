"""A data source over folders of images, masks and runs: ``spark.read.format("asset_folder")``.

One row a file below ``path``: its path, name, folder (relative to ``path``), suffix (lower case, with its
dot), bytes and time of change, and its content with ``option("content", True)``. Files are planned into
partitions of about ``partition_bytes`` bytes, or of ``partition_files`` files where only the listing is read,
so a folder with most of the files is cut like any other.

Equality, IN, prefix, suffix and substring filters on path, name, folder and suffix are pushed down: files
that fail them are never planned, let alone opened. A folder filter lists that folder alone. Other
filters stay with Spark. Pushing down needs ``spark.sql.python.filterPushdown.enabled``; ``register`` sets it.

Names that begin with a dot or an underscore are skipped, as Spark's own sources do. A missing path is
an error, an empty folder has no rows, a file without a dot has an empty suffix.
"""

from __future__ import annotations

import datetime
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

LISTED = "path string, name string, folder string, suffix string, bytes long, modified timestamp"
TEXT_COLUMNS = ("path", "name", "folder", "suffix")

_TESTS = {
    ds.EqualTo: lambda value, want: value == want,
    ds.In: lambda value, want: value in want,
    ds.StringStartsWith: lambda value, want: value.startswith(want),
    ds.StringEndsWith: lambda value, want: value.endswith(want),
    ds.StringContains: lambda value, want: want in value,
}


@dataclass
class FolderPart(ds.InputPartition):
    """Files of one task: (path, name, folder, suffix, bytes, modified)."""

    files: list[tuple]


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


def listed(path: str, folder: str | None = None) -> Iterator[tuple]:
    """Rows of all files below ``path``, or of those directly in one ``folder`` of it."""
    system, root = open_folder(path)
    root = root.rstrip("/")
    if system.get_file_info(root or "/").type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    inside = posixpath.join(root, folder) if folder else root
    selector = pafs.FileSelector(inside, recursive=folder is None, allow_not_found=True)
    for info in system.get_file_info(selector):
        below = info.path[len(root) :].strip("/")
        if info.type != pafs.FileType.File or any(p[:1] in "._" for p in below.split("/")):
            continue
        name = posixpath.basename(below)
        changed = info.mtime or datetime.datetime.fromtimestamp(0, datetime.timezone.utc)
        yield info.path, name, posixpath.dirname(below), posixpath.splitext(name)[1].lower(), info.size, changed


def planned(files: Iterable[tuple], most_bytes: int, most_files: int) -> list[FolderPart]:
    """Files in order of their path, cut where a part would grow beyond either limit."""
    parts: list[FolderPart] = []
    held: list[tuple] = []
    size = 0
    for row in sorted(files):
        if held and (size + row[4] > most_bytes or len(held) >= most_files):
            parts.append(FolderPart(held))
            held, size = [], 0
        held.append(row)
        size += row[4]
    return [*parts, FolderPart(held)] if held else parts


class FolderReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.content = options.get("content", "false").lower() == "true"
        self.most_bytes = int(options.get("partition_bytes", 128 << 20)) if self.content else 1 << 62
        self.most_files = int(options.get("partition_files", 10_000))
        self.tests: list[tuple] = []
        self.folder: str | None = None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            column = f.attribute[0] if type(f) in _TESTS and len(f.attribute) == 1 else None
            if column in TEXT_COLUMNS and f.value is not None:
                self.tests.append((TEXT_COLUMNS.index(column), type(f), f.value))
                if type(f) is ds.EqualTo and column == "folder":
                    self.folder = f.value
            elif type(f) is ds.IsNotNull and f.attribute[0] in TEXT_COLUMNS:
                continue  # never null here
            else:
                yield f

    def partitions(self) -> list[FolderPart]:
        files = listed(self.path, self.folder)
        kept = [row for row in files if all(_TESTS[kind](row[i], want) for i, kind, want in self.tests)]
        return planned(kept, self.most_bytes, self.most_files) or [FolderPart([])]

    def read(self, partition: FolderPart) -> Iterator[tuple]:
        system = open_folder(self.path)[0]
        for row in partition.files:
            if not self.content:
                yield row
                continue
            with system.open_input_stream(row[0]) as stream:
                yield (*row, stream.read())


class FolderSource(ds.DataSource):
    """Files below a folder as rows."""

    @classmethod
    def name(cls) -> str:
        return "asset_folder"

    def schema(self) -> str:
        return LISTED + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(FolderSource)


def read_folder(spark: SparkSession, path: str, content: bool = False, **options: int) -> DataFrame:
    """All files below ``path``; filter the result, and the filter is what gets listed and opened."""
    register(spark)
    return spark.read.format("asset_folder").option("content", content).options(**options).load(path)
