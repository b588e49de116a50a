"""Tables in versions: a data source whose commit switches one pointer (SNK1, SNK2, SNK9, SNK24, STM11).

Tasks write Parquet files of their own under ``data/``; the commit lists the files of the
tasks that succeeded in a manifest, and only then moves the pointer ``CURRENT`` to it.  A
reader always finds one whole version: whatever fails before the move leaves the old one,
and an aborted job's files go.  A writer may say which version it has read; if another
has come meanwhile, it fails instead of losing that one's change.  Earlier versions stay
until ``vacuum`` and can be restored.

Paths are anything that pyarrow's file systems open on driver and executors alike; the
pointer's move replaces it at once where the file system's rename does (local disks,
NFS), and is preceded by its deletion elsewhere.  Two writers that commit within the same
moment need a lock of the caller's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_POINTER = "CURRENT"


class StaleVersion(RuntimeError):
    """Another version has been committed since the one that a writer had read."""


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class _Files(InputPartition):
    def __init__(self, path: str, file: str):
        self.path, self.file = path, file


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _text(system: fs.FileSystem, path: str) -> str | None:
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return f.read().decode()


def _put(system: fs.FileSystem, path: str, text: str) -> None:
    with system.open_output_stream(path) as f:
        f.write(text.encode())


def _manifest(path: str, name: str | None = None) -> dict | None:
    system, root = _open(path)
    name = name or _text(system, f"{root}/{_POINTER}")
    return name and json.loads(_text(system, f"{root}/{name}"))


def _point(path: str, name: str) -> None:
    """Moves the pointer to a manifest that is written already."""
    system, root = _open(path)
    new = f"{root}/{_POINTER}.{uuid.uuid4().hex}"
    _put(system, new, name)
    try:
        system.move(new, f"{root}/{_POINTER}")
    except OSError:  # no replacement by rename
        system.delete_file(f"{root}/{_POINTER}")
        system.move(new, f"{root}/{_POINTER}")


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema.json()
        expect = options.get("expect")
        self.expect = None if expect is None else int(expect)
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _open(self.path)
        system.create_dir(f"{root}/data/{self.run}", recursive=True)
        file, rows, out = f"data/{self.run}/{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if batch.num_rows:
                    out = out or pq.ParquetWriter(f"{root}/{file}", batch.schema, filesystem=system)
                    out.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return _Written(file, rows)

    def commit(self, messages: list) -> None:
        system, root = _open(self.path)
        now = (_manifest(self.path) or {"version": 0})["version"]
        if self.expect is not None and self.expect != now:
            raise StaleVersion(f"{self.path} is at version {now}, not {self.expect}")
        name = f"version-{now + 1:08d}-{self.run}.json"
        files = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.rows]
        system.create_dir(root, recursive=True)
        _put(system, f"{root}/{name}", json.dumps({"version": now + 1, "schema": self.schema, "files": files}))
        _point(self.path, name)

    def abort(self, messages: list) -> None:
        system, root = _open(self.path)
        if system.get_file_info(f"{root}/data/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/data/{self.run}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, manifest: dict):
        self.path, self.files = path, [x["file"] for x in manifest["files"]]

    def partitions(self):
        return [_Files(self.path, x) for x in self.files] or [_Files(self.path, "")]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        if partition.file:
            system, root = _open(partition.path)
            with pq.ParquetFile(f"{root}/{partition.file}", filesystem=system) as f:
                yield from f.iter_batches()


class VersionedTable(DataSource):
    """``format("versioned")`` with options ``path``, for reading ``manifest``, for writing ``expect``."""

    @classmethod
    def name(cls) -> str:
        return "versioned"

    def _found(self) -> dict:
        found = _manifest(self.options["path"], self.options.get("manifest"))
        if found is None:
            raise FileNotFoundError(f"{self.options['path']} has no version")
        return found

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._found()["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._found())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema)


def publish(df: DataFrame, path: str, expect: int | None = None) -> int:
    """SNK1, SNK9: the rows as the table's next version, whole or not at all; its number."""
    df.sparkSession.dataSource.register(VersionedTable)
    writer = df.write.format("versioned").mode("overwrite").option("path", path)
    (writer if expect is None else writer.option("expect", expect)).save()
    return version(path)


def version(path: str) -> int:
    """Number of the current version, 0 before the first."""
    return (_manifest(path) or {"version": 0})["version"]


def current(spark: SparkSession, path: str) -> DataFrame:
    """The current version; later commits don't change what this frame reads."""
    spark.dataSource.register(VersionedTable)
    system, root = _open(path)
    name = _text(system, f"{root}/{_POINTER}")
    if name is None:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.format("versioned").option("path", path).option("manifest", name).load()


def changed(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """SNK2, SNK24: read, change and put back; fails if another version has come in between."""
    was = version(path)
    publish(change(current(spark, path)), path, was)
    return current(spark, path)


def history(path: str) -> list[tuple[int, str]]:
    """Number and manifest of each version that is there, in order."""
    system, root = _open(path)
    names = [x.base_name for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("version-")]
    return sorted((int(x.split("-")[1]), x) for x in names)


def restore(path: str, number: int) -> int:
    """STM11: a new version with the files of an earlier one; its number."""
    system, root = _open(path)
    old = _manifest(path, dict(history(path))[number])
    now = version(path) + 1
    name = f"version-{now:08d}-{uuid.uuid4().hex}.json"
    _put(system, f"{root}/{name}", json.dumps(old | {"version": now}))
    _point(path, name)
    return now


def vacuum(path: str, keep: int = 2) -> None:
    """Removes all but the last ``keep`` versions, and files of none, such as those of tasks that ran twice."""
    system, root = _open(path)
    found = history(path)
    for _, name in found[:-keep] if keep else []:
        system.delete_file(f"{root}/{name}")
    used = {x["file"] for _, name in found[-keep:] for x in _manifest(path, name)["files"]}
    for x in system.get_file_info(fs.FileSelector(f"{root}/data", recursive=True, allow_not_found=True)):
        if x.type == fs.FileType.File and x.path[len(root) + 1 :] not in used:
            system.delete_file(x.path)
    for x in system.get_file_info(fs.FileSelector(root)):
        if x.base_name.startswith(f"{_POINTER}."):
            system.delete_file(x.path)
