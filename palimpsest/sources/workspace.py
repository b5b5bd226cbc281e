"""The file tree of a workspace as rows: a Python data source, split by top-level entries."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ignore import Rule, matches, parse_rules

SCHEMA = "relative_path string, size bigint, mtime_secs bigint, mtime_nanos bigint, device bigint, inode bigint, mode int, is_symlink boolean"
IGNORE_FILE = ".palimpsestignore"


def rules_of(root: str, ignore: str | None) -> list[Rule]:
    """Of the named ignore file, else of the root's own, if it has one."""
    path = ignore or os.path.join(root, IGNORE_FILE)
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8") as f:
        return parse_rules(f.read())


def row_of(root: str, relative: str) -> tuple:
    s = os.lstat(os.path.join(root, relative))
    return relative, s.st_size, s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, s.st_dev, s.st_ino, s.st_mode, stat.S_ISLNK(s.st_mode)


def walk(root: str, relative: str, rules: list[Rule], include_deps: bool) -> Iterator[tuple]:
    """Files and symbolic links at and under a path; links aren't followed, ignored directories not entered."""
    todo = [relative]
    while todo:
        path = todo.pop()
        mode = os.lstat(os.path.join(root, path)).st_mode
        directory, link = stat.S_ISDIR(mode), stat.S_ISLNK(mode)
        if matches(rules, path, directory, include_deps) or (link and matches(rules, path, True, include_deps)):
            continue
        if directory:
            todo += [f"{path}/{name}" for name in os.listdir(os.path.join(root, path))]
        elif link or stat.S_ISREG(mode):
            yield row_of(root, path)


class TopLevel(InputPartition):
    def __init__(self, name: str):
        self.name = name


class WorkspaceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.include_deps = options.get("include_deps", "false").lower() == "true"
        self.rules = rules_of(self.root, options.get("ignore"))

    def partitions(self) -> list[TopLevel]:
        return [TopLevel(name) for name in sorted(os.listdir(self.root))]

    def read(self, partition: TopLevel) -> Iterator[tuple]:
        if partition is not None:
            yield from walk(self.root, partition.name, self.rules, self.include_deps)


class WorkspaceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(self.options)


def read_workspace(spark: SparkSession, root: str, *, ignore: str | None = None, include_deps: bool = False) -> DataFrame:
    """The files of a tree that executors can see under the same path."""
    spark.dataSource.register(WorkspaceSource)
    reader = spark.read.format("workspace").option("path", root).option("include_deps", str(include_deps).lower())
    return (reader.option("ignore", ignore) if ignore else reader).load()


#: Bytes of files that one batch of rows holds, but for the last file; bytes that are read at once for a hash.
BATCH_BYTES, READ_BYTES = 32 << 20, 1 << 20


def content_of(root: str, relative: str) -> bytes:
    """A file's bytes; of a symbolic link, its target's text."""
    path = os.path.join(root, relative)
    if os.path.islink(path):
        return os.readlink(path).encode()
    with open(path, "rb") as f:
        return f.read()


def hash_of(root: str, relative: str, new=hashlib.md5) -> str:
    """The hash of a file's bytes, read bit by bit, or of a symbolic link's target text."""
    path, h = os.path.join(root, relative), new()
    if os.path.islink(path):
        h.update(os.readlink(path).encode())
    else:
        with open(path, "rb") as f:
            while data := f.read(READ_BYTES):
                h.update(data)
    return h.hexdigest()


def _mapped(files: DataFrame, name: str, kind: T.DataType, arrow: pa.DataType, read, weigh) -> DataFrame:
    """files with a column of read(relative path); batches end where weigh() of what was read adds up to BATCH_BYTES."""
    schema = T.StructType([*files.schema.fields, T.StructField(name, kind)])
    place = files.columns.index("relative_path")

    def run(batches):
        for batch in batches:
            begin, weight, found = 0, 0, []
            for k, path in enumerate(batch.column(place).to_pylist()):
                found.append(read(path))
                weight += weigh(found[-1])
                if weight >= BATCH_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(found)).columns, pa.array(found, arrow)], names=schema.names)
                    begin, weight, found = k + 1, 0, []

    return files.mapInArrow(run, schema)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """files with their content, read on the executors in batches of bounded size."""
    return _mapped(files, "content", T.BinaryType(), pa.binary(), lambda p: content_of(root, p), len)


def with_hash(files: DataFrame, root: str, new=hashlib.md5) -> DataFrame:
    """files with blob_hash, read on the executors bit by bit; contents aren't kept. new: as hashlib.md5 or xxhash.xxh3_128."""
    return _mapped(files, "blob_hash", T.StringType(), pa.string(), lambda p: hash_of(root, p, new), lambda _: 0)


def scanned_in_order(spark: SparkSession, root: str, *, ignore: str | None = None, include_deps: bool = False) -> DataFrame:
    """The files by path."""
    return read_workspace(spark, root, ignore=ignore, include_deps=include_deps).orderBy("relative_path")
