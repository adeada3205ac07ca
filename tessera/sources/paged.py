"""A data source of pages: spark.read.format("pages").load(folder) gives (path, page, text), pages counted from 1.

A file is cut into ranges of bytes, a task each, and a page belongs to the range in which it begins; a task counts the page breaks before its range, so
nothing is planned but the list of files. Filters on path prune files, filters on page end a file's reading early (with
spark.sql.python.filterPushdown.enabled). Files are opened by pyarrow, which knows local, HDFS and object-store addresses; Spark itself is used where a
reader needs whole files (files.read_pages)."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, page int, text string"
BREAK, STEP, PART_BYTES, ROWS = b"\f", 1 << 20, 8 << 20, 1000


class Range(InputPartition):
    """Bytes [start, end) of a file, and the pages that are wanted of it."""

    def __init__(self, path: str, start: int, end: int, least: int, most: int):
        self.path, self.start, self.end, self.least, self.most = path, start, end, least, most


def pages_in(stream, start: int, end: int, most: int) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of the pages that begin in [start, end): at 0, or after a break before end. Reading ends with the last of them."""
    at, page, mine, held = 0, 1, start == 0, []
    while page <= most and (block := stream.read(STEP)):
        first = 0
        while (stop := block.find(BREAK, first)) >= 0:
            if mine:
                yield page, b"".join([*held, block[first:stop]])
            held, page, first = [], page + 1, stop + 1
            if at + stop + 1 >= end or page > most:
                return
            mine = at + stop + 1 >= start
        if mine:
            held.append(block[first:])
        at += len(block)
    if mine and page <= most:
        yield page, b"".join(held)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern, self.part = options["path"], options.get("pathglobfilter", "*"), int(options.get("partbytes", PART_BYTES))
        self.paths: set[str] | None = None
        self.least, self.most = 1, 2**31 - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, value = f.attribute if hasattr(f, "attribute") else (), getattr(f, "value", None)
            if name == ("path",) and isinstance(f, (EqualTo, In)):
                asked = {value} if isinstance(f, EqualTo) else set(value)
                self.paths = asked if self.paths is None else self.paths & asked
            elif name == ("page",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.most = min(self.most, value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, root = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))
        listed = system.get_file_info([root])
        if listed[0].type == fs.FileType.Directory:
            listed = system.get_file_info(fs.FileSelector(root, recursive=True))
        found = [f for f in listed if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern) and (self.paths is None or f.path in self.paths)]
        if self.least > self.most:
            return []
        out = []
        for f in sorted(found, key=lambda f: f.path):
            parts = max(1, -(-f.size // self.part))
            # the last page may begin where the file ends
            out += [Range(f.path, k * self.part, (k + 1) * self.part if k < parts - 1 else f.size + 1, self.least, self.most) for k in range(parts)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root else fs.LocalFileSystem()
        rows: list[tuple[int, str]] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.string())], names=["path", "page", "text"])

        with system.open_input_stream(partition.path) as stream:
            for page, text in pages_in(stream, partition.start, partition.end, partition.most):
                if page >= partition.least:
                    rows.append((page, text.decode("utf-8", "replace")))
                if len(rows) >= ROWS:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format "pages" known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
