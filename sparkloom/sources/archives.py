"""CSV files inside zip archives, one partition for each member."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType, _parse_datatype_string


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Member(InputPartition):
    def __init__(self, archive: str, name: str):
        self.archive, self.name = archive, name


class ZippedCsv(DataSource):
    """Rows of text columns.  Options: ``path`` (an archive or a folder of them), ``delimiter``, ``header``."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> StructType:
        names = next(_Reader(self.options, None).heads(), [])
        out = StructType()
        for n in names:
            out = out.add(n, StringType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType | None):
        self.path, self.width = options["path"], len(schema) if schema is not None else None
        self.header, self.delimiter = str(options.get("header", "true")).lower() == "true", options.get("delimiter", ",")

    def archives(self) -> list[str]:
        fs, path = _opened(self.path)
        base = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            return sorted(base + f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file and f.path.lower().endswith(".zip"))
        return [self.path]

    def partitions(self) -> list[InputPartition]:
        """Only the archives' directories are read here."""
        out = []
        for archive in self.archives():
            fs, path = _opened(archive)
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                out += [_Member(archive, m.filename) for m in z.infolist() if not m.is_dir() and m.filename.lower().endswith((".csv", ".txt", ".tsv"))]
        return out

    def heads(self) -> Iterator[list[str]]:
        for m in self.partitions():
            with_header, self.header = self.header, False
            first = next(self._rows(m), [])
            self.header = with_header
            yield first if with_header else [f"_c{k}" for k in range(len(first))]

    def _rows(self, member: _Member) -> Iterator[list[str]]:
        fs, path = _opened(member.archive)
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z, z.open(member.name) as raw:
            rows = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""), delimiter=self.delimiter)
            if self.header:
                next(rows, None)
            yield from rows

    def read(self, partition: _Member) -> Iterator[tuple]:
        """Rows as they are unpacked; short ones end in nulls, an empty field is null."""
        for row in self._rows(partition):
            if row:
                yield tuple((row[k] or None) if k < len(row) else None for k in range(self.width))


def load_zipped_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, delimiter: str = ",") -> DataFrame:
    """The CSV members of a zip archive, or of all archives of a folder, that executors can reach as a file or by URI.

    Members have the same columns in the same order.  Without a schema all columns are text, named by the first member's header; with one they are
    cast to its types, and what can't be is null.
    """
    spark.dataSource.register(ZippedCsv)
    reader = spark.read.format("zipped_csv").option("header", str(header).lower()).option("delimiter", delimiter)
    if not schema:
        return reader.load(path)
    kinds = _parse_datatype_string(schema)
    text = StructType()
    for f in kinds:
        text = text.add(f.name, StringType())
    return reader.schema(text).load(path).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kinds])
