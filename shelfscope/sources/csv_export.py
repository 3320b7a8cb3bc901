"""Offers as CSV files with a UTF-8 byte-order mark, as a Spark data source.

``df.write.format("csv_bom").mode("overwrite").save(path)`` writes one file a task: mark,
header, then rows with ``;`` between quoted fields.  Tasks write below ``_temporary`` under
a name of their own attempt; the driver moves into place only the files of the attempts
that Spark reports as finished, so a task that ran twice leaves one file.  The folder may be
in any file system that pyarrow opens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MARK = "﻿"
FORMAT = "csv_bom"


@dataclass
class WrittenFile(WriterCommitMessage):
    name: str | None
    rows: int


def csv_line(values, sep: str = ";") -> str:
    """Every field quoted, quotes doubled, null as an empty field."""
    return sep.join('"' + ("" if v is None else str(v)).replace('"', '""') + '"' for v in values) + "\n"


class CsvExportWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], sep: str, overwrite: bool):
        self.path, self.columns, self.sep, self.overwrite, self.job = path, columns, sep, overwrite, uuid.uuid4().hex

    def _open(self):
        from pyarrow import fs
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> WrittenFile:
        """One attempt of one task: a file of its own name, of its rows in order; no file without rows."""
        store, base = self._open()
        first = next(iterator, None)
        if first is None:
            return WrittenFile(None, 0)
        name, rows = f"part-{uuid.uuid4().hex}.csv", 1
        store.create_dir(f"{base}/_temporary/{self.job}", recursive=True)
        with store.open_output_stream(f"{base}/_temporary/{self.job}/{name}") as out:
            out.write((MARK + csv_line(self.columns, self.sep) + csv_line(first, self.sep)).encode())
            for row in iterator:
                out.write(csv_line(row, self.sep).encode())
                rows += 1
        return WrittenFile(name, rows)

    def commit(self, messages: list[WrittenFile | None]) -> None:
        from pyarrow import fs
        store, base = self._open()
        store.create_dir(base, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(base)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for m in messages:
            if m is not None and m.name is not None:
                store.move(f"{base}/_temporary/{self.job}/{m.name}", f"{base}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[WrittenFile | None]) -> None:
        """What is left of this job's attempts goes."""
        from pyarrow import fs
        store, base = self._open()
        if store.get_file_info(f"{base}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_temporary/{self.job}")


class CsvExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> CsvExportWriter:
        return CsvExportWriter(self.options["path"], schema.names, self.options.get("sep", ";"), overwrite)


def write_csv_with_mark(df: DataFrame, path: str, sep: str = ";") -> None:
    """Write ``df`` to the folder ``path``, in place of files that are there."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(CsvExport)
    df.write.format(FORMAT).mode("overwrite").option("sep", sep).save(path)
