"""A data source of Spark that delivers rows as JSON messages, as an outside service would.

``spark.read.format("tessera_feed").load(path)`` reads all messages there are,
``spark.readStream.format("tessera_feed")`` those that come, a bounded number of files
a micro-batch. ``path`` names Parquet files that the workers reach themselves: a folder
or file of a mounted disk or of a store that Arrow knows. The driver reads the files'
footers only. A partition is one row group; the offset of a stream is the number of files
delivered, oldest first, so a stream that is started anew goes on with the next file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, place long, payload string"
#: Messages of one Arrow batch.
BATCH = 1_000


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int
    first: int


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def files_of(uri: str) -> list[str]:
    """Parquet files, oldest first; those that are still being written (``_`` and ``.``) are left out."""
    store, path = _store(uri)
    info = store.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
    named = [f for f in found if f.type == fs.FileType.File and f.extension == "parquet" and not f.base_name.startswith(("_", "."))]
    # Folders that a writer has not committed yet.
    return [f.path for f in sorted(named, key=lambda f: (f.mtime_ns or 0, f.path)) if "/_temporary/" not in f.path]


def row_groups(uri: str, files: Sequence[str]) -> list[RowGroup]:
    store, _ = _store(uri)
    out = []
    for path in files:
        with store.open_input_file(path) as source:
            footer = pq.ParquetFile(source).metadata
        first = 0
        for k in range(footer.num_row_groups):
            out.append(RowGroup(path, k, first))
            first += footer.row_group(k).num_rows
    return out


def messages(uri: str, part: RowGroup) -> Iterator[pa.RecordBatch]:
    store, _ = _store(uri)
    place = part.first
    with store.open_input_file(part.path) as source:
        for batch in pq.ParquetFile(source).iter_batches(BATCH, row_groups=[part.group]):
            told = [json.dumps(row, ensure_ascii=False, default=str) for row in batch.to_pylist()]
            columns = [pa.array([part.path] * len(told), pa.string()), pa.array(range(place, place + len(told)), pa.int64()), pa.array(told, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "place", "payload"])
            place += len(told)


class FeedReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return row_groups(self.path, files_of(self.path))

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return messages(self.path, partition)


class FeedStream(DataSourceStreamReader):
    def __init__(self, path: str, files_per_batch: int) -> None:
        self.path, self.files_per_batch, self.at = path, files_per_batch, 0

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        self.at = min(len(files_of(self.path)), self.at + self.files_per_batch)
        return {"files": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at, end["files"])
        return row_groups(self.path, files_of(self.path)[start["files"] : end["files"]])

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return messages(self.path, partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class Feed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStream(self.options["path"], int(self.options.get("filesPerBatch", "100")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Feed)
