"""A topic as a folder, with offsets: a Python data source that streams can read and write.

Each writer (a streaming query) has a log of its own below the topic: entry ``n`` names the
files of its batch ``n``. Tasks write files under new names; only the driver's commit makes
them part of the topic, by renaming the finished entry into place, and a batch that is
committed again after a restart adds nothing. So what a reader has seen never changes, an
offset is the number of entries read from each writer, and a restarted reader goes on where
its checkpoint stands: nothing is lost and nothing is read twice.

Files go through Arrow's file systems, so the folder may be in any store that those know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "key string, value string, timestamp timestamp"


class _Folder:
    """A folder in a store that Arrow knows."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)

    def names(self, folder: str, kind: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True))
        return sorted(x.base_name for x in found if (x.type == fs.FileType.Directory) == (kind == "folder"))

    def there(self, name: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(f"{self.path}/{name}").type != fs.FileType.NotFound

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        """All of it or nothing, under ``name``."""
        folder, _, base = name.rpartition("/")
        self.fs.create_dir(f"{self.path}/{folder}", recursive=True)
        part = f"{self.path}/{folder}/.{base}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        if self.there(name):
            self.fs.delete_file(f"{self.path}/{name}")


def _entry(writer: str, batch: int) -> str:
    return f"log/{writer}/{batch:020d}.json"


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


@dataclass
class _Part(InputPartition):
    name: str


class TopicWriter(DataSourceStreamWriter):
    def __init__(self, uri: str, writer: str, names: list[str]) -> None:
        self._uri, self._writer, self._names = uri, writer, names

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from datetime import datetime, timezone

        import pyarrow as pa
        import pyarrow.parquet as pq

        rows = [row.asDict() for row in iterator]
        if not rows:
            return _Files([])
        now = datetime.now(timezone.utc)
        text = lambda x: None if x is None else str(x)
        table = pa.table({"key": pa.array([text(r.get("key")) for r in rows], pa.string()), "value": pa.array([text(r.get("value")) for r in rows], pa.string()), "timestamp": pa.array([r.get("timestamp") or now for r in rows], pa.timestamp("us", "UTC"))})
        out = pa.BufferOutputStream()
        pq.write_table(table, out)
        name = f"data/{self._writer}/{uuid.uuid4().hex}.parquet"
        _Folder(self._uri).write(name, out.getvalue().to_pybytes())
        return _Files([name])

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        folder = _Folder(self._uri)
        names = [name for x in messages if x is not None for name in x.names]
        if folder.there(_entry(self._writer, batchId)):
            for name in names:
                folder.delete(name)
        else:
            folder.write(_entry(self._writer, batchId), json.dumps(names).encode())

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        folder = _Folder(self._uri)
        for x in messages:
            for name in x.names if x is not None else ():
                folder.delete(name)


def _read(uri: str, partition: InputPartition) -> Iterator:
    import pyarrow as pa
    import pyarrow.parquet as pq

    yield from pq.read_table(pa.BufferReader(_Folder(uri).read(partition.name))).to_batches()


class TopicTable(DataSourceReader):
    """All that is committed when the query is planned."""

    def __init__(self, uri: str) -> None:
        self._uri = uri

    def partitions(self) -> list[InputPartition]:
        stream = TopicReader(self._uri)
        return stream.partitions({}, stream.latestOffset())

    def read(self, partition: InputPartition | None) -> Iterator:
        return _read(self._uri, partition) if partition is not None else iter(())


class TopicReader(DataSourceStreamReader):
    def __init__(self, uri: str) -> None:
        self._uri = uri

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        folder = _Folder(self._uri)
        out = {}
        for writer in folder.names("log", "folder"):
            done = [int(x.removesuffix(".json")) for x in folder.names(f"log/{writer}", "file") if x.endswith(".json") and not x.startswith(".")]
            if done:
                out[writer] = max(done) + 1
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        folder = _Folder(self._uri)
        out = []
        for writer, upto in end.items():
            for batch in range(start.get(writer, 0), upto):
                # A batch without rows may have no entry.
                if folder.there(_entry(writer, batch)):
                    out += [_Part(name) for name in json.loads(folder.read(_entry(writer, batch)))]
        return out

    def read(self, partition: InputPartition) -> Iterator:
        return _read(self._uri, partition)

    def commit(self, end: dict) -> None:
        pass


class TopicSource(DataSource):
    """``format("topic")``, for streams and, to read, as a table, with the options ``path`` and, for writers, ``writer`` (a name of its own for each query)."""

    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TopicTable(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TopicReader(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return TopicWriter(self.options["path"], self.options.get("writer", "default"), schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicSource)
