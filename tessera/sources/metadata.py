"""A metadata table that is replaced as a whole: readers see one snapshot, writers commit or fail.

Files of a write are Parquet parts under names of their own; nothing refers to them until the driver commits by
creating the next manifest, ``manifests/<number>.json``, which lists all parts of the new snapshot. A
manifest is created only if there is none of its number, so of two writers that began from one snapshot
the later is refused, its parts are deleted, and it may read again and retry. A failed task or write
leaves the table as it was. The folder must be one that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.errors import EngineError
from tessera.sources.files import merge_metadata

NAME = "tessera_metadata"


def _local(path: str) -> str:
    return path.removeprefix("file://")


def latest(path: str) -> int:
    """Number of the newest committed snapshot, 0 if there is none."""
    folder = os.path.join(_local(path), "manifests")
    return max((int(f.split(".")[0]) for f in os.listdir(folder) if f.endswith(".json")), default=0) if os.path.isdir(folder) else 0


def manifest(path: str, number: int) -> dict:
    with open(os.path.join(_local(path), "manifests", f"{number:010d}.json"), encoding="utf-8") as f:
        return json.load(f)


@dataclass
class Part(InputPartition):
    file: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class MetadataSource(DataSource):
    """Options: path; snapshot, the number to read; base, the number that a write replaces."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _number(self, option: str) -> int:
        return int(self.options.get(option) or latest(self.options["path"]))

    def schema(self) -> T.StructType:
        if not self._number("snapshot"):
            raise EngineError("metadata_empty", f"nothing was committed to {self.options['path']}")
        return T.StructType.fromJson(manifest(self.options["path"], self._number("snapshot"))["schema"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MetadataReader(self.options["path"], self._number("snapshot"), schema.fieldNames())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return MetadataWriter(self.options["path"], self._number("base"), schema)


class MetadataReader(DataSourceReader):
    def __init__(self, path: str, number: int, columns: list[str]) -> None:
        self.path, self.number, self.columns = path, number, columns

    def partitions(self) -> list[Part]:
        return [Part(f) for f in manifest(self.path, self.number)["files"]]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of a snapshot without rows
            return
        with pq.ParquetFile(os.path.join(_local(self.path), "parts", partition.file)) as f:
            yield from f.iter_batches(columns=self.columns)


class MetadataWriter(DataSourceArrowWriter):
    def __init__(self, path: str, base: int, schema: T.StructType) -> None:
        self.path, self.base, self.wanted = path, base, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, name, rows, out = os.path.join(_local(self.path), "parts"), f"{uuid.uuid4().hex}.parquet", 0, None
        os.makedirs(folder, exist_ok=True)
        try:
            for batch in iterator:
                out = out or pq.ParquetWriter(os.path.join(folder, name), batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out:
                out.close()
        return Written([name] if out else [], rows)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        folder = os.path.join(_local(self.path), "manifests")
        os.makedirs(folder, exist_ok=True)
        text = json.dumps({"files": [f for m in done for f in m.files], "rows": sum(m.rows for m in done), "schema": self.wanted.jsonValue()})
        draft, target = os.path.join(folder, f"{uuid.uuid4().hex}.draft"), os.path.join(folder, f"{self.base + 1:010d}.json")
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, target)  # whole at once, and only if there is none
        except FileExistsError as e:
            self._delete(done)
            raise EngineError("metadata_conflict", f"another write has replaced snapshot {self.base}") from e
        finally:
            os.unlink(draft)

    def abort(self, messages: list[Written | None]) -> None:
        self._delete([m for m in messages if m is not None])

    def _delete(self, messages: list[Written]) -> None:
        for name in (f for m in messages for f in m.files):
            file = os.path.join(_local(self.path), "parts", name)
            if os.path.exists(file):
                os.unlink(file)


def read_metadata(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    """The rows of a snapshot, which stay what they are whatever is written meanwhile."""
    spark.dataSource.register(MetadataSource)
    return spark.read.format(NAME).option("snapshot", snapshot or latest(path)).load(path)


def write_metadata(rows: DataFrame, path: str, base: int) -> None:
    """The rows as the snapshot that follows ``base``; refused if there is one already."""
    rows.sparkSession.dataSource.register(MetadataSource)
    rows.write.format(NAME).option("base", base).mode("append").save(path)


def merge_into(incoming: DataFrame, path: str, key: str, version: str, base: int | None = None) -> int:
    """Merges rows into the table and gives the number of the new snapshot: of each key the row with the
    largest version stays. The merge is one commit; ``base``: the snapshot it starts from."""
    base = latest(path) if base is None else base
    write_metadata(merge_metadata(read_metadata(incoming.sparkSession, path, base), incoming, key, version) if base else incoming, path, base)
    return base + 1
