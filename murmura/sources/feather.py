"""Feather (Arrow file) as a Spark data source: ``spark.read.format("feather")`` and ``df.write.format("feather")``.

The reader opens files on the machine of the task: paths are those of a file system that all machines share. Each file's
record batches are read as they are asked for. The writer gives each task a file."""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _files(path: str) -> list[str]:
    path = _local(path)
    found = sorted(glob.glob(os.path.join(path, "*.feather"))) if os.path.isdir(path) else sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


class FeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self):
        with pa.memory_map(_files(self.options["path"])[0]) as f:
            schema = pa.ipc.open_file(f).schema
        return from_arrow_schema(schema.remove_metadata())

    def reader(self, schema):
        return FeatherReader(self.options["path"], [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool):
        return FeatherWriter(_local(self.options["path"]), overwrite)


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self):
        return [InputPartition(f) for f in _files(self.path)]

    def read(self, partition):
        with pa.memory_map(partition.value) as f:
            source = pa.ipc.open_file(f)
            for i in range(source.num_record_batches):
                yield source.get_batch(i).select(self.columns)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class FeatherWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex[:8]

    def write(self, batches):
        os.makedirs(self.path, exist_ok=True)
        out, name = None, os.path.join(self.path, f".part-{uuid.uuid4().hex}.{self.run}")
        for batch in batches:
            if out is None:
                out = pa.ipc.new_file(name, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
            out.write_batch(batch)
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages):
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "*.feather")):
                os.remove(old)
        for i, m in enumerate(x for x in messages if x and x.file):
            os.rename(m.file, os.path.join(self.path, f"part-{i:05d}-{self.run}.feather"))

    def abort(self, messages):
        for m in messages:
            if m and m.file and os.path.exists(m.file):
                os.remove(m.file)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatherSource)
