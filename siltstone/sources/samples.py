"""A streaming source of captured samples of counters, with offsets that can be replayed."""

from __future__ import annotations

import io
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "counter string, at double, value double"


#: Bytes of a file that a task reads.
SPLIT = 16 << 20
ARROW = pa.schema([("counter", pa.string()), ("at", pa.float64()), ("value", pa.float64())])


class Split(InputPartition):
    """The lines of a file that begin from start on and before end."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end

    def lines(self) -> bytes:
        with open(self.path, "rb") as file:
            if self.start:
                file.seek(self.start - 1)
                file.readline()
            at = file.tell()
            if at >= self.end:
                return b""
            found = file.read(self.end - at)
            return found if found.endswith(b"\n") else found + file.readline()


class SampleReader(DataSourceStreamReader):
    """Samples of ticks: below the folder tick=N/ holds files of JSON lines, that do not change once they are there.

    An offset is the number of ticks that are there from 0 on without a gap; a task reads a split of a tick's file. After a
    restart the ticks between two offsets of the checkpoint are read again, from the same files.
    """

    def __init__(self, folder: str):
        self.folder = Path(folder.removeprefix("file://"))

    def initialOffset(self) -> dict:
        return {"ticks": 0}

    def latestOffset(self) -> dict:
        there = {int(p.name.partition("=")[2]) for p in self.folder.glob("tick=*") if any(p.glob("part-*"))}
        return {"ticks": next(n for n in range(len(there) + 1) if n not in there)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        files = [(str(p), p.stat().st_size) for n in range(start["ticks"], end["ticks"]) for p in sorted(self.folder.glob(f"tick={n}/part-*"))]
        return [Split(path, at, min(at + SPLIT, size)) for path, size in files for at in range(0, size, SPLIT)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        lines = partition.lines()
        if lines.strip():
            options = pyarrow.json.ParseOptions(explicit_schema=ARROW, unexpected_field_behavior="ignore")
            yield from pyarrow.json.read_json(io.BytesIO(lines), pyarrow.json.ReadOptions(use_threads=False, block_size=len(lines) + 1), options).to_batches(65_536)

    def commit(self, end: dict) -> None:
        pass


class Samples(DataSource):
    """Registered as ``captured_samples``; option path: a folder that the driver and all executors see."""

    @classmethod
    def name(cls) -> str:
        return "captured_samples"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SampleReader:
        return SampleReader(self.options["path"])


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (counter, at, value)."""
    spark.dataSource.register(Samples)
    return spark.readStream.format("captured_samples").option("path", folder).load()
