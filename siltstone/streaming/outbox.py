"""Push sinks: changes that are sent on to a recipient, each once, however often a batch is repeated.

``outbox`` gives a batch writer for a stream. A change's key is the digest of all its columns. What was acknowledged is a
table in the shared folder; a batch sends the changes that are not in it, some at a time from each task, and writes the
keys that the recipient took. If any were not taken, the batch fails after that, so that the stream repeats it, and then
only what is missing is sent. A task that is lost between sending and writing may send its messages again; they carry
their key, by which a recipient can tell. Rows that repeat each other are one change.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.shared import checkpointed

#: Messages that are handed to the recipient at a time.
AT_ONCE = 500
Send = Callable[[list[dict]], None]


def keyed(changes: DataFrame) -> DataFrame:
    """(key, message) of changes, each once: the digest of a change, and the change as JSON."""
    message = F.to_json(F.struct(*changes.columns), {"ignoreNullFields": "false"})
    return changes.select(message.alias("message")).select(F.sha2("message", 256).alias("key"), "message").distinct()


def acknowledged(spark: SparkSession, folder: str) -> DataFrame:
    """The keys that the recipient took."""
    return spark.read.schema("key string, batch long").option("ignoreMissingFiles", True).parquet(folder)


def sent(messages: DataFrame, send: Send, at_once: int = AT_ONCE) -> DataFrame:
    """(key, error) of messages, which are sent; error is null for what was taken."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once).to_pylist()
                try:
                    send([{"key": row["key"]} | json.loads(row["message"]) for row in part])
                    error = None
                except Exception as failure:  # noqa: BLE001  whatever the recipient does, others are sent
                    error = f"{type(failure).__name__}: {failure}"[:500]
                yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in part], pa.string()), pa.array([error] * len(part), pa.string())], names=["key", "error"])

    return messages.select("key", "message").mapInArrow(step, "key string, error string")


def outbox(folder: str, send: Send, at_once: int = AT_ONCE) -> Callable[[DataFrame, int], None]:
    """A batch writer that sends each change once; folder holds what was acknowledged."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], "key string, batch long").write.mode("append").partitionBy("batch").parquet(folder)
        waiting = keyed(batch).join(acknowledged(spark, folder), "key", "left_anti")
        done = checkpointed(sent(waiting, send, at_once))  # so that nothing is sent twice by reading the outcome twice
        done.where("error is null").select("key", F.lit(number).cast("long").alias("batch")).write.mode("append").partitionBy("batch").parquet(folder)
        failed = done.where("error is not null").agg(F.count("*"), F.first("error")).first()
        if failed[0]:
            raise RuntimeError(f"{failed[0]} changes were not taken: {failed[1]}")

    return write
