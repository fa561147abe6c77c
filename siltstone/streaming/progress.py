"""Streams: progress blocks per job with state, changes worth writing, and micro-batches that drain a source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.progress import MOST, STEP

BLOCKS = "job_id long, elapsed double, fps double, speed double, done boolean"
STATE = "keys array<string>, values array<string>"


def _seconds(values: dict[str, str]) -> float | None:
    for key in ("out_time_us", "out_time_ms"):  # both are microseconds
        try:
            return int(values[key]) / 1e6
        except (KeyError, ValueError):
            pass
    try:
        h, m, s = values["out_time"].split(":")
        h, m, s = int(h), int(m), float(s)
    except (KeyError, ValueError):
        return None
    return h * 3600 + m * 60 + s if min(h, m, s) >= 0 and m < 60 and s < 60 else None


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def block_of(values: dict[str, str]) -> tuple:
    return _seconds(values), _number(values.get("fps")), _number((values.get("speed") or "").strip().removesuffix("x")), values.get("progress") == "end"


def progress_blocks(lines: DataFrame) -> DataFrame:
    """One row per block of key=value lines (job_id, line_no, line), as a stream; a ``progress`` line ends a block.

    A job's open block is its state between batches. Lines of one job within a batch are put in order by line_no.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = dict(zip(*state.get)) if state.exists else {}
        rows = []
        for line in pd.concat(list(frames)).sort_values("line_no", kind="stable")["line"]:
            name, found, value = (line or "").partition("=")
            if found:
                values[name.strip()] = value.strip()
                if name.strip() == "progress":
                    rows.append((key[0], *block_of(values)))
                    values = {}
        state.update((list(values), list(values.values())))
        yield pd.DataFrame(rows, columns=["job_id", "elapsed", "fps", "speed", "done"])

    return lines.groupBy("job_id").applyInPandasWithState(step, BLOCKS, STATE, "append", GroupStateTimeout.NoTimeout)


class Progress(StatefulProcessor):
    """Progress of each job: the open block's values, the greatest share so far and the last one that was written down.

    State of a job goes when a block says that it is done, so a drained stream of finished jobs leaves none.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.block = handle.getMapState("block", "name string", "value string")
        self.shown = handle.getValueState("shown", "progress double, kept double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        values = {name[0]: value[0] for name, value in self.block.iterator()}
        shown, kept = self.shown.get() or (0.0, None)
        for row in sorted(rows, key=lambda r: r.line_no):
            name, found, value = (row.line or "").partition("=")
            if not found:
                continue
            values[name.strip()] = value.strip()
            if name.strip() != "progress":
                continue
            elapsed, fps, speed, done = block_of(values)
            values = {}
            if elapsed is not None and (row.duration or 0) > 0:
                shown = max(shown, min(max(elapsed / row.duration, 0.0), MOST))
                keep = shown > 0 if kept is None else shown >= kept + STEP
                kept = shown if keep else kept
                remaining = (row.duration - shown * row.duration) / speed if speed is not None and speed > 0 else None
                yield Row(job_id=key[0], line_no=row.line_no, progress=shown, fps=fps, speed=speed, remaining=remaining, kept=keep)
            if done:
                shown, kept = 0.0, None
        self.block.clear()
        for name, value in values.items():
            self.block.updateValue((name,), (value,))
        if shown or kept is not None:
            self.shown.update((shown, kept))
        else:
            self.shown.clear()

    def close(self) -> None:
        pass


def live_progress(lines: DataFrame) -> DataFrame:
    """``operators.progress.live`` of a stream of lines (job_id, line_no, line, duration), as they come.

    A job's lines of one batch are put in order; those of later batches have to follow them. Needs the RocksDB state store,
    which ``drain`` sets for it.
    """
    shape = "job_id long, line_no long, progress double, fps double, speed double, remaining double, kept boolean"
    return lines.groupBy("job_id").transformWithState(Progress(), shape, "Append", "None")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Everything that is there now, batch by batch; a batch that is repeated after a failure has the same number."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return query


def into(folder: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: a batch that is repeated after a failure replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
