"""Streams of counters that only grow: utilisation between two samples of one counter, with the last sample as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "counter string, at double, percent double"
STATE = "at double, value double"


def utilisation_stream(samples: DataFrame) -> DataFrame:
    """(counter, at, percent) for each sample (counter, at in seconds, value in busy seconds) but a counter's first.

    percent is the growth of value over that of time, within 0 to 100, and 0 where time stands still or the counter was
    reset. Samples of one batch are put in order of time; one that is not later than the last is left out, as are rows
    without a number. The state is two numbers a counter.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # plain arrays: a counter has a few rows of a batch, for which the steps of a data frame cost more than the rows
        at, value = np.concatenate([frame[["at", "value"]].to_numpy() for frame in frames]).T
        known = ~(np.isnan(at) | np.isnan(value))
        at, value = at[known], value[known]
        order = np.lexsort((value, at))
        last, times, percents = (state.get if state.exists else None), [], []
        for t, v in zip(at[order].tolist(), value[order].tolist()):
            if last is not None:
                if t <= last[0]:
                    continue
                times.append(t)
                percents.append(min(100.0, max(0.0, (v - last[1]) / (t - last[0]) * 100)))
            last = (t, v)
        if last is not None:
            state.update(last)
        if times:
            yield pd.DataFrame({"counter": [key[0]] * len(times), "at": times, "percent": percents})

    return samples.groupBy("counter").applyInPandasWithState(step, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)
