"""Streaming extensions: the alpha-beta filter as a stateful operator, and window means of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cleaning import alpha_beta_step

_STATE = "seen long, ahead double, speed double, alpha double, beta double"


def alpha_beta_stream(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """series_id, at, y, y_clean as samples arrive. Within a batch samples are put in order; between batches the order is arrival's."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for y in rows.y:
            now, v = alpha_beta_step(now, float(y))
            out.append(v)
        state.update(now)
        yield pd.DataFrame({"series_id": rows.series_id, "at": rows["at"], "y": rows.y, "y_clean": out})

    rows = stream.select(F.col(key).cast("string").alias("series_id"), F.col(order).cast("timestamp").alias("at"), F.col(value).cast("double").alias("y"))
    return rows.groupBy("series_id").applyInPandasWithState(run, "series_id string, at timestamp, y double, y_clean double", _STATE, "append", GroupStateTimeout.NoTimeout)


def window_means(stream: DataFrame, key: str, time: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """series_id, start, y, n of closed windows. Time columns without zone are taken in the session's."""
    at = stream.select(F.col(key).alias("series_id"), F.col(time).cast("timestamp").alias("at"), F.col(value).alias("y"))
    w = at.withWatermark("at", late).groupBy("series_id", F.window("at", width).alias("w")).agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    return w.select("series_id", F.col("w.start").alias("start"), "y", "n")
