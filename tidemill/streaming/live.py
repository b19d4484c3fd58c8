"""Streaming twins: daily returns with a watermark, and the CUSUM sampler with its state kept per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.frames import TS
from tidemill.operators.events import Cusum

EVENTS = "pair string, ts timestamp, direction int"
STATE = "up double, down double, last double"


def daily_returns(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(strategy, day, ret) of closed days of a stream (strategy, t0 timestamp, ret); what is later than ``late`` is dropped."""
    days = stream.withWatermark("t0", late).groupBy("strategy", F.window("t0", "1 day").alias("w"))
    return days.agg(F.sum("ret").alias("ret")).select("strategy", F.to_date("w.start").alias("day"), "ret")


def cusum_events(stream: DataFrame, r: str = "ret_1", sigma: str = "vol_60", k: float = 3.0, spacing_seconds: float = 0.0, floor: float = 0.0) -> DataFrame:
    """(pair, ts, direction) of a stream of bars in time order per pair across batches: the two sums and the time of the
    last event are the state, so a restart goes on where it stopped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Cusum(k, spacing_seconds, [])
        if state.exists:
            machine.up, machine.down, machine.last = state.get
        b = pd.concat(list(batches)).sort_values(TS, kind="stable")
        found = machine.steps([at.timestamp() for at in b[TS]], b["_r"].tolist(), b["_s"].tolist(), [floor] * len(b))
        state.update((machine.up, machine.down, machine.last))
        yield pd.DataFrame([(key[0], b[TS].iloc[i], way) for i, way in found], columns=["pair", "ts", "direction"])

    rows = stream.select("pair", F.col(TS).cast("timestamp").alias(TS), F.col(r).cast("double").alias("_r"), F.col(sigma).cast("double").alias("_s"))
    return rows.groupBy("pair").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
