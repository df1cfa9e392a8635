"""Cooldown per device over a stream of anomaly scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meshlight.values import AGENT_COOLDOWN_HOURS, AGENT_THRESHOLD

OUTPUT = "device_id string, ts timestamp, anomaly_score double"


class Cooldown(StatefulProcessor):
    """One number per device: when its last run started. A timer drops it once the pause has passed.

    A batch's scores come frame by frame. Those inside the pause of the last known run are passed over at
    once; of the others time and score are kept, 16 bytes each, until the batch's order is known.
    """

    def __init__(self, pause_us: int):
        self.pause = pause_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_run_us", "us bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        times, scores = [], []
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            due = np.ones(len(at), bool) if last is None else at >= last + self.pause
            times.append(at[due])
            scores.append(part["anomaly_score"].to_numpy(dtype=np.float64)[due])
        at, score = np.concatenate(times), np.concatenate(scores)
        order = np.lexsort((-score, at))  # of scores at one time the highest starts the run
        at, score = at[order], score[order]
        starts, place = [], 0
        while place < len(at):
            starts.append(place)
            last = int(at[place])
            place = int(np.searchsorted(at, last + self.pause))
        if starts:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max((last + self.pause) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({
            "device_id": [key[0]] * len(starts), "ts": pd.to_datetime(at[starts], unit="us"), "anomaly_score": score[starts],
        })

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"device_id": pd.Series([], dtype=str), "ts": pd.to_datetime([]), "anomaly_score": np.zeros(0)})

    def close(self) -> None:
        pass


def triggered_runs(
    scores: DataFrame,
    threshold: float = AGENT_THRESHOLD,
    cooldown_hours: int = AGENT_COOLDOWN_HOURS,
    lateness: str = "1 hour",
) -> DataFrame:
    """Scores (device_id, ts, anomaly_score) that start an agent run: over the threshold and not
    within the cooldown of the device's previous run. State is kept in RocksDB (``session.RUNTIME_CONF``), which
    holds more devices than fit into memory, and is dropped once the cooldown has passed in event time."""
    # Only scores over the threshold reach Python; the filter is pushed to the source.
    over = scores.where(F.col("anomaly_score") >= threshold).withWatermark("ts", lateness)
    return over.groupBy("device_id").transformWithStateInPandas(
        statefulProcessor=Cooldown(cooldown_hours * 3_600_000_000), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime"
    )
