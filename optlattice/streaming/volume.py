"""Rolling volume of open positions as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State of a position: its bars that a later window can still reach.
_STATE = "at long, volume long"
_MICROS = 1_000


class RollingVolume(StatefulProcessor):
    """Sums of min_leg_volume over (t - minutes, t] for each bar t of a position.

    A bar waits for a timer at its own time, which fires once the watermark has passed it, so bars that come late within
    the delay count in every window that they belong to. Bars that no later window reaches are dropped from the state.
    """

    def __init__(self, minutes: int):
        self.span = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getListState("bars", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            at = part["ts_event"].astype("datetime64[us]").astype("int64")
            self.bars.appendList(list(zip(map(int, at), map(int, part["min_leg_volume"].fillna(0)), strict=True)))
            for t in sorted(set(at)):
                self.handle.registerTimer(-(-int(t) // _MICROS))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * _MICROS
        bars = [(int(at), int(v)) for at, v in self.bars.get()]
        due = sorted(at for at, _ in bars if now - _MICROS < at <= now)
        stay = [(at, v) for at, v in bars if at > now - self.span]
        self.bars.put(stay) if stay else self.bars.clear()
        if due:
            sums = [sum(v for at, v in bars if t - self.span < at <= t) for t in due]
            yield pd.DataFrame({"entry_id": [key[0]] * len(due), "ts_event": pd.to_datetime(due, unit="us"), "volume": sums})

    def close(self) -> None:
        pass


def rolling_volume(marks: DataFrame, minutes: int, delay: str = "1 hour") -> DataFrame:
    """(entry_id, ts_event, volume) of a stream of marks (entry_id, ts_event, min_leg_volume): what exit.rolling_volume() gives of the whole table.

    A bar's sum comes once the watermark has passed it; later bars than the delay are left out. One row a position and time is
    taken as it comes; a null volume counts as 0. Needs the RocksDB state store.
    """
    rows = marks.withWatermark("ts_event", delay).select("entry_id", "ts_event", "min_leg_volume")
    return rows.groupBy("entry_id").transformWithStateInPandas(RollingVolume(minutes), "entry_id long, ts_event timestamp, volume long", "append", "EventTime")
