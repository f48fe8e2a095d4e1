"""Control charts on a stream: CUSUM with running statistics of each strategy or symbol, from keyed state with timers.

The session needs the RocksDB state store:
spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROWS = "ts timestamp, value double"
OUT = "ts timestamp, value double, upper double, lower double, change double, n long, wins long, losses long, mean double, deviation double"


class Cusum(StatefulProcessor):
    """State of a key: rows that the watermark has not passed, and numbers of those it has: mean and deviation of the first
    `window`, both sums, count, wins, losses, running mean and squares. A row is counted once the watermark has
    passed it, so that rows are taken in the order of time whatever batch brings them. A key without rows
    for `idle_ms` of event time is closed and its state removed; a series that is shorter than the window ends at 0."""

    def __init__(self, key: str, slack: float, threshold: float, window: int, idle_ms: int):
        self.key, self.slack, self.threshold, self.window, self.idle = key, slack, threshold, window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROWS)
        self.sums = handle.getValueState("sums", "mean double, sd double, up double, down double, n long, wins long, losses long, running double, squares double, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = self.sums.get()[9] if self.sums.exists() else None
        latest = None
        for frame in rows:
            new = [(t.to_pydatetime(), float(v)) for t, v in zip(frame["ts"], frame["value"]) if past is None or _ms(t) > past]
            if new:
                self.waiting.appendList(new)
                latest = max(latest or 0, *(_ms(t) for t, _ in new))
        if latest is not None:
            self.handle.registerTimer(latest)
            self.handle.registerTimer(latest + self.idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        ripe = [r for r in waiting if _ms(r[0]) <= now]
        state = self.sums.get() if self.sums.exists() else None
        last = _ms(ripe[-1][0]) if ripe else state[9] if state else None
        ends = last is not None and len(ripe) == len(waiting) and last + self.idle <= now
        if state is None and len(ripe) < self.window and not ends:
            return  # the first `window` values tell mean and deviation
        mean, sd, up, down, n, wins, losses, running, squares, _ = state or self._start([v for _, v in ripe])
        out = []
        for t, v in ripe:
            change = 0.0
            if n and sd:
                z = (v - mean) / sd
                up, down = max(up + z - self.slack, 0.0), max(down - z - self.slack, 0.0)
                change = 1.0 if up > self.threshold else -1.0 if down > self.threshold else 0.0
                up, down = 0.0 if up > self.threshold else up, 0.0 if down > self.threshold else down
            n, wins, losses = n + 1, wins + (v > 0), losses + (v < 0)
            step = v - running
            running += step / n
            squares += step * (v - running)
            out.append((*key, t, v, up, down, change, n, wins, losses, running, (squares / (n - 1)) ** 0.5 if n > 1 else None))
        if ends:
            self.waiting.clear()
            self.sums.clear()
        elif ripe:
            self.waiting.clear()
            if len(ripe) < len(waiting):
                self.waiting.put(waiting[len(ripe) :])
            self.sums.update((mean, sd, up, down, n, wins, losses, running, squares, last))
        if out:
            yield pd.DataFrame(out, columns=[self.key, *(c.split()[0] for c in OUT.split(", "))])

    def _start(self, values: list[float]):
        """Mean and deviation of the first values; a deviation of 0 stands for a series that is too short."""
        first = values[: self.window]
        if len(first) < self.window:
            return 0.0, 0.0, 0.0, 0.0, 0, 0, 0, 0.0, 0.0, 0
        mean = sum(first) / len(first)
        sd = (sum((v - mean) ** 2 for v in first) / (len(first) - 1)) ** 0.5
        return mean, max(sd, 0.001), 0.0, 0.0, 0, 0, 0, 0.0, 0.0, 0

    def close(self) -> None:
        pass


def _ms(t) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


def cusum_stream(values: DataFrame, key: str = "symbol", slack: float = 0.5, threshold: float = 4.0, window: int = 20, late: str = "10 minutes", idle_days: float = 90.0) -> DataFrame:
    """W6, C6 a stream (key, ts, value) with both CUSUM sums, changes and running statistics, appended once the watermark has
    passed a row; rows later than that, null times and null values are left out."""
    rows = values.where("ts is not null and value is not null").select(key, "ts", "value").withWatermark("ts", late)
    kind = values.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Cusum(key, slack, threshold, window, int(idle_days * 86_400_000)), f"{key} {kind}, {OUT}", "append", "eventTime")
