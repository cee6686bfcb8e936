"""One firing per key and burst: a stateful operator with a timer and an expiring lock for each key (an organisation, say)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """The first event of a key takes its lock and sets a timer; later ones only count until it fires. The lock goes by itself after `hold` seconds, or with the firing, whichever comes later.

    State lives in the checkpoint: a restart neither loses a pending firing nor fires twice.
    """

    def __init__(self, delay: float, hold: float):
        self.delay, self.hold = int(delay * 1000), int(hold * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lock = handle.getValueState("lock", "taken long", ttlDurationMs=max(self.hold, 1))
        self.waiting = handle.getValueState("waiting", "events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(r) for r in rows)
        if self.waiting.exists():
            self.waiting.update((self.waiting.get()[0] + n,))
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        # within the lock's time after a firing, the next one waits for the lock's end
        taken = self.lock.get()[0] if self.lock.exists() else None
        self.handle.registerTimer(now + self.delay if taken is None else max(taken + self.hold, now + self.delay))
        if taken is None:
            self.lock.update((now,))
        self.waiting.update((n,))
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.waiting.get()[0] if self.waiting.exists() else 0
        self.waiting.clear()
        if not self.lock.exists():
            self.lock.update((timerValues.getCurrentProcessingTimeInMs(),))
        yield pd.DataFrame({"key": [key[0]], "events": [n]})

    def close(self) -> None:
        pass


def debounced(events: DataFrame, key: str, delay: float = 45, hold: float = 120) -> DataFrame:
    """key, events: for a stream of events, one row for each key and burst, `delay` seconds after its first event, and at most one each `hold` seconds; events: how many it stands for."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = events.schema[key].dataType.simpleString()
    out = events.groupBy(key).transformWithStateInPandas(Debounce(delay, hold), outputStructType=f"key {kind}, events long", outputMode="Append", timeMode="ProcessingTime")
    return out.withColumnRenamed("key", key)
