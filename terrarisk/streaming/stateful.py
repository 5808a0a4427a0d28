"""Operators with state of their own."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from terrarisk.operators import stats as A


class Earliest(StatefulProcessor):
    """Keeps the least row of each key by `order` and gives it whenever it changes; forgets a key that has had no lesser
    row for `keep_ms` of event time."""

    def __init__(self, schema: StructType, order: list[str], time: str, keep_ms: int) -> None:
        self.schema, self.order, self.time, self.keep_ms = schema, order, time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.schema)

    def _place(self, row) -> tuple:
        return tuple((row[self.schema.fieldNames().index(c)] is not None, row[self.schema.fieldNames().index(c)]) for c in self.order)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        least = None
        for r in rows:
            r = tuple(r[c] for c in self.schema.fieldNames())
            if least is None or self._place(r) < self._place(least):
                least = r
        if self.best.exists() and self._place(self.best.get()) <= self._place(least):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.best.update(least)
        seen = least[self.schema.fieldNames().index(self.time)]
        at = int(seen.timestamp() * 1000) if seen is not None else 0
        self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
        yield Row(**dict(zip(self.schema.fieldNames(), least)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.best.clear()
        return iter([])

    def close(self) -> None:
        pass


def earliest_addresses(stream: DataFrame, order: list[str], late: str, keep_ms: int = 3_650 * 86_400_000) -> DataFrame:
    """The first address per key by `order`, whatever order files arrive in; for update mode.

    A key's row is given when it is first seen and again when a lesser one arrives, so the last row given is the first in
    order. Nulls come first. Rows later than the watermark's span are dropped, and a key is forgotten keep_ms after its row.
    """
    keyed = A.normalize_address(stream).withColumn("key", F.concat_ws("|", F.lower("address"), F.lower("city"))).withWatermark("seen_at", late)
    processor = Earliest(keyed.schema, order, "seen_at", keep_ms)
    return keyed.groupBy("key").transformWithState(statefulProcessor=processor, outputStructType=keyed.schema, outputMode="Update", timeMode="EventTime")
