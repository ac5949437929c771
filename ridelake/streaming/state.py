"""Rules that need a key's rows in order, on Spark's own keyed state (``transformWithState``).

A processor holds a few numbers per key in the state store, which Spark checkpoints, restores and moves with its partitions.
The rows that a micro-batch brings for a key are put in the order of (time, id) and follow what earlier
micro-batches left; between micro-batches the order of arrival counts, as it does for a row trigger. A key's rows of one
micro-batch meet in one task, so ``maxFilesPerTrigger`` bounds its memory however busy the key is. Most keys bring one or
two rows, so the processors take rows: a pandas frame per key took three times as long.

Keys that are done, such as finished rides, leave the state by a timer some time after their last row. Timers run on
processing time: no row is late for them, and none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def in_order(rows: Iterable[Row], order: Sequence[str]) -> list[Row]:
    """A key's rows of one micro-batch, nulls first."""
    return sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in order])


class RunningTotals(StatefulProcessor):
    """Each row with running sums of its key: ``total`` of ``value`` (null: 0) and ``n`` of rows."""

    def __init__(self, value: str, order: Sequence[str]):
        self.value, self.order = value, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "total long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, n = self.totals.get() or (0, 0)
        for row in in_order(rows, self.order):
            total, n = total + (row[self.value] or 0), n + 1
            yield Row(**row.asDict(), total=total, n=n)
        self.totals.update((total, n))

    def close(self) -> None:
        pass


class StatusSteps(StatefulProcessor):
    """Rows whose key had another status before, with it as ``previous_status``; all rows if ``keep_all``.

    A key whose status is among ``done`` leaves the state ``retire_ms`` after its last row; what comes later starts anew.
    """

    def __init__(self, order: Sequence[str], done: Sequence[str], retire_ms: int, keep_all: bool = False):
        self.order, self.done, self.retire_ms, self.keep_all = order, frozenset(done), retire_ms, keep_all

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, leaves long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, leaves = self.last.get() or (None, None)
        if leaves is not None:
            self.handle.deleteTimer(leaves)
        for row in in_order(rows, self.order):
            before, status = status, row["status"]
            if self.keep_all or (before is not None and status is not None and before != status):
                yield Row(**row.asDict(), previous_status=before)
        leaves = None
        if status in self.done:
            leaves = timerValues.getCurrentProcessingTimeInMs() + self.retire_ms
            self.handle.registerTimer(leaves)
        self.last.update((status, leaves))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, timers: bool = False) -> DataFrame:
    """``processor`` over the stream, one call per key and micro-batch."""
    return stream.groupBy(key).transformWithState(
        processor, schema, outputMode="Append", timeMode="ProcessingTime" if timers else "None"
    )
