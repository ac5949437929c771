"""Rules over many keys at once: the state of a bucket of keys, and its rows of a micro-batch, as arrays.

``state`` calls Python once per key, which asks the state store several times; where a micro-batch brings one or two rows
for each of very many keys, that is nearly all of the time. Here a call takes all keys of a bucket. Their state is one value of
the store, an Arrow table, and their rows are sorted and compared as arrays. The rules are those of ``state``.

A bucket is read and written as a whole when one of its keys has a row, so ``buckets`` should grow with the number of keys. It is
fixed by the first run of a checkpoint. Integers and times travel as whole numbers beside a mask of nulls, so both are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 1024
_DAY = 86_400_000_000  # microseconds
NULLS = "nulls"  # of a row, as bits by column


def _numbered(schema: T.StructType) -> list[tuple[str, T.DataType, Column]]:
    """Name, type and the bit that tells a null in the column NULLS."""
    return [(f.name, f.dataType, F.lit(1 << i).cast("long")) for i, f in enumerate(schema)]


def _sent(schema: T.StructType) -> list[Column]:
    """The columns as Python gets them: no nulls but in strings."""
    out, nulls = [], F.lit(0).cast("long")
    for name, kind, bit in _numbered(schema):
        c = F.col(name)
        if isinstance(kind, T.StringType):
            out.append(c)
            continue
        if isinstance(kind, T.TimestampNTZType):
            second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
            value = F.unix_date(F.to_date(c)).cast("long") * _DAY + (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000 + second
        elif isinstance(kind, T.IntegralType):
            value = c.cast("long")
        else:
            raise TypeError(f"{name}: only integers, strings and zone-less times")
        out.append(F.coalesce(value, F.lit(0)).alias(name))
        nulls = nulls + F.when(c.isNull(), bit).otherwise(F.lit(0).cast("long"))
    return [*out, nulls.alias(NULLS)]


def _received(schema: T.StructType) -> list[Column]:
    """The columns of ``_sent`` as they were."""
    out = []
    for name, kind, bit in _numbered(schema):
        c = F.col(name)
        if isinstance(kind, T.TimestampNTZType):
            rest = F.pmod(c, F.lit(_DAY))
            days = F.call_function("div", c - rest, F.lit(_DAY)).cast("int")
            second = (rest.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)")
            c = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days, F.lit(0), F.lit(0), second)
        if not isinstance(kind, T.StringType):
            c = F.when(F.col(NULLS).bitwiseAND(bit) == 0, c.cast(kind))
        out.append(c.alias(name))
    return out


def _wire(schema: T.StructType) -> T.StructType:
    out = T.StructType()
    for name, kind, _bit in _numbered(schema):
        out.add(name, T.StringType() if isinstance(kind, T.StringType) else T.LongType())
    return out.add(NULLS, T.LongType())


class Bulk(StatefulProcessor):
    """Rows of a bucket by key and order, beside what the state holds of each key (``fields``: Arrow types by name)."""

    fields: dict[str, pa.DataType] = {}

    def __init__(self, key: str, order: Sequence[str]):
        self.key, self.order, self.columns = key, list(order), []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("bucket", "keys binary, leaves long")

    def load(self) -> tuple[np.ndarray, dict[str, np.ndarray], int | None]:
        kept = self.held.get()
        if kept is None:
            return np.empty(0, np.int64), {n: np.empty(0, t.to_pandas_dtype()) for n, t in self.fields.items()}, None
        with pa.ipc.open_stream(bytes(kept[0])) as source:
            table = source.read_all()
        return (
            table["key"].to_numpy(), {n: table[n].to_numpy(zero_copy_only=False) for n in self.fields}, kept[1],
        )

    def save(self, keys: np.ndarray, values: dict[str, np.ndarray], leaves: int | None) -> None:
        if not len(keys):
            self.held.clear()
            return
        table = pa.table({"key": pa.array(keys, pa.int64()), **{n: pa.array(values[n], t, from_pandas=True) for n, t in self.fields.items()}})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(), leaves))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        old_keys, old, leaves = self.load()
        keys, place = np.unique(np.concatenate([old_keys, frame[self.key].to_numpy(np.int64)]), return_inverse=True)
        held, code = place[:len(old_keys)], place[len(old_keys):]
        # By key, then in order, nulls first; the sort leaves what is alike as it arrived.
        nulls = frame[NULLS].to_numpy(np.int64)
        by = [part for c in reversed(self.order) for part in (frame[c].to_numpy(), nulls & (1 << self.columns.index(c)) == 0)]
        at = np.lexsort((*by, code))
        frame, code = frame.iloc[at], code[at]
        first = np.append(True, code[1:] != code[:-1])
        start = {}
        for name, kind in self.fields.items():
            start[name] = np.zeros(len(keys), kind.to_pandas_dtype())
            if start[name].dtype == object:
                start[name][:] = None
            start[name][held] = old[name]
        yield from self.step(frame, keys, code, first, start, leaves, timerValues)

    def step(self, frame, keys, code, first, start, leaves, timerValues) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _running(values: np.ndarray, first: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of each key's ``values`` up to every row, on top of ``start``; ``first`` marks a key's first row."""
    run = np.cumsum(values)
    before = np.append(0, run[np.flatnonzero(first)[1:] - 1])
    return run - before[np.cumsum(first) - 1] + start


class BulkSum(Bulk):
    """Each row with the running sum of ``step`` of its key as ``name``; a sum of 0 is not kept."""

    fields = {"total": pa.int64()}

    def __init__(self, key: str, name: str, order: Sequence[str]):
        super().__init__(key, order)
        self.name = name

    def step(self, frame, keys, code, first, start, leaves, timerValues) -> Iterator[pd.DataFrame]:
        total, ends = start["total"], np.append(first[1:], True)
        sums = _running(frame["step"].to_numpy(np.int64), first, total[code])
        total[code[ends]] = sums[ends]
        self.save(keys[total != 0], {"total": total[total != 0]}, None)
        yield frame.assign(**{self.name: sums})


class BulkTotals(Bulk):
    """As ``state.RunningTotals``: each row with running sums of its key, ``total`` of ``value`` (null: 0) and ``n`` of rows."""

    fields = {"total": pa.int64(), "n": pa.int64()}

    def __init__(self, key: str, value: str, order: Sequence[str]):
        super().__init__(key, order)
        self.value = value

    def step(self, frame, keys, code, first, start, leaves, timerValues) -> Iterator[pd.DataFrame]:
        ends, sums = np.append(first[1:], True), {}
        for name, added in (("total", frame[self.value].to_numpy(np.int64)), ("n", np.ones(len(frame), np.int64))):
            sums[name] = _running(added, first, start[name][code])
            start[name][code[ends]] = sums[name][ends]
        self.save(keys, start, None)
        yield frame.assign(**sums)


class BulkSteps(Bulk):
    """As ``state.StatusSteps``: rows whose key had another status before, with it as ``previous_status``; all rows if ``keep_all``.

    One timer a bucket, at the first time that a finished key of it is to leave.
    """

    fields = {"status": pa.string(), "leaves": pa.int64()}

    def __init__(self, key: str, order: Sequence[str], done: Sequence[str], retire_ms: int, keep_all: bool = False):
        super().__init__(key, order)
        self.done, self.retire_ms, self.keep_all = list(done), retire_ms, keep_all

    def _keep(self, keys: np.ndarray, status: np.ndarray, leaves: np.ndarray, timer: int | None) -> None:
        due = leaves[leaves > 0]
        soonest = int(due.min()) if len(due) else None
        if timer is not None and timer != soonest:
            self.handle.deleteTimer(timer)
        if soonest is not None and timer != soonest:
            self.handle.registerTimer(soonest)
        self.save(keys, {"status": status, "leaves": leaves}, soonest)

    def step(self, frame, keys, code, first, start, leaves, timerValues) -> Iterator[pd.DataFrame]:
        status = frame["status"].to_numpy(object)
        status = np.where(pd.isna(status), None, status)
        before = np.append(np.array([None], object), status[:-1])
        before[first] = start["status"][code[first]]
        changed = np.full(len(frame), True)
        if not self.keep_all:
            changed = ~pd.isna(before) & ~pd.isna(status) & (before != status)
        ends = np.append(first[1:], True)
        start["status"][code[ends]] = status[ends]
        over = timerValues.getCurrentProcessingTimeInMs() + self.retire_ms
        start["leaves"][code[ends]] = np.where(np.isin(status[ends].astype(str), self.done), over, 0)
        self._keep(keys, start["status"], start["leaves"], leaves)
        yield frame.assign(previous_status=before)[changed]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys, old, timer = self.load()
        stay = (old["leaves"] == 0) | (old["leaves"] > expiredTimerInfo.getExpiryTimeInMs())
        due = old["leaves"][stay & (old["leaves"] > 0)]
        soonest = int(due.min()) if len(due) else None
        if soonest is not None:
            self.handle.registerTimer(soonest)
        self.save(keys[stay], {n: v[stay] for n, v in old.items()}, soonest)
        yield from ()


def in_bulk(stream: DataFrame, processor: Bulk, added: str, timers: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``processor`` over the stream, one call per bucket of keys and micro-batch; it adds the columns ``added``.

    Rows without a key have a bucket of their own.
    """
    before = stream.schema
    processor.columns = before.names
    after = T.StructType(before.fields + T._parse_datatype_string(added).fields)
    bucket = F.when(F.col(processor.key).isNull(), -1).otherwise(F.pmod(F.xxhash64(processor.key), F.lit(buckets))).cast("int")
    done = stream.select(bucket.alias("bucket"), *_sent(before)).groupBy("bucket").transformWithStateInPandas(
        processor, _wire(after), outputMode="Append", timeMode="ProcessingTime" if timers else "None"
    )
    return done.select(*_received(after))
