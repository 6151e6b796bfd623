"""Rotation of a running log, as a stateful stream: a device's entries, flushes and removal close its open segment.

Each device has its open segment as state: entries and bytes so far, and when it began. An entry that brings it to the size
limit closes it; a flush and the device's removal close it if it holds anything; and a timer closes it when it reaches
its age, whether or not another entry comes. Time is that of the entries (a watermark moves it on), so a stream read again
gives the same segments. A row beyond the open segment's age closes that first, as a timer
before it would have done.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.runtime import prepare

#: Bytes and seconds of a segment at most.
SIZE_LIMIT, AGE_LIMIT = 64 << 20, 60
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEGMENTS = "dev_index int, part long, reason string, entries long, bytes long, first_sequence long, last_sequence long, began_ns long"
OPEN = "part long, entries long, bytes long, first_sequence long, last_sequence long, began_ns long"


class Rotation(StatefulProcessor):
    def __init__(self, size_limit: int, seconds: int):
        self.size_limit, self.age_ns = size_limit, seconds * 1_000_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.seen = handle.getValueState("seen", "part long, sequence long")  # parts so far, and the last sequence

    def _deadline(self, began_ns: int) -> int:
        return -(-(began_ns + self.age_ns) // 1_000_000)

    def _closed(self, dev: int, state: tuple, reason: str) -> Row:
        part, entries, size, first, last, began = state
        return Row(dev_index=dev, part=part, reason=reason, entries=entries, bytes=size, first_sequence=first, last_sequence=last, began_ns=began)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        dev, out = key[0], []
        state = self.open.get() if self.open.exists() else None
        state = None if state is None else tuple(state)
        armed = None if state is None else self._deadline(state[5])
        part, seen = tuple(self.seen.get()) if self.seen.exists() else (0, -1)

        def close(reason: str) -> None:
            nonlocal state, part
            if state is not None:
                out.append(self._closed(dev, state, reason))
                state, part = None, part + 1

        for r in sorted(rows, key=lambda r: (r["timestamp_ns"], r["sequence"], r["kind"] != "entry")):  # one device's rows of a batch
            if r["kind"] == "entry" and r["sequence"] <= seen:
                continue  # delivered before
            if state is not None and r["timestamp_ns"] - state[5] >= self.age_ns:
                close("age")
            if r["kind"] == "entry":
                seen = r["sequence"]
                held = state or (part, 0, 0, seen, seen, r["timestamp_ns"])
                state = (held[0], held[1] + 1, held[2] + r["bytes"], held[3], seen, held[5])
                if state[2] >= self.size_limit:
                    close("size")
            else:
                close(r["kind"])
                if r["kind"] == "remove":
                    part, seen = 0, -1  # a device of this index may begin anew
        now = None if state is None else self._deadline(state[5])
        if armed is not None and armed != now:
            self.handle.deleteTimer(armed)
        if now is not None and now != armed:
            self.handle.registerTimer(now)
        if state is None:
            self.open.clear()
        else:
            self.open.update(state)
        self.seen.update((part, seen))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.open.exists():
            return
        state = tuple(self.open.get())
        if self._deadline(state[5]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
            _, seen = self.seen.get()
            self.seen.update((state[0] + 1, seen))
            yield self._closed(key[0], state, "age")

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Let a session keep state with timers, which needs RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def rotate_stream(events: DataFrame, size_limit: int = SIZE_LIMIT, seconds: int = AGE_LIMIT, delay: str = "10 seconds") -> DataFrame:
    """The closed segments of a stream of ``dev_index, kind, sequence, timestamp_ns, bytes``: ``dev_index, part, reason, entries, bytes, first_sequence, last_sequence, began_ns``.

    ``kind`` is ``entry``, ``flush`` or ``remove``, in order of time, then ``sequence``. ``reason`` is
    ``size``, ``age``, ``flush`` or ``remove``. Rows come less than ``delay`` behind the newest of any device (Spark drops later ones). A
    repeated entry counts once. After its removal a device's parts begin at 0 again.
    """
    prepare(events.sparkSession)
    use_state_store(events.sparkSession)
    at = F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("long"))
    timed = events.select(F.col("dev_index").cast("int").alias("dev_index"), "kind", "sequence", "timestamp_ns", "bytes", at.alias("at")).withWatermark("at", delay)
    return timed.groupBy("dev_index").transformWithState(statefulProcessor=Rotation(size_limit, seconds), outputStructType=SEGMENTS, outputMode="Append", timeMode="EventTime")
