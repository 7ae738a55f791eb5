"""State machines over rows in the order of their times: the same machine over a table and over a stream.

The stream form is a `transformWithState` processor. It holds rows until the watermark has passed them, so that rows that come
late or split over batches are met in their order; what comes later than the watermark allows is dropped by Spark. Timers tell
when a key's rows are due, and when it has rested long enough to be forgotten; state and held rows live in the state store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuelake.functions.fold import fold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Machine:
    """step(state, row) gives the next state and rows to emit; a row is (key, at_ms, seq, ...). A key that has no row for rest_ms
    is forgotten, and `ended(state, key, at_ms)` tells what to emit then. pack and unpack turn a state into a row of `kept`."""

    start: Callable[[], object]
    step: Callable[[object, tuple], tuple[object, list[tuple]]]
    pack: Callable[[object], tuple]
    unpack: Callable[[tuple], object]
    kept: str
    out: str
    rest_ms: int | None = None
    ended: Callable[[object, object, int], list[tuple]] = lambda state, key, at_ms: []

    def met(self, held: tuple[object, int | None], row: tuple) -> tuple[tuple[object, int], list[tuple]]:
        """The state and the time of the last row, after a row, and what is emitted."""
        state, last = held
        rested, out = self.rested(held, row[0], row[1])
        if rested:
            state = self.start()
        state, made = self.step(state, row)
        return (state, row[1]), out + made

    def rested(self, held: tuple[object, int | None], key: object, now_ms: int) -> tuple[bool, list[tuple]]:
        """Whether a key has rested for so long by now, and what is emitted at the end of its rest."""
        state, last = held
        if self.rest_ms is None or last is None or now_ms - last < self.rest_ms:
            return False, []
        return True, self.ended(state, key, last + self.rest_ms)


def over_table(rows: DataFrame, machine: Machine) -> DataFrame:
    """What a machine emits over the rows of a table (key first, then at_ms, seq and others), as if time went on after the last."""

    def finish(held: tuple, key: object) -> list[tuple]:
        return machine.rested(held, key, held[1] + machine.rest_ms)[1] if machine.rest_ms is not None and held[1] is not None else []

    key = rows.columns[0]
    return fold(rows.select(key, "at_ms", "seq", *(c for c in rows.columns if c not in (key, "at_ms", "seq"))), key, ["at_ms", "seq"], lambda: (machine.start(), None), machine.met, finish, machine.out)


class Ordered(StatefulProcessor):
    """Holds a key's rows until they are due and meets them in the order of at_ms and seq."""

    def __init__(self, machine: Machine, shape: T.StructType):
        self.machine, self.names = machine, shape.names
        self.row = T.StructType(shape.fields[1:])
        self.kept = T.StructType.fromDDL(f"{machine.kept}, last_ms long")
        self.out = T.StructType.fromDDL(machine.out).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.state = handle.getValueState("state", self.kept)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[n] for n in self.names[1:]) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Meets all rows up to the watermark, which may be past this timer."""
        now = timerValues.getCurrentWatermarkInMs()
        every = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in every if r[0] <= now), key=lambda r: r[:2])
        if due:
            later = [r for r in every if r[0] > now]
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        was = self.state.get() if self.state.exists() else None
        held = (self.machine.unpack(tuple(was)[:-1]), tuple(was)[-1]) if was else (self.machine.start(), None)
        out: list[tuple] = []
        for r in due:
            held, made = self.machine.met(held, (key[0], *r))
            out += made
        rested, made = self.machine.rested(held, key[0], now)
        out += made
        if rested:
            self.state.clear()
        elif due:
            self.state.update((*self.machine.pack(held[0]), held[1]))
            if self.machine.rest_ms is not None:
                self.handle.registerTimer(held[1] + self.machine.rest_ms)
        return iter([Row(**dict(zip(self.out, r, strict=True))) for r in out])

    def close(self) -> None:
        pass


def over_stream(rows: DataFrame, machine: Machine, late: str) -> DataFrame:
    """What a machine emits over a stream of such rows; a row may come `late` after others. The session keeps its streams' state in
    RocksDB from here on, as transformWithState needs it."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    key = rows.columns[0]
    names = [key, "at_ms", "seq", *(c for c in rows.columns if c not in (key, "at_ms", "seq"))]
    marked = rows.select(*names, F.timestamp_millis("at_ms").alias("_ts")).withWatermark("_ts", late)
    shape = T.StructType([rows.schema[n] for n in names])
    return marked.groupBy(key).transformWithState(Ordered(machine, shape), T.StructType.fromDDL(machine.out), "append", "eventTime")
