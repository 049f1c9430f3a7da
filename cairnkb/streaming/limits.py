"""The limiter and the account lock on streams: rows are taken in the order of their times, and state goes when it no longer matters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import usage
from ..session import ship

#: What the streams of this module need when they are started.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SLOT = 3_600_000
#: Slots whose rows of a key are one value of the state.
SPAN = 168


class InOrder(StatefulProcessor):
    """Feeds a key's rows to ``step`` in the order of time and id, once the watermark has passed them.

    Rows wait by slots of ``slot`` milliseconds and are held SPAN slots to a value; a timer takes
    all slots of its key that are over, a value at a time. ``last`` gives the time in
    microseconds at which the state no longer tells anything, None if never; the state is then
    removed. Rows of a slot that is over are late and left out.
    """

    def __init__(self, start: Callable[[], tuple], step: Callable, last: Callable, schema: str, columns: list[str], slot: int):
        self.start, self.step, self.last, self.schema, self.columns, self.slot = start, step, last, schema, columns, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long", "rows array<struct<at: long, event_id: long, success: boolean>>")
        self.kept = handle.getValueState("kept", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over, known, first = timerValues.getCurrentWatermarkInMs() // self.slot, None, None
        for batch in rows:
            batch = batch[batch["at"] // (1000 * self.slot) >= over]
            if not len(batch):
                continue
            known = {x[0] for x in self.waiting.keys()} if known is None else known
            least = int(batch["at"].min()) // (1000 * self.slot)
            first = least if first is None else min(first, least)
            for span, some in batch.groupby(batch["at"] // (1000 * self.slot * SPAN)):
                new = [(int(a), int(e), bool(s)) for a, e, s in zip(some["at"], some["event_id"], some["success"], strict=True)]
                if span in known:
                    new = [tuple(x) for x in self.waiting.getValue((int(span),))[0]] + new
                known.add(int(span))
                self.waiting.updateValue((int(span),), (new,))
        if first is not None:
            self.handle.registerTimer((first + 1) * self.slot)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs() // self.slot
        now = over * self.slot * 1000
        state = tuple(self.kept.get()) if self.kept.exists() else self.start()
        before, later = state, None
        for span in sorted(x[0] for x in self.waiting.keys()):
            if later is not None or span * SPAN >= over:
                later = span * SPAN if later is None else later
                break
            rows = sorted(tuple(x) for x in self.waiting.getValue((span,))[0])
            made = []
            for row in rows:
                if row[0] >= now:
                    later = row[0] // (1000 * self.slot)
                    break
                state, result = self.step(state, (key[0], row[1], row[0], row[2]))
                made.append(result)
            if len(made) == len(rows):
                self.waiting.removeKey((span,))
            elif made:
                self.waiting.updateValue((span,), (rows[len(made) :],))
            if made:
                yield pd.DataFrame(made, columns=self.columns)
        if later is not None:
            self.handle.registerTimer((later + 1) * self.slot)
        last = self.last(state)
        if state == self.start() or last is not None and last <= now:
            self.kept.clear()
        elif state != before:
            self.kept.update(state)
            if last is not None:
                self.handle.registerTimer(-(-last // (1000 * self.slot)) * self.slot)


def _run(attempts: DataFrame, processor: InOrder, out: str) -> DataFrame:
    ship(attempts.sparkSession)
    return attempts.groupBy("user_id").transformWithStateInPandas(processor, out, "append", "EventTime")


def attempts(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """``(user_id, event_id, at, success)`` of the log-ins among ``stream``'s events, with a watermark on their times."""
    rows = stream.filter(F.col("event_type").isin("signup", "error")).withWatermark("ts", late)
    return rows.select("user_id", "event_id", F.unix_micros("ts").alias("at"), (F.col("event_type") == "signup").alias("success"), "ts")


def rate_limited(attempts: DataFrame, limit: int = 10, window: int = 300_000_000, slot: int = SLOT) -> DataFrame:
    """``usage.rate_limited`` on a stream of ``attempts``; a user's state is gone ``window`` after the last accepted one."""
    start, step = usage.limiter(limit, window)
    columns = "user_id long, event_id long, at long, accepted boolean"
    last = lambda state: state[0][-1] + window if state[0] else None
    return _run(attempts, InOrder(start, step, last, "times array<long>", [x.split()[0] for x in columns.split(", ")], slot), columns)


def account_lock(attempts: DataFrame, threshold: int = 5, locked: int = 900_000_000, slot: int = SLOT) -> DataFrame:
    """``usage.account_lock`` on a stream of ``attempts``; a user's state is gone with the log-in that clears it."""
    start, step = usage.locker(threshold, locked)
    columns = "user_id long, event_id long, at long, outcome string, failures int"
    return _run(attempts, InOrder(start, step, lambda state: None, "failures int, until long", [x.split()[0] for x in columns.split(", ")], slot), columns)
