"""Stateful operators with timers (``transformWithState``): rows wait for the watermark and are then handled in the order
of event time, so files may arrive in any order within the watermark's delay. They need a state store with
variables (:data:`pubtrack.streaming.runtime.ROCKS`)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from pubtrack.operators.budgets import DAY_US, LEDGER_COLUMNS, WriteLedger


class TimedLedger(StatefulProcessor):
    """A write ledger per key. Variables: the ledger's day and sums, one entry per open reservation, and the rows that
    wait for their time. A timer is set to the next waiting row, else to midnight if the day has charges, else to the
    day on which the oldest open reservation is forgotten; a ledger without any of these leaves no state."""

    def __init__(self, limit: int, lease_us: int, overhead: int, keep_days: int, names: list[str]):
        self.rules, self.lease_us, self.names = (limit, overhead, keep_days), lease_us, names

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "day long, charged long, carried long")
        self.open = handle.getMapState("open", "identity long", "day long, reserved long, ends long")
        self.waiting = handle.getListState("waiting", "at long, identity long, reserved long, written long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, identity, at, reserved, written = self.names
        fresh = [(int(a), int(i), None if pd.isna(r) else int(r), None if pd.isna(w) else int(w))
                 for batch in rows for a, i, r, w in zip(batch[at], batch[identity], batch[reserved], batch[written])]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(f[0] for f in fresh) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] < now), key=lambda r: (r[0], r[2] is not None, r[1]))
        later = [r for r in rows if r[0] >= now]
        before = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        book = WriteLedger(*self.rules, *(self.sums.get() if self.sums.exists() else ()), open=dict(before))
        found = []
        for at, identity, reserved, written in due:
            entries = book.settle(identity, at, written) if reserved is None else [book.reserve(identity, at, reserved, self.lease_us)]
            found += [(key[0], identity, *entry) for entry in entries]
        book.turn(now // DAY_US)
        self.store(book, before)
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(min(r[0] for r in later) // 1000 + 1)
        elif book.charged:
            self.handle.registerTimer((book.day + 1) * (DAY_US // 1000) + 1)
        elif book.open:
            self.handle.registerTimer((min(r[2] for r in book.open.values()) // DAY_US + self.rules[2] + 1) * (DAY_US // 1000) + 1)
        else:
            self.sums.clear()
        return iter([pd.DataFrame(found, columns=[*self.names[:2], "outcome", "day", "amount", "used"])] if found else [])

    def store(self, book: WriteLedger, before: dict) -> None:
        """Write the sums and those reservations that changed."""
        self.sums.update((book.day, book.charged, book.carried))
        for identity in before.keys() - book.open.keys():
            self.open.removeKey((identity,))
        for identity in book.open.keys() - before.keys():
            self.open.updateValue((identity,), book.open[identity])

    def close(self) -> None:
        pass


def write_ledger_stream(log: DataFrame, ledger: str, at: str, identity: str, reserved: str, written: str, limit: int, lease_us: int, overhead: int = 8,
                        keep_days: int = 7) -> DataFrame:
    """Decisions of :func:`pubtrack.operators.budgets.write_ledger` over a watermarked log, once the watermark has passed
    a row. Rows behind the watermark are dropped, as in every event-time operator."""
    types = dict(log.dtypes)
    names = [ledger, identity, at, reserved, written]
    timed = next(c for c, t in log.dtypes if t == "timestamp")
    form = f"{ledger} {types[ledger]}, {identity} {types[identity]}, {LEDGER_COLUMNS}"
    rows = log.select(timed, ledger, identity, *[F.col(c).cast("long").alias(c) for c in (at, reserved, written)])
    return rows.groupBy(ledger).transformWithStateInPandas(TimedLedger(limit, lease_us, overhead, keep_days, names), form, "Append", "EventTime")


class FirstCompletions(StatefulProcessor):
    """Requests and completions of a key until the horizon of a request has passed; then its earliest completion, or none,
    is listed. Completions are kept as long as a request can still ask for them, so state is bounded by the horizon."""

    def __init__(self, horizon_us: int, slack_us: int, names: list[str]):
        self.horizon, self.slack, self.names = horizon_us, slack_us, names

    def init(self, handle) -> None:
        self.handle = handle
        self.asked = handle.getListState("asked", "at long, identity long")
        self.done = handle.getListState("done", "at long")

    def wake(self, asked: list, done: list) -> None:
        times = [at + self.horizon for at, _ in asked] + [at + self.slack + self.horizon for at in done]
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, identity, at, request = self.names
        asked, done = [], []
        for batch in rows:
            for moment, number, is_request in zip(batch[at], batch[identity], batch[request]):
                asked.append((int(moment), int(number))) if is_request else done.append(int(moment))
        if asked:
            self.asked.appendList(asked)
        if done:
            self.done.appendList([(at,) for at in done])
        self.wake(asked, done)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        asked = sorted(tuple(r) for r in self.asked.get()) if self.asked.exists() else []
        done = sorted(r[0] for r in self.done.get()) if self.done.exists() else []
        found = []
        for at, identity in [r for r in asked if r[0] + self.horizon < now]:
            place = bisect_left(done, at - self.slack)
            first = done[place] if place < len(done) and done[place] <= at + self.horizon else None
            found.append((key[0], identity, at, first))
        asked, done = [r for r in asked if r[0] + self.horizon >= now], [at for at in done if at + self.slack + self.horizon >= now]
        self.asked.put(asked) if asked else self.asked.clear()
        self.done.put([(at,) for at in done]) if done else self.done.clear()
        self.wake(asked, done)
        return iter([pd.DataFrame(found, columns=[*self.names[:2], "created_us", "completed_us"]).astype({"completed_us": "Int64"})] if found else [])

    def close(self) -> None:
        pass


def first_completion_stream(log: DataFrame, key: str, identity: str, at: str, is_request: str, horizon_us: int, slack_us: int = 1_000_000) -> DataFrame:
    """The earliest completion of every request of a watermarked log (rows with ``is_request`` are requests, the others
    completions), not earlier than ``slack_us`` before it and not later than the horizon; requests without one are listed
    with a null. A request is decided once the watermark has passed its horizon; nothing is paired."""
    types = dict(log.dtypes)
    timed = next(c for c, t in log.dtypes if t == "timestamp")
    rows = log.select(timed, key, identity, at, is_request)
    return rows.groupBy(key).transformWithStateInPandas(FirstCompletions(horizon_us, slack_us, [key, identity, at, is_request]),
                                                        f"{key} {types[key]}, {identity} {types[identity]}, created_us long, completed_us long", "Append", "EventTime")
