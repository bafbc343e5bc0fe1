"""State that does not grow without end: ids seen within a time, and a breaker for a service, both with transformWithState."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Gives out the first row of a key and is silent about others until `ttl_ms` have passed since it; then the key's state is gone."""

    def __init__(self, key: str, at: str, ttl_ms: int):
        self.key, self.at, self.ttl_ms = key, at, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.at)  # one key's rows of one batch
        until = self.until.get()[0] if self.until.exists() else None
        first = []
        for at in frame[self.at]:
            ms = int(pd.Timestamp(at).timestamp() * 1000)
            if until is None or ms >= until:
                until = ms + self.ttl_ms
                first.append(at)
        if first:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.until.update((until,))
            self.handle.registerTimer(until)
            yield pd.DataFrame({self.key: [key[0]] * len(first), "first_at": first})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and self.until.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_within(stream: DataFrame, key: str, at: str, ttl: str = "7 days", late: str = "1 hour") -> DataFrame:
    """key, first_at: a row of a stream (batch or streaming) is given out unless one of its key was within the time before it.

    State is one number for each key of the last `ttl`, kept in RocksDB, so it does not grow with all keys ever seen. Set
    spark.sql.streaming.stateStore.providerClass to ROCKS on the session.
    """
    ship(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = stream.schema[key].dataType.simpleString()
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = stream.select(key, F.col(at).cast("timestamp").alias(at)).withWatermark(at, late)
    return rows.groupBy(key).transformWithStateInPandas(FirstSeen(key, at, ms), f"{key} {kind}, first_at timestamp", "append", "eventTime")


class Breaker:
    """Closed: calls go through. After `most` timeouts it is open: calls go to the other way for `rest` calls. Then half open: calls go
    through on trial, and `enough` that succeed one after another close it, one that times out opens it again.

    Another error takes one from the count of timeouts. The state is a small tuple, so it can be kept anywhere.
    """

    CLOSED, OPEN, HALF = "closed", "open", "half_open"

    def __init__(self, most: int = 15, enough: int = 3, rest: int = 50, state: tuple[str, int, int, int] | None = None):
        self.most, self.enough, self.rest = most, enough, rest
        self.mode, self.timeouts, self.good, self.waited = state or (self.CLOSED, 0, 0, 0)

    @property
    def state(self) -> tuple[str, int, int, int]:
        return self.mode, self.timeouts, self.good, self.waited

    def call(self, ask: Callable, instead: Callable, item):
        """(answer, how): ask's answer, or what is done instead when the breaker is open or ask fails."""
        if self.mode == self.OPEN:
            self.waited += 1
            if self.waited >= self.rest:
                self.mode, self.good = self.HALF, 0
            return instead(item), "open"
        try:
            answer = ask(item)
        except TimeoutError:
            self.timeouts, self.good = self.timeouts + 1, 0
            if self.mode == self.HALF or self.timeouts >= self.most:
                self.mode, self.waited = self.OPEN, 0
            return instead(item), "timeout"
        except Exception:
            self.timeouts, self.good = max(0, self.timeouts - 1), 0
            return instead(item), "error"
        self.good += 1
        if self.good >= self.enough:
            self.mode, self.timeouts, self.good, self.waited = self.CLOSED, 0, 0, 0
        return answer, "asked"


class Guarded(StatefulProcessor):
    """Rows of a key (a service) through its breaker, whose state outlives the batch."""

    def __init__(self, key: str, item: str, order: str, ask: Callable, instead: Callable, limits: tuple[int, int, int]):
        self.key, self.item, self.order, self.ask, self.instead, self.limits = key, item, order, ask, instead, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("breaker", "mode string, timeouts int, good int, waited int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        breaker = Breaker(*self.limits, state=tuple(self.kept.get()) if self.kept.exists() else None)
        for frame in rows:
            frame = frame.sort_values(self.order)
            made = [breaker.call(self.ask, self.instead, x) for x in frame[self.item]]
            yield pd.DataFrame({self.key: [key[0]] * len(frame), self.order: frame[self.order].to_numpy(), "answer": [a for a, _ in made], "how": [h for _, h in made]})
        self.kept.update(breaker.state)

    def close(self) -> None:
        pass


def guarded(stream: DataFrame, key: str, item: str, order: str, ask: Callable, instead: Callable, most: int = 15, enough: int = 3, rest: int = 50) -> DataFrame:
    """key, order, answer, how (asked, timeout, error, open) of each row: ask(item) behind a breaker for each key, instead(item) where it fails or the breaker is open.

    A key's rows are asked one after another, in the order of `order` within what Arrow hands over at once; deal a busy service over several keys, each
    with a breaker of its own.
    """
    ship(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, answer string, how string"
    return stream.select(key, item, order).groupBy(key).transformWithStateInPandas(Guarded(key, item, order, ask, instead, (most, enough, rest)), schema, "append", "None")
