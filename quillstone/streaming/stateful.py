"""The ordered folds of ``folds`` over streams: events wait until the watermark has passed them, and state ends.

Events may come in any order within the watermark's delay. A key's events wait in a list; a timer at the earliest of them
brings the key back once the watermark has passed it, and all that are due go through the fold in order. Another timer
ends the state when it says no more than none would.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from quillstone.session import ship
from quillstone.streaming import folds

_WAITING = StructType([StructField("at", DoubleType()), StructField("tie", LongType()), StructField("ok", BooleanType())])
_STATE = StructType([StructField("a", DoubleType()), StructField("b", DoubleType())])


class OrderedFold(StatefulProcessor):
    """start() gives the state of a key without one, step(state, rows) what ``folds.fold`` takes, and over(state) the time in
    seconds from which a state says nothing (infinity: never). A state is two numbers, either of which may be null."""

    def __init__(self, key: str, start: Callable, step: Callable, names: list[str], over: Callable):
        self.key, self.start, self.step, self.names, self.over = key, start, step, names, over

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.state = handle.getListState("waiting", _WAITING), handle.getValueState("state", _STATE)

    def _wake(self, at: float) -> None:
        when = math.ceil(at * 1000)
        if when not in set(self.handle.listTimers()):
            self.handle.registerTimer(when)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = math.inf
        for frame in rows:
            ok = frame["ok"].tolist() if "ok" in frame else [None] * len(frame)
            self.waiting.appendList(list(zip(frame["at"].tolist(), frame["tie"].tolist(), ok)))
            earliest = min(earliest, float(frame["at"].min()))
        if earliest < math.inf:
            self._wake(earliest)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        rows = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["at", "tie", "ok"])
        due = rows[rows["at"] <= now].sort_values(["at", "tie"])
        state = self._held()
        if len(due):
            state, arrays = self.step(state, due)
            yield pd.DataFrame({self.key: key[0], "tie": due["tie"].to_numpy(), **dict(zip(self.names, arrays))})
        rest = rows[rows["at"] > now]
        if len(rest):
            self.waiting.put([(a, t, None if o is None else bool(o)) for a, t, o in rest.itertuples(index=False)])
            self._wake(float(rest["at"].min()))
        else:
            self.waiting.clear()
        end = self.over(state)
        if end <= now:
            self.state.clear()
            return
        if len(due):
            self.state.update(tuple(None if x is None else float(x) for x in state))
        if end < math.inf:
            self._wake(end)

    def _held(self) -> tuple:
        if not self.state.exists():
            return self.start()
        a, b = self.state.get()
        return self.revive(a, b)

    def revive(self, a, b) -> tuple:
        return a, b

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        a, b = (None if pd.isna(x) else float(x) for x in initialState.loc[0, ["a", "b"]])
        self.state.update((a, b))
        end = self.over(self.revive(a, b))
        if end < math.inf:
            self._wake(end)

    def close(self) -> None:
        pass


class Window(OrderedFold):
    """Counter of a window that is anchored at a first event: it says nothing from the window's end on."""

    def __init__(self, key: str, most: int, window: float):
        start, step, outputs = folds.rate_limit(most, window)
        super().__init__(key, start, step, [f.split()[0] for f in outputs.split(", ")], lambda s: -math.inf if s[0] is None else s[0] + window)

    def revive(self, a, b) -> tuple:
        return a, int(b)


class Breaker(OrderedFold):
    """Circuit breaker: without failures it says nothing once it has closed. Failures are kept until a success or a trip
    takes them back, as they count however old they are."""

    def __init__(self, key: str, threshold: int, open_for: float):
        start, step, outputs = folds.circuit_breaker(threshold, open_for)
        super().__init__(key, start, step, [f.split()[0] for f in outputs.split(", ")], lambda s: math.inf if s[0] else -math.inf if s[1] is None else s[1])

    def revive(self, a, b) -> tuple:
        return int(a or 0), b


def fold_stream(events: DataFrame, key: str, at: str, tie: str, fold: OrderedFold, outputs: str, delay: str, ok: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """What ``folds.fold`` gives for the same events, as a stream: key, tie and the fold's fields, once the watermark has passed.

    ``at`` is the event's timestamp; events that come later than ``delay`` are dropped. initial: key, a and b, the states
    that keys begin with.
    """
    ship(events.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    held = events.where(F.col(key).isNotNull()).withWatermark(at, delay)
    columns = [F.col(key), F.col(at), (F.unix_micros(at) / 1e6).alias("at"), F.col(tie).alias("tie"), *([F.col(ok).alias("ok")] if ok else [])]
    begun = initial.groupBy(key) if initial is not None else None
    out = held.select(*columns).groupBy(key).transformWithStateInPandas(fold, f"{key} {kinds[key]}, tie {kinds[tie]}, {outputs}", "Append", "EventTime", begun)
    return out.withColumnRenamed("tie", tie)


def rate_limited(events: DataFrame, most: int, window: float, delay: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """Whether each event is within its user's limit, the count of its window, what is left and seconds until the next."""
    return fold_stream(events, "user_id", "ts", "event_id", Window("user_id", most, window), folds.rate_limit(most, window)[2], delay, initial=initial)


def circuit_broken(events: DataFrame, threshold: int, open_for: float, ok: str, delay: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """Whether each user's circuit was open when an event came, its failures since, and whether the event tripped it."""
    return fold_stream(events, "user_id", "ts", "event_id", Breaker("user_id", threshold, open_for), folds.circuit_breaker(threshold, open_for)[2], delay, ok, initial)
