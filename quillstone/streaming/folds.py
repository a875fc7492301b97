"""Ordered folds over a key's events: windows anchored at a first event, and circuit breakers.

In batch a key's rows are brought together by a hash and sorted within partitions; the fold reads them as a stream and
holds one key's few numbers at a time, so a key of any size fits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import ship


def fold(events: DataFrame, key: str, at: str, tie: str, start: Callable, step: Callable, outputs: str) -> DataFrame:
    """key, tie and the fields of ``outputs`` for each event: step(state, rows) -> (state, arrays) over runs of a key's rows,
    in order of at and tie. A run is what a batch holds of one key."""
    ship(events.sparkSession)
    names = [f.split()[0] for f in outputs.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            keys = batch[key].to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            parts = []
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if current is None or keys[a] != current:
                    current, state = keys[a], start()
                state, arrays = step(state, batch.iloc[a:z])
                parts.append(arrays)
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [[] for _ in names]
            yield pd.DataFrame({key: batch[key], tie: batch[tie], **dict(zip(names, columns))})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    dealt = events.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, at, tie)
    return dealt.mapInPandas(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, {outputs}")


def limited_key(key: Column) -> Column:
    """A key that a counter may be kept under; any other, and null, fails the job."""
    fits = F.coalesce(key.rlike("^[a-z0-9:_./-]{1,200}$"), F.lit(False))
    return F.when(F.assert_true(fits, F.lit("invalid rate-limit key")).isNull(), key)


def rate_limit(most: int, window: float, restart_at_end: bool = True) -> tuple[Callable, Callable, str]:
    """A counter whose window begins with a first event and begins anew with the first event after its end.

    restart_at_end: an event exactly at the end begins a new window. Limits and windows below 1 are refused.
    """
    if most < 1 or window < 1:
        raise ValueError("a limit and its window are at least 1")
    over = (lambda gap: gap >= window) if restart_at_end else (lambda gap: gap > window)

    def step(state, rows):
        at = rows["at"].to_numpy(float)
        began, count = state
        first, counts, i = np.zeros(len(at)), np.zeros(len(at), np.int64), 0
        while i < len(at):
            if began is None or over(at[i] - began):
                began, count = at[i], 0
            # All events of the window at once; the bound is settled by the same difference that decides.
            j = max(i + 1, int(np.searchsorted(at, began + window)))
            while j < len(at) and not over(at[j] - began):
                j += 1
            while j > i + 1 and over(at[j - 1] - began):
                j -= 1
            first[i:j], counts[i:j] = began, count + np.arange(1, j - i + 1)
            count, i = count + j - i, j
        retry = np.maximum(0, np.ceil(first + window - at)).astype(np.int64)
        return (began, count), (counts <= most, counts, np.maximum(most - counts, 0), retry)

    return (lambda: (None, 0)), step, "allowed boolean, count long, remaining long, retry_after long"


def circuit_breaker(threshold: int, open_for: float) -> tuple[Callable, Callable, str]:
    """So many failures open the circuit for a time and begin the count anew; a success clears all."""

    def step(state, rows):
        at, ok = rows["at"].to_numpy(float), rows["ok"].to_numpy(bool)
        held, until = state
        place = np.arange(len(at))
        cleared = np.maximum.accumulate(np.where(ok, place, -1))
        failures = np.cumsum(~ok)
        # Failures since the last success; those carried in count until the first one.
        since = failures - np.where(cleared >= 0, failures[cleared], -held)
        tripped = ~ok & (since % threshold == 0)
        tripping = np.maximum.accumulate(np.where(tripped, place, -1))
        before = lambda x: np.concatenate([[-1], x[:-1]])
        last = before(tripping)
        ends = np.where(last > before(cleared), at[last] + open_for, np.where(before(cleared) >= 0, -np.inf, -np.inf if until is None else until))
        left = (0, None) if ok[-1] else (int(since[-1] % threshold), at[tripping[-1]] + open_for if tripping[-1] > cleared[-1] else until if cleared[-1] < 0 else None)
        return left, (ends > at, np.where(ok, 0, since % threshold), tripped)

    return (lambda: (0, None)), step, "is_open boolean, failures long, tripped boolean"
