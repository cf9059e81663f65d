"""Rate limits, spending limits and caches, event by event (SS2 to SS4, SS6).

Each is a step from state to state over a key's events in order. A batch deals events by key, sorts
them within partitions and runs over them, so memory holds one key's state and never its events; a
stream keeps the state between micro-batches.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class TokenBucket:
    """SS2: ``capacity`` tokens at first, ``refill`` a second up to that; an event passes if a token is left."""

    capacity: float
    refill: float
    tokens: float | None = None
    last: float = 0.0

    def step(self, at: float, value: float) -> bool:
        tokens = self.capacity if self.tokens is None else min(self.capacity, self.tokens + (at - self.last) * self.refill)
        self.last = at
        passed = tokens >= 1
        self.tokens = tokens - passed
        return passed


@dataclass
class Spending:
    """SS6, CV2: an amount counts if it keeps the sum within the limit; a rejected one leaves it as it is."""

    limit: float
    spent: float = 0.0

    def step(self, at: float, value: float) -> bool:
        passed = self.spent + value <= self.limit
        self.spent += value if passed else 0.0
        return passed


@dataclass
class TtlCache:
    """SS3: keys (``value``) live ``ttl`` seconds; expired ones go on access, and if the cache is full the one that expires first. True is a hit; a miss stores the key."""

    ttl: float
    size: int
    held: OrderedDict = field(default_factory=OrderedDict)

    def step(self, at: float, value: float) -> bool:
        if value in self.held:
            if at < self.held[value]:
                return True
            del self.held[value]
        if len(self.held) >= self.size:
            for k in [k for k, end in self.held.items() if end <= at]:
                del self.held[k]
            if len(self.held) >= self.size:
                del self.held[min(self.held, key=self.held.get)]
        self.held[value] = at + self.ttl
        return False


@dataclass
class LruCache:
    """SS4: of ``size`` keys the one least recently used goes."""

    size: int
    held: OrderedDict = field(default_factory=OrderedDict)

    def step(self, at: float, value: float) -> bool:
        hit = value in self.held
        self.held[value] = True
        self.held.move_to_end(value)
        if len(self.held) > self.size:
            self.held.popitem(last=False)
        return hit


def replay(events: DataFrame, start: Callable[[], object]) -> DataFrame:
    """``key, id, at, value, passed`` of a batch of events (``key, id, at`` in seconds, ``value``), in order of ``at, id`` within a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, at, value in zip(batch["key"], batch["at"], batch["value"], strict=True):
                if state is None or k != key:
                    key, state = k, start()
                out.append(state.step(at, value))
            yield batch.assign(passed=out)

    rows = events.select("key", "id", "at", "value").repartition("key").sortWithinPartitions("key", "at", "id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, passed boolean")


def limited(events: DataFrame, capacity: float, refill: float) -> DataFrame:
    """SS2 on a stream: as ``replay`` with a token bucket for each key; events of a micro-batch are taken in order of ``at, id``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(capacity, refill, *(state.get if state.exists else (None, 0.0)))
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        passed = [bucket.step(at, 0.0) for at in rows["at"]]
        state.update((bucket.tokens, bucket.last))
        yield rows.assign(passed=passed)

    rows = events.select("key", "id", "at", "value")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("key").applyInPandasWithState(run, f"{kinds}, passed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def spent(events: DataFrame, limit: float) -> DataFrame:
    """SS6 on a stream: as ``replay`` with a spending limit for each key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        purse = Spending(limit, *(state.get if state.exists else (0.0,)))
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        passed = [purse.step(at, value) for at, value in zip(rows["at"], rows["value"], strict=True)]
        state.update((purse.spent,))
        yield rows.assign(passed=passed)

    rows = events.select("key", "id", "at", "value")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("key").applyInPandasWithState(run, f"{kinds}, passed boolean", "spent double", "append", GroupStateTimeout.NoTimeout)
