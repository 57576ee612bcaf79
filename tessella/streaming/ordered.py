"""Caches, idle networks and back-off over streams whose rows may come out of order.

Rows wait in their key's state until the watermark has passed them and are then taken in order, so the results are those of
the batch operators on any order of arrival within the allowed lateness; later rows are dropped. Event-time timers wake a key
when nothing more comes for it: for rows still waiting, for a quiet time that ends, for state that has expired. A key's
state is what its operator needs and the rows of the last `late` of time. The state store must be RocksDB's, which
these functions choose for the session unless it is chosen already. State's own time to live works on the clock, not
on events, so expiry is by timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.state import TTL, backoff_step

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Gives a key's rows in order of time, then of the other fields, once the watermark has passed them."""

    #: The fields of a waiting row, its time in milliseconds first, and those of a result, without the key.
    fields, made = "at bigint", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Opens the operator's own state."""

    def work(self, rows: list[tuple], now: int) -> list[tuple]:
        """Results of a key's next rows in order; now is the watermark, and no row up to it is still to come."""
        raise NotImplementedError

    def wake(self, at: int) -> None:
        """Asks to be called when the watermark has passed a time."""
        self.handle.registerTimer(int(at))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        new = [r for frame in rows for r in zip(*(self._plain(frame[c]) for c in self.names()), strict=True)]
        yield from self._advance(key, [r for r in new if r[0] >= now], now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    @classmethod
    def names(cls) -> list[str]:
        return [f.split()[0] for f in cls.fields.split(", ")]

    @staticmethod
    def _plain(column: pd.Series) -> list:
        return column.astype(object).where(column.notna(), None).tolist()

    def _advance(self, key: tuple, new: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in held + new if r[0] < now), key=lambda r: tuple((x is not None, x) for x in r))
        rest = [r for r in held + new if r[0] >= now]
        if rest:
            self.waiting.put(rest)
            self.wake(max(r[0] for r in rest) + 1)
        elif held:
            self.waiting.clear()
        out = self.work(ready, now)
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=["key", *(f.split()[0] for f in self.made.split(", "))])


class Cache(InOrder):
    """A bounded cache with a time to live: its names with the second of their last miss, as map state."""

    fields, made = "at bigint, tie bigint, name string, second bigint", "tie bigint, hit boolean"

    def __init__(self, ttl: int, most: int) -> None:
        self.ttl, self.most = ttl, most

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.cache = handle.getMapState("cache", "name string", "second bigint")

    def work(self, rows: list[tuple], now: int) -> list[tuple]:
        before = {k[0]: v[0] for k, v in self.cache.iterator()} if rows or now else {}
        held, out = dict(before), []
        for _, tie, name, second in rows:
            hit = name in held and second - held[name] < self.ttl
            if not hit:
                held.pop(name, None)
                if len(held) >= self.most:
                    held = {k: since for k, since in held.items() if second - since < self.ttl}
                if len(held) >= self.most:
                    del held[min(held, key=lambda k: held[k])]
                held[name] = second
            out.append((tie, hit))
        alive = {k: since for k, since in held.items() if 1000 * (since + self.ttl) > now}
        for name in before.keys() - alive.keys():
            self.cache.removeKey((name,))
        for name, since in alive.items():
            if before.get(name) != since:
                self.cache.updateValue((name,), (since,))
        if alive:
            self.wake(1000 * (max(alive.values()) + self.ttl) + 1)
        return out


class Idle(InOrder):
    """A load's first quiet time: how many requests are in flight, since when few enough, and when the load began."""

    fields, made = "at bigint, step int", "idle_at bigint"

    def __init__(self, quiet: int, most: int, cap: int) -> None:
        self.quiet, self.most, self.cap = quiet, most, cap

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.load = handle.getValueState("load", "first bigint, flying int, since bigint, done boolean")

    def work(self, rows: list[tuple], now: int) -> list[tuple]:
        first, flying, since, done = self.load.get() if self.load.exists() else (None, 0, None, False)
        out = []

        def settle(until: int) -> None:
            """Whether the load was idle by a time up to which all is known."""
            nonlocal done
            if done or first is None:
                return
            at = min(first + self.cap, since + self.quiet if since is not None else first + self.cap)
            if at <= until:
                out.append((at,))
                done = True

        spots: dict[int, int] = {}
        for at, step in rows:
            spots[at] = spots.get(at, 0) + step
        starts = {at for at, step in rows if step > 0}
        for at, step in spots.items():
            if first is not None and at > first + self.cap:
                settle(at)
                first, flying, since, done = None, 0, None, False
            if first is None:
                if at not in starts:
                    continue
                first = at
            settle(at)
            flying += step
            since = None if flying > self.most else at if since is None else since
        if first is None:
            self.load.clear()
            return out
        settle(now)
        if first + self.cap < now:
            self.load.clear()
        else:
            self.load.update((first, flying, since, done))
            self.wake(first + self.cap + 1)
            if not done and since is not None:
                self.wake(since + self.quiet + 1)
        return out


class Backoff(InOrder):
    """A name's suspension: challenges in a row and when it ends; gone once it has ended."""

    fields, made = "at bigint, tie bigint, second bigint, challenged boolean", "tie bigint, outcome string, captcha_count bigint, resume_at bigint"

    def __init__(self, base: int) -> None:
        self.base = base

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.suspended = handle.getValueState("suspended", "count bigint, resume bigint")

    def work(self, rows: list[tuple], now: int) -> list[tuple]:
        state = dict(zip(("count", "resume"), self.suspended.get(), strict=True)) if self.suspended.exists() else {}
        state = {k: v for k, v in state.items() if v is not None}
        out = [(tie, *backoff_step(state, (second, challenged), self.base)) for _, tie, second, challenged in rows]
        if "resume" in state and 1000 * state["resume"] > now:
            self.suspended.update((state.get("count", 0), state["resume"]))
            self.wake(1000 * state["resume"] + 1)
        else:
            self.suspended.clear()
        return out


def _run(rows: DataFrame, key: str, ts: str, late: str, processor: InOrder) -> DataFrame:
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    kind = rows.schema[key].dataType.simpleString()
    made = rows.withWatermark(ts, late).withColumn("at", F.unix_millis(F.col(ts))).select(F.col(key).alias("key"), ts, *processor.names())
    out = made.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, {processor.made}", "Append", "EventTime")
    return out.withColumnRenamed("key", key)


def cache_stream(requests: DataFrame, cache: str, key: str, ts: str, tie: str, late: str = "10 minutes", ttl: int = TTL, most: int = 256) -> DataFrame:
    """(cache, tie, hit) for a stream of requests: the rows of bounded_cache(). tie tells requests of one millisecond apart.

    State: at most `most` names a cache, none past its time to live, and the requests that still wait."""
    rows = requests.withColumns({"tie": F.col(tie).cast("long"), "name": F.col(key).cast("string"), "second": F.floor(F.unix_millis(F.col(ts)) / 1000).cast("long")})
    return _run(rows, cache, ts, late, Cache(ttl, most))


def idle_stream(marks: DataFrame, key: str, ts: str, step: str, late: str = "10 seconds", quiet: int = 500, most: int = 0, cap: int = 5000) -> DataFrame:
    """(key, idle_at): when each load counts as idle, given once that is certain, without a further event of the load.

    marks: a request's start (step 1) and end (step -1). A start later than `cap` after a load's first begins another load
    under the same key; an end without a load is dropped. State goes `cap` after the load's first start."""
    return _run(marks.withColumn("step", F.col(step).cast("int")), key, ts, late, Idle(quiet, most, cap))


def backoff_stream(searches: DataFrame, key: str, ts: str, tie: str, challenged: str, late: str = "10 minutes", base: int = 300) -> DataFrame:
    """(key, tie, outcome, captcha_count, resume_at): the rows of suspensions() for a stream of searches.

    State: a count and a time for names that are suspended now; gone by a timer once the suspension ends."""
    rows = searches.withColumns({"tie": F.col(tie).cast("long"), "second": F.floor(F.unix_millis(F.col(ts)) / 1000).cast("long"), "challenged": F.col(challenged).cast("boolean")})
    return _run(rows, key, ts, late, Backoff(base))
