"""Time-driven state in batch: sessions, back-off, a cache with a time to live, idle networks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Seconds.
IDLE, TTL = 480, 600
LADDER = (300, 600, 1800, 3600)


def sessions(events: DataFrame, key: str, ts: str, idle: int = IDLE) -> DataFrame:
    """A row for each session: a key's events no more than idle seconds apart."""
    return events.groupBy(key, F.session_window(ts, f"{idle} seconds").alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("last_seen"), F.count("*").alias("n_events")).drop("w")


def by_key_in_order(rows: DataFrame, key: str, order: list[str], step: Callable[[dict, tuple], tuple], read: list[str], out: str) -> DataFrame:
    """rows with what a state machine gives for each, keys dealt out and each key's rows streamed in order.

    step(state, values of read) returns the new columns' values; state is a dict that starts empty for each key. A
    task holds one key's state and one batch, never a key's rows.
    """
    new = rows.sparkSession.createDataFrame([], out).schema
    schema = rows.schema
    for f in new:
        schema = schema.add(f)
    names, kinds = [f.name for f in new], [pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() if f.dataType.simpleString() == "string" else pa.bool_() for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), {}
        for batch in batches:
            made = []
            for k, *values in zip(batch.column(batch.schema.get_field_index(key)).to_pylist(), *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in read), strict=True):
                if k != now:
                    now, state = k, {}
                made.append(step(state, tuple(values)))
            columns = zip(*made, strict=True) if made else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], [*batch.schema.names, *names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def backoff(count: int, base: int) -> int:
    """Seconds of suspension after the count-th challenge in a row."""
    return max(base, LADDER[min(max(count, 1), len(LADDER)) - 1])


def backoff_step(state: dict, values: tuple, base: int = 300) -> tuple[str, int, int | None]:
    """One search: skipped while suspended, else a challenge suspends longer each time and a success starts anew."""
    second, challenged = values
    resume = state.get("resume")
    if resume is not None and resume <= second:
        state.clear()
    elif resume is not None:
        return "suspended", state["count"], resume
    if challenged:
        state["count"] = state.get("count", 0) + 1
        state["resume"] = second + backoff(state["count"], base)
        return "captcha", state["count"], state["resume"]
    state["count"] = 0
    return "ok", 0, state.get("resume")


def suspensions(events: DataFrame, key: str, second: str, challenged: str, order: list[str], base: int = 300) -> DataFrame:
    """events with outcome, captcha_count and resume_at (epoch seconds)."""
    return by_key_in_order(events, key, order, lambda s, v: backoff_step(s, v, base), [second, challenged], "outcome string, captcha_count bigint, resume_at bigint")


def cache_hits(requests: DataFrame, key: str, second: str, order: list[str], ttl: int = TTL) -> DataFrame:
    """requests with hit: whether the last miss of the key is younger than ttl seconds."""

    def step(state: dict, values: tuple) -> tuple[bool]:
        (at,) = values
        if "at" in state and at - state["at"] < ttl:
            return (True,)
        state["at"] = at
        return (False,)

    return by_key_in_order(requests, key, order, step, [second], "hit boolean")


def bounded_cache(requests: DataFrame, cache: str, key: str, second: str, order: list[str], ttl: int = TTL, most: int = 256) -> DataFrame:
    """requests with hit for caches that hold at most `most` keys: a full one drops what has expired, else its oldest key."""

    def step(state: dict, values: tuple) -> tuple[bool]:
        name, at = values
        held = state.setdefault("held", {})
        if name in held and at - held[name] < ttl:
            return (True,)
        held.pop(name, None)
        # Keys stand in order of coming in. While seconds never fall that is the order of age, so the oldest are at the front.
        state["aged"] = state.get("aged", True) and at >= state.get("at", at)
        state["at"] = at
        if len(held) >= most:
            front = iter(held.items()) if state["aged"] else iter(sorted(held.items(), key=lambda x: x[1]))
            gone = [old for old, _ in takewhile(lambda x: at - x[1] >= ttl, front)] or [next(iter(held)) if state["aged"] else min(held, key=held.get)]
            for old in gone:
                del held[old]
        held[name] = at
        return (False,)

    return by_key_in_order(requests, cache, order, step, [key, second], "hit boolean")


def last_writes(rows: DataFrame, session: str, key: str, seq: str, value: str) -> DataFrame:
    """(session, key, value): the last value that each session wrote to each key; one shuffle with partial aggregates."""
    return rows.groupBy(session, key).agg(F.max_by(value, seq).alias(value))


def idle_reached(requests: DataFrame, key: str, start_ms: str, end_ms: str, quiet: int = 500, most: int = 0, cap: int = 5000) -> DataFrame:
    """(key, idle_at): when a load counts as idle: after its first quiet time, at the latest `cap` milliseconds after its first request."""
    first = requests.groupBy(key).agg(F.min(start_ms).alias("__first"))
    calm = _quiet_times(requests, key, start_ms, end_ms, most).where(F.coalesce("idle_ms", F.lit(quiet)) >= quiet).groupBy(key).agg(F.min("idle_from").alias("__from"))
    return first.join(calm, key, "left").select(key, F.least(F.col("__from") + quiet, F.col("__first") + cap).alias("idle_at"))


def idle_gaps(requests: DataFrame, key: str, start_ms: str, end_ms: str, quiet: int = 500, most: int = 0) -> DataFrame:
    """(key, idle_from, idle_ms) where at most `most` requests stay in flight for quiet milliseconds or more, until more are again."""
    return _quiet_times(requests, key, start_ms, end_ms, most).where(F.col("idle_ms") >= quiet)


def _quiet_times(requests: DataFrame, key: str, start_ms: str, end_ms: str, most: int) -> DataFrame:
    """(key, idle_from, idle_ms) of each time with at most `most` requests in flight; idle_ms is null for one without an end."""
    marks = requests.select(key, F.explode(F.array(F.struct(F.col(start_ms).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end_ms).alias("at"), F.lit(-1).alias("step")))).alias("m")).select(key, "m.*")
    marks = marks.groupBy(key, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(key).orderBy("at")
    marks = marks.withColumn("calm", F.sum("step").over(w) <= most)
    turns = marks.withColumn("before", F.lag("calm").over(w)).where("before IS NULL OR before <> calm")
    return turns.withColumn("idle_ms", F.lead("at").over(w) - F.col("at")).where("calm").select(key, F.col("at").alias("idle_from"), "idle_ms")
