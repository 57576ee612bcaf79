"""Sessions, first sights within a time, and back-off over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.state import IDLE, backoff_step


def session_stream(events: DataFrame, key: str, ts: str, late: str = "10 minutes", idle: int = IDLE) -> DataFrame:
    """The rows of sessions(), each given once its session can't grow any more."""
    w = F.session_window(ts, f"{idle} seconds").alias("w")
    return events.withWatermark(ts, late).groupBy(key, w).agg(F.min(ts).alias("started"), F.max(ts).alias("last_seen"), F.count("*").alias("n_events")).drop("w")


def first_within(events: DataFrame, keys: list[str], ts: str, ttl: str = "10 minutes") -> DataFrame:
    """The first event of each key; repeats within the time to live are dropped and their state expires."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def suspension_stream(events: DataFrame, key: str, second: str, challenged: str, base: int = 300) -> DataFrame:
    """(key, second, outcome, captcha_count, resume_at) in order of arrival, with a count and a time as the state of each key.

    State stays for every key; ordered.backoff_stream() takes rows in order of time and lets go of what has ended."""
    kind = events.schema[key].dataType.simpleString()

    def work(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = {}
        if held.exists:
            count, resume = held.get
            state = {"count": count} | ({"resume": resume} if resume >= 0 else {})
        rows = pd.concat(batches).sort_values(second, kind="stable")
        made = [backoff_step(state, (int(a), bool(b)), base) for a, b in zip(rows[second], rows[challenged], strict=True)]
        held.update((state.get("count", 0), state.get("resume", -1)))
        yield pd.DataFrame({key: name[0], second: rows[second].to_numpy(), "outcome": [m[0] for m in made], "captcha_count": [m[1] for m in made], "resume_at": pd.array([m[2] for m in made], "Int64")})

    return events.groupBy(key).applyInPandasWithState(work, f"{key} {kind}, {second} bigint, outcome string, captcha_count bigint, resume_at bigint", "count bigint, resume bigint", "append", GroupStateTimeout.NoTimeout)
