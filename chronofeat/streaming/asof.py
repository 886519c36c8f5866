"""As-of aggregates of a stream: facts change a key's state, asks read it, both in the order of their times.

Keys are dealt to buckets by their hash; a bucket's keys share a state, since Spark calls Python once for each state and batch, which costs milliseconds. Rows
wait there until the watermark has passed them: no earlier row can come any more, so they are taken in time order, facts of a
time before its asks, and each ask is answered by what its key has seen. A timer wakes buckets that get no rows. Rows that come later than the watermark allows are dropped.
A key's waiting rows are those of the lateness allowed; what is left of older ones is a few numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MODES = ("count", "sum", "mean", "max", "min", "last")
FACT, ASK = 0, 1
#: Buckets that keys are dealt to; a bucket's state is its share of all keys, a few numbers each.
BUCKETS = 1 << 12


def seen(state: tuple | None, x: float) -> tuple:
    """(n, sum, least, greatest, last) with one value more."""
    if state is None:
        return 1, x, x, x, x
    n, total, low, high, _ = state
    return n + 1, total + x, min(low, x), max(high, x), x


def told(state: tuple | None, mode: str) -> float | None:
    if state is None:
        return 0.0 if mode in ("count", "sum") else None
    n, total, low, high, last = state
    return float({"count": n, "sum": total, "mean": total / n, "max": high, "min": low, "last": last}[mode])


def sides(facts: DataFrame, asks: DataFrame, key: tuple[str, str], time: tuple[str, str], order: tuple[str, str], value: str) -> DataFrame:
    """Both as one stream (key, ts, tag, id, value)."""
    fact = facts.select(F.col(key[1]).cast("string").alias("key"), F.col(time[1]).cast("timestamp").alias("ts"), F.lit(FACT).alias("tag"), F.col(order[1]).cast("long").alias("id"), F.col(value).cast("double").alias("value"))
    ask = asks.select(F.col(key[0]).cast("string").alias("key"), F.col(time[0]).cast("timestamp").alias("ts"), F.lit(ASK).alias("tag"), F.col(order[0]).cast("long").alias("id"), F.lit(None).cast("double").alias("value"))
    return fact.unionByName(ask)


def answered(rows: DataFrame, mode: str, late: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """(key, id, ts, value) of the asks among rows (key, ts, tag, id, value). Null keys and times are dropped; null values change nothing. buckets: more for very many keys; fixed while a stream lasts."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")

    def run(key: tuple, given: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, held = pickle.loads(state.get[0]) if state.exists else ([], {})
        if not state.hasTimedOut:
            for pdf in given:
                waiting += zip(pdf["ms"].tolist(), pdf["tag"].tolist(), pdf["id"].tolist(), pdf["value"].tolist(), pdf["key"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs()
        ready = sorted(w for w in waiting if w[0] // 1000 <= passed)
        waiting = [w for w in waiting if w[0] // 1000 > passed]
        out = []
        for us, tag, i, x, k in ready:
            if tag == ASK:
                out.append((k, i, us, told(held.get(k), mode)))
            elif x == x:  # NaN stands for null
                held[k] = seen(held.get(k), x)
        state.update((pickle.dumps((waiting, held)),))
        if waiting:
            state.setTimeoutTimestamp(max(passed + 1, min(w[0] for w in waiting) // 1000))
        yield pd.DataFrame(out, columns=["key", "id", "us", "value"])

    timed = rows.filter(F.col("key").isNotNull() & F.col("ts").isNotNull()).withColumn("ms", F.unix_micros("ts")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).withWatermark("ts", late)
    made = timed.groupBy("bucket").applyInPandasWithState(run, "key string, id long, us long, value double", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("key", "id", F.timestamp_micros("us").alias("ts"), "value")
