"""Folds over streams with state kept by key and timers that clear it.

Each operator gives every row of a stream its answer in event-time order: the first
of repeated keys among the last ones (a bounded first-in-first-out set), calls within
a rate limit whose windows start at a user's first call, the state of a circuit
breaker, calls within a budget that is renewed when its window ends. The answers are
those of the batch operators on all rows, as long as a key's rows come in order from
batch to batch; a restart goes on from the checkpoint. Within a batch rows are put in
order by time and id. The fold of a key reads and writes its state once a batch.

State is bounded: a limit, a breaker and a budget keep three numbers a key, and an
event-time timer removes them once they can't matter (the window is over, the circuit
has been closed or would be tried again). The set keeps ``most`` keys over all shards.
Rows later than the watermark are dropped by Spark (``sessions`` keeps them).

Cases: rows with a null key are one key; a null time is never on time and goes the way
of late rows; a null outcome is no failure; a null cost isn't admitted; an empty stream
gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Keys that repeats are looked for among, dealt over so many shards.
MOST, SHARDS = 100_000, 16
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Keep state in RocksDB, which list state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Fold(StatefulProcessor):
    """``step(state, row) -> (state, answer)`` over a key's rows in order; ``over(state)`` is when the state can go, in microseconds, or None."""

    def __init__(self, start: tuple, step: Callable, over: Callable, schema: str, reads: list[str], answer: str, keep: list[str]):
        self.start, self.step, self.over, self.schema, self.reads, self.answer, self.keep = start, step, over, schema, reads, answer, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        pdf = (parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)).sort_values(["us", "event_id"], kind="stable")
        old = self.state.get()  # each question about state goes to the JVM and back, so a new key asks once
        state = self.start if old is None else tuple(old)
        out = []
        for values in zip(*(pdf[c].tolist() for c in self.reads), strict=True):
            state, answer = self.step(state, *values)
            out.append(answer)
        if old is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        until = self.over(state)
        if until is None:
            if old is not None:
                self.state.clear()
        else:
            self.state.update(state)
            self.handle.registerTimer(-(-until // 1000))
        yield pdf[self.keep].assign(**{self.answer: out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, key: str, start: tuple, step: Callable, over: Callable, schema: str, reads: list[str], answer: str, kind: str, late: str, extra: dict[str, Column] | None = None) -> DataFrame:
    stateful(rows.sparkSession)
    shown = rows.select(_marked(key).alias("k"), _marked("event_id").alias("e"), "event_id", "ts", F.unix_micros("ts").alias("us"), *[c.alias(n) for n, c in (extra or {}).items()]).withWatermark("ts", late)
    out = shown.groupBy("k").transformWithStateInPandas(_Fold(start, step, over, schema, reads, answer, ["k", "e", "us"]), f"k string, e string, us long, {answer} {kind}", "Append", "EventTime")
    return out.select(_plain("k", rows, key).alias(key), _plain("e", rows, "event_id").alias("event_id"), "us", answer)


def _marked(column: str) -> Column:
    """A column as text that is never null, so that null is a key like others and no number passes through pandas as a float."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _plain(marked: str, rows: DataFrame, column: str) -> Column:
    return F.when(F.col(marked) != "", F.expr(f"substring({marked}, 2)")).cast(rows.schema[column].dataType)


def rate_limited(rows: DataFrame, *, key: str, limit: int, window_us: int, late: str = "1 hour") -> DataFrame:
    """(key, event_id, us, admitted): a window starts at a key's first call after the last one's end and admits ``limit`` calls."""

    def step(s: tuple, us: int):
        start, n = s if s[1] and us - s[0] < window_us else (us, 0)
        return (start, n + 1), n < limit

    return _folded(rows, key, (0, 0), step, lambda s: s[0] + window_us, "start long, n long", ["us"], "admitted", "boolean", late)


def breaker(rows: DataFrame, failed: Column, *, key: str, failures: int, cool_us: int, late: str = "1 hour") -> DataFrame:
    """(key, event_id, us, state): the circuit that each call sees. A closed circuit without failures keeps no state."""

    def step(s: tuple, us: int, bad: bool):
        state, n, since = s
        seen = "half_open" if state == "open" and us - since >= cool_us else state
        if seen == "open":
            return s, seen
        n = n + 1 if bad else 0
        if bad and (seen == "half_open" or n >= failures):
            return ("open", n, us), seen
        return ("closed" if not bad else seen, n, since if not bad else us), seen

    def over(s: tuple):
        return None if s[0] == "closed" and not s[1] else (1 << 53) * 1000  # an open circuit stays until it is tried

    return _folded(rows, key, ("closed", 0, 0), step, over, "state string, n long, since long", ["us", "failed"], "state", "string", late, {"failed": F.coalesce(failed, F.lit(False))})


def budget(rows: DataFrame, cost: Column, *, key: str, ceiling: float, window_us: int, late: str = "1 hour") -> DataFrame:
    """(key, event_id, us, admitted): calls whose cost fits into what is left of the window's budget; a window starts at the first call after the last one's end."""

    def step(s: tuple, us: int, c: float | None):
        start, used, open_ = s if s[2] and us - s[0] < window_us else (us, 0.0, 1)
        ok = c is not None and c == c and used + c <= ceiling
        return (start, used + (c if ok else 0.0), open_), bool(ok)

    return _folded(rows, key, (0, 0.0, 0), step, lambda s: s[0] + window_us, "start long, used double, open long", ["us", "cost"], "admitted", "boolean", late, {"cost": cost.cast("double")})


class _Fifo(StatefulProcessor):
    """The last ``most`` keys of a shard, in the order in which they came first."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.seen = handle.getListState("seen", "k string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["us", "k"], kind="stable")
        seen = OrderedDict((x[0], None) for x in self.seen.get()) if self.seen.exists() else OrderedDict()
        new = []
        for k in pdf["k"].tolist():
            new.append(k not in seen)
            if new[-1]:
                seen[k] = None
                if len(seen) > self.most:
                    seen.popitem(last=False)
        self.seen.put([(k,) for k in seen])
        yield pdf.loc[new, ["k", "us"]]

    def close(self) -> None:
        pass


def first_of_last(rows: DataFrame, key: str, *, most: int = MOST, shards: int = SHARDS) -> DataFrame:
    """(key, us): rows whose key isn't among the ``most / shards`` keys that its shard took in last; a key's shard is a hash of it."""
    stateful(rows.sparkSession)
    shown = rows.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), _marked(key).alias("k"), F.unix_micros("ts").alias("us"))
    out = shown.groupBy("shard").transformWithStateInPandas(_Fifo(max(1, most // shards)), "k string, us long", "Append", "None")
    return out.select(_plain("k", rows, key).alias(key), "us")
