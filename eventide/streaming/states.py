"""Order-bound operators over streams in which rows come out of order.

Each key's rows wait in list state until the watermark has passed them, and are then folded in order of event time, as the batch operators fold them; a
timer at the first waiting row wakes the key.  A key that is quiet for long enough gives what it still holds and its state expires, by a second
timer.  Rows behind the watermark can't be put in order any more; Spark leaves them out and counts them, see ``late_rows``.

Folds are small: they begin with a state, take a row and give a state and rows; ``end`` gives what an expired key still has to say.
State is JSON, so a stream can be restarted with newer code.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.detectors import loiter_step
from ..operators.ledger import GENESIS, TRANSITIONS, chain_problems

State = Any


@dataclass(frozen=True)
class Loitering:
    """Stretches in which a track stays near an anchor, as ``detectors.stationary`` finds them."""

    least_seconds: float
    reach: float = 0.75
    order = ("t", "frame_idx", "box_id")
    columns = ("t", "frame_idx", "box_id", "x1", "y1", "x2", "y2")
    schema = "start double, end double, frame_idx bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, duration double"

    def step(self, state: State, row: dict) -> tuple[State, list[tuple]]:
        return loiter_step(state, row, self.least_seconds, self.reach)

    def end(self, state: State) -> list[tuple]:
        return []


@dataclass(frozen=True)
class Holds:
    """How long each frame is shown: until the next one, ``least`` at least; the last one when its key expires."""

    least: float = 0.04
    order = ("t", "frame_idx")
    columns = ("t", "frame_idx")
    schema = "frame_idx bigint, hold double"

    def step(self, state: State, row: dict) -> tuple[State, list[tuple]]:
        return row, [(state["frame_idx"], max(self.least, row["t"] - state["t"]))] if state else []

    def end(self, state: State) -> list[tuple]:
        return [(state["frame_idx"], self.least)] if state else []


@dataclass(frozen=True)
class JobStates:
    """Each message with the state after it, and whether it was accepted."""

    order = ("ts", "n")
    columns = ("ts", "n", "message")
    schema = "n bigint, state string, taken boolean"

    def step(self, state: State, row: dict) -> tuple[State, list[tuple]]:
        after = TRANSITIONS.get((state, row["message"]))
        return after or state, [(row["n"], after or state, after is not None)]

    def end(self, state: State) -> list[tuple]:
        return []


@dataclass(frozen=True)
class ChainProblems:
    """What is wrong with each entry of a log, as ``ledger.problems`` finds it."""

    order = ("seq",)
    columns = ("seq", "statement_hash", "prev_hash", "entry_hash")
    schema = "seq bigint, problem string"

    def step(self, state: State, row: dict) -> tuple[State, list[tuple]]:
        count, prev = state or (0, GENESIS)
        return (count + 1, row["entry_hash"]), [(row["seq"], p) for p in chain_problems(row, count + 1, prev)]

    def end(self, state: State) -> list[tuple]:
        return []


class InOrder(StatefulProcessor):
    """Runs a fold over the rows of each key in order of event time."""

    def __init__(self, fold: Any, keys: list[str], names: list[str], kinds: str, quiet_ms: int):
        self.fold, self.keys, self.names, self.kinds, self.quiet = fold, keys, names, kinds, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"ms bigint, {self.kinds}")
        self.held = handle.getValueState("held", "saved string, newest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = [tuple(None if v is pd.NaT or v != v else v for v in r) for frame in rows for r in frame[["event_ms", *self.fold.columns]].astype(object).itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        saved, newest = self.held.get() or ("null", -1)
        latest = max(newest, *(r[0] for r in new))
        self.held.update((saved, latest))
        if newest >= 0:
            self.handle.deleteTimer(newest + self.quiet)
        self.handle.registerTimer(latest + self.quiet)
        self.handle.registerTimer(max(min(r[0] for r in new), timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if not self.held.exists():
            return iter([])
        passed = timerValues.getCurrentWatermarkInMs()
        saved, newest = self.held.get()
        rows = [dict(zip(("ms", *self.fold.columns), r, strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r["ms"] <= passed), key=lambda r: tuple(r[c] for c in self.fold.order))
        rest = [tuple(r.values()) for r in rows if r["ms"] > passed]
        state, out = json.loads(saved), []
        for r in ready:
            state, found = self.fold.step(state, {c: r[c] for c in self.fold.columns})
            out += found
        if passed >= newest + self.quiet:
            out += self.fold.end(state)
            self.waiting.clear()
            self.held.clear()
        else:
            self.held.update((json.dumps(state), newest))
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(r[0] for r in rest))
            else:
                self.waiting.clear()
        return iter([pd.DataFrame([(*key, *r) for r in out], columns=[*self.keys, *self.names])]) if out else iter([])

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: list[str], fold: Any, time: str, late: str = "10 minutes", quiet_seconds: float = 3600.0) -> DataFrame:
    """The rows that ``fold`` gives for each key of a stream, whose rows may come late by ``late``; ``time`` is a column of seconds or a timestamp.

    A key expires when nothing has come for ``quiet_seconds`` of event time beyond what may be late.  Needs the RocksDB state store (``use_rocksdb``).
    """
    at = F.col(time) if stream.schema[time].dataType.typeName() == "timestamp" else F.timestamp_millis((F.col(time) * 1000).cast("bigint"))
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    timed = stream.withColumn("event_at", at).withColumn("event_ms", F.unix_millis("event_at")).withWatermark("event_at", late)
    plain = [f"{c} {'double' if kinds[c] == 'timestamp' else kinds[c]}" for c in fold.columns]
    timed = timed.select(*keys, "event_at", "event_ms", *[F.unix_micros(c).cast("double").alias(c) if kinds[c] == "timestamp" else c for c in fold.columns if c not in keys])
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), fold.schema])
    names = [c.split()[0] for c in fold.schema.split(", ")]
    run = InOrder(fold, keys, names, ", ".join(plain), int(quiet_seconds * 1000))
    return timed.groupBy(*keys).transformWithStateInPandas(run, schema, "append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers is kept in RocksDB; call before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the batches that the query still remembers."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in json.loads(p.json)["stateOperators"])
