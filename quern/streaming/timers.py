"""Per-session state with an end: elapsed times event by event, and freezes that are released by timers.

Both keep value state in RocksDB by transformWithState: state that is not touched for a time to live goes, and a restart
goes on from the checkpoint.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Elapsed(StatefulProcessor):
    """Seconds since the session's last event of each kind, for every event; state: one time a kind."""

    def __init__(self, kinds: dict[str, str], ttl_ms: int):
        self.kinds, self.ttl_ms = kinds, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = {name: handle.getValueState(name, "at long", self.ttl_ms) for name in self.kinds.values()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        at = pdf["ts"].astype("datetime64[us]").astype("int64") // 1_000_000
        out = pd.DataFrame({"session_id": key[0], "event_id": pdf["event_id"].to_numpy()})
        for kind, name in self.kinds.items():
            held = self.last[name].get() if self.last[name].exists() else None
            mine = at.where((pdf["event_type"] == kind).to_numpy())
            before = mine.ffill().shift(1)
            if held is not None:
                before = before.fillna(held[0])
            out[name] = pd.array((at - before).to_numpy(), dtype="Int64")
            if mine.notna().any():
                self.last[name].update((int(mine.dropna().iloc[-1]),))
        yield out

    def close(self) -> None:
        pass


def elapsed(stream: DataFrame, kinds: dict[str, str], ttl_ms: int = 30 * DAY) -> DataFrame:
    """session_id, event_id and a column a kind (by event type) for every event of (session_id, event_id, ts, event_type).

    Null before the first event of a kind. Batches are expected in order of time by session; within a batch order does
    not matter. State that a session has not changed for ttl_ms of processing time goes.
    """
    shape = ", ".join(["session_id string", f"event_id {stream.schema['event_id'].dataType.simpleString()}", *(f"{n} long" for n in kinds.values())])
    return stream.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Elapsed(kinds, ttl_ms), outputStructType=shape, outputMode="Append", timeMode="ProcessingTime")


def said(*rows: tuple[str, int, int]) -> pd.DataFrame:
    """Rows of session_id, ts and ready_at, which are given in milliseconds."""
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    times = [pd.to_datetime(pd.Series(c, dtype="int64"), unit="ms") for c in cols[1:]]
    return pd.DataFrame({"session_id": pd.Series(cols[0], dtype="object"), "ts": times[0], "ready_at": times[1]})


class Release(StatefulProcessor):
    """One row a freeze, when the watermark has passed the time from which it may be acted on; too old ones go unsaid.

    State: the newest open freeze of a session, and the newest that was released, so that none is released twice.
    """

    def __init__(self, age_ms: int):
        self.age_ms = age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ts long, ready long")
        self.done = handle.getValueState("done", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        ts, ready = (pdf[c].astype("datetime64[us]").astype("int64") // 1000 for c in ("ts", "ready_at"))
        newest = int(ts.max())
        held = self.open.get()[0] if self.open.exists() else -1
        told = self.done.get()[0] if self.done.exists() else -1
        if newest > max(held, told):
            if held >= 0:  # a later freeze of the session stands for the earlier one
                self.handle.deleteTimer(self.open.get()[1])
            at = int(ready[ts == newest].max())
            self.open.update((newest, at))
            self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        yield said()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            ts, ready = self.open.get()
            self.open.clear()
            if timerValues.getCurrentWatermarkInMs() <= ts + self.age_ms:
                self.done.update((ts,))
                yield said((key[0], ts, ready))
                return
        yield said()

    def close(self) -> None:
        pass


def released(freezes: DataFrame, late: str = "10 minutes", age_days: int = 2) -> DataFrame:
    """session_id, ts and ready_at of each session's newest freeze of (session_id, ts, ready_at), once it is due.

    A row comes out when events let the watermark (late behind the newest ts) pass ready_at, and not if it has passed
    the freeze by age_days by then. A freeze is released at most once, whatever is read again.
    """
    stamped = freezes.select("session_id", "ts", "ready_at").withWatermark("ts", late)
    return stamped.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Release(age_days * DAY), outputStructType="session_id string, ts timestamp, ready_at timestamp", outputMode="Append", timeMode="EventTime")
