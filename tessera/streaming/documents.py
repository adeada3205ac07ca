"""The life of documents as a stream with timers: what the sweeps and pollers of lifecycle do over tables, told as it happens.

A document's state is its status with the time of its last progress, and the states of its windows that wait in batches. An event-time timer stands at the
last progress plus a timeout. When it goes off, a document that waits for a batch gets another one, a document in a resting state is left alone, and any
other is told as stuck, once. When the last window of a document comes back from its batch, the document is told to be finalized, once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.lifecycle import EDGES, STUCK_MINUTES, TERMINAL

EVENTS = "document_id long, at timestamp, kind string, name string, value string"
TOLD = "document_id long, told string, status string, at timestamp"
#: States of a window in a batch, waiting and done; the state that rests without being stuck.
WAITING, DONE, RESTING = ("pending", "submitting", "submitted"), ("succeeded", "rejected"), ("creating_source_spans",)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Documents(StatefulProcessor):
    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.document = handle.getValueState("document", "status string, progress long")
        self.windows = handle.getMapState("windows", "name string", "state string")

    def _arm(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _told(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["document_id", "told", "status", "at"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, progress = self.document.get() if self.document.exists() else ("queued", -1)
        out = []
        events = pd.concat(list(rows)).sort_values(["at", "kind", "name", "value"], na_position="first")
        for at, kind, name, value in zip(events["at"], events["kind"], events["name"], events["value"]):
            if kind == "window":
                self.windows.updateValue((name,), (value,))
                states = [v[0] for v in self.windows.values()]
                if status == "extracting_items" and all(s in DONE for s in states):
                    out.append(("finalize", status, at))
                    self.windows.clear()
            elif (status, value) in EDGES:
                status = value
                out.append(("moved", status, at))
            else:
                out.append(("refused", status, at))
                continue
            progress = max(progress, int(at.timestamp() * 1000))
        self.document.update((status, progress))
        if status in TERMINAL:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        elif progress >= 0:
            self._arm(max(progress + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._told(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, progress = self.document.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        waits = status == "extracting_items" and any(v[0] in WAITING[1:] for v in self.windows.values())
        if waits or status in RESTING:
            self.handle.registerTimer(max(now, timerValues.getCurrentWatermarkInMs()) + self.timeout_ms)
            return
        self.document.update(("failed", progress))
        yield self._told(key, [("stuck", status, pd.Timestamp(now, unit="ms"))])

    def close(self) -> None:
        pass


def watched(events: DataFrame, timeout_minutes: float = STUCK_MINUTES, late: str = "10 minutes") -> DataFrame:
    """events: a stream of EVENTS (kind 'status': the document goes to `value`; kind 'window': its window `name` is in state `value`) -> what is told (TOLD):
    moved and refused steps, finalize, stuck. The session's state store must be RocksDB (use_rocksdb())."""
    rows = events.withWatermark("at", late)
    return rows.groupBy("document_id").transformWithStateInPandas(statefulProcessor=Documents(int(timeout_minutes * 60_000)), outputStructType=TOLD, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
