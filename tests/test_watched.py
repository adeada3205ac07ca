"""The document stream with timers."""

import pandas as pd
import pytest

from tessera.streaming import documents, events


@pytest.fixture
def told(spark, tmp_path):
    documents.use_rocksdb(spark)

    def run(*batches):
        """Each batch is a file, read one at a time."""
        folder = tmp_path / "events"
        for k, rows in enumerate(batches):
            frame = pd.DataFrame(rows, columns=["document_id", "at", "kind", "name", "value"])
            frame["at"] = pd.Timestamp("2024-01-01", tz="UTC") + pd.to_timedelta(frame["at"], unit="min")
            spark.createDataFrame(frame, documents.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(documents.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = events.run_to_memory(documents.watched(stream, 30, "0 minutes"), "told", "append", str(tmp_path / "state"))
        return sorted((r["document_id"], r["told"], r["status"]) for r in out.collect())

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def step(doc, at, value):
    return (doc, at, "status", None, value)


def window(doc, at, name, value):
    return (doc, at, "window", name, value)


def test_lives(told):
    got = told(
        [step(1, 0, "extracting_text"), step(2, 0, "extracting_items"), window(2, 1, "w1", "submitted"), window(2, 1, "w2", "submitted"), step(3, 0, "extracting_text"), step(4, 0, "indexing")],
        [step(3, 20, "creating_source_spans"), window(2, 20, "w1", "succeeded")],
        [step(9, 40, "extracting_text")],
        [window(2, 60, "w2", "rejected"), step(9, 61, "creating_source_spans")],
        [step(2, 70, "validating_items"), step(9, 200, "extracting_items")],
        [step(9, 220, "failed")],
        [step(9, 400, "queued")],
    )
    assert got == sorted([
        (1, "moved", "extracting_text"), (1, "stuck", "extracting_text"),
        (2, "moved", "extracting_items"), (2, "finalize", "extracting_items"), (2, "moved", "validating_items"), (2, "stuck", "validating_items"),
        (3, "moved", "extracting_text"), (3, "moved", "creating_source_spans"),
        (4, "refused", "queued"),
        (9, "moved", "extracting_text"), (9, "moved", "creating_source_spans"), (9, "moved", "extracting_items"), (9, "moved", "failed"), (9, "moved", "queued"),
    ])
