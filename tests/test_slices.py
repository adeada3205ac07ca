"""What a task holds at once doesn't grow with an Arrow batch."""

import pyarrow as pa

from tessera.llm import cdc
from tessera.operators import runs


def test_results_come_in_slices(spark):
    """A hundred batches of one task come back whole, in slices of POLLED."""
    rows = spark.range(100).selectExpr("id AS batch_id", "concat('p', id) AS provider_batch_id", "'submitted' AS processing_status").coalesce(1)
    items = spark.range(300).selectExpr("id % 100 AS batch_id", "concat('h', id) AS input_hash", "'submitted' AS status")
    def retrieve(batch, hashes):
        return "ended", [{"input_hash": h, "result_type": "succeeded", "parsed": True, "valid": True, "retryable": True} for h in hashes]

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = runs.poll_batches(rows, items, retrieve).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(out) == 100 and sum(len(r["results"]) for r in out) == 300 and all(r["ended"] for r in out)
    assert runs.POLLED < 100


def test_fingerprints_come_in_slices(monkeypatch):
    """Pairs across slices are not lost."""
    n = 700
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n), pa.array([f"text {k} " * (k % 40) for k in range(n)]), pa.array([0] * n), pa.array([0] * (n - 1) + [1])], names=["doc", "row", "text", "span", "role"])
    parts = list(cdc._compare([batch]))
    assert max(p.num_rows for p in parts) <= cdc.AT_ONCE
    monkeypatch.setattr(cdc, "AT_ONCE", 1 << 20)
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(list(cdc._compare([batch]))).to_pylist() and sum(p.num_rows for p in parts) == n - 1
