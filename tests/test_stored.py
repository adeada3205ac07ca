"""Stored indexes, packed queues, versioned tables and durable extraction."""

import math
import os
import random
import re
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import keyword_index, packing, runs, search, vector_index
from tessera.sources import scratch, versioned


def sorted_rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# -- vector index ------------------------------------------------------------------------------------------------------


def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8)) * 4
    rows = [(k, k // 3, "recipe_full", "p", "m", (centres[k % 30] + rng.normal(scale=0.2, size=8)).tolist(), k) for k in range(1500)]
    rows += [(2000, 1, "recipe_full", "p", "m", [0.0] * 8, 1), (2001, 1, "recipe_full", "p", "m", None, 1), (2002, 1, "recipe_full", "p", "m", [float("nan")] * 8, 1), (2003, 1, "recipe_full", "p", "other", rows[0][5], 1), (2004, 1, "recipe_full", "p", "m", [1.0, 2.0], 1)]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_id long, chunk_type string, provider string, model string, embedding array<double>, extra int")
    asked = [(f"q{k}", "p", "m", rows[k][5]) for k in range(0, 300, 30)] + [("other", "p", "other", rows[7][5]), ("short", "p", "m", [1.0, 1.0]), ("zero", "p", "m", [0.0] * 8), ("none", "q", "m", rows[0][5])]
    return chunks, spark.createDataFrame(asked, "query_id string, provider string, model string, vector array<double>")


def test_vector_index_is_exact_and_reads_little(spark, tmp_path, monkeypatch):
    chunks, queries = clustered(spark)
    path = f"{tmp_path}/index"
    vector_index.build(chunks.where("chunk_id % 4 > 0 AND model = 'm'"), path)
    vector_index.append(chunks.where("chunk_id % 4 = 0 OR model <> 'm'"), path)
    far = lambda df: sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["distance"], 9), r["extra"]) for r in df.collect())
    seen = {}
    keep = scratch.stored
    monkeypatch.setattr(scratch, "stored", lambda df, label: seen.setdefault(label, keep(df, label)) if label == "further-probes" else keep(df, label))
    assert far(vector_index.vector_leg(path, queries, 7)) == far(search.vector_leg(chunks, queries, 7))
    cells = vector_index.cells(spark, path).count()
    assert cells > 20 and seen["further-probes"].count() < 0.2 * 10 * cells
    some = chunks.where("item_id % 5 = 0").select("chunk_id")
    assert far(vector_index.vector_leg(path, queries, 7, some)) == far(search.vector_leg(chunks.join(some, "chunk_id", "left_semi"), queries, 7))
    one = [r["cell"] for r in spark.read.parquet(f"{path}/rows").select("cell").distinct().limit(1).collect()]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(one))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)


# -- keyword index -----------------------------------------------------------------------------------------------------


def test_bounds_hold():
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randint(1, 4)
        places = rng.sample(range(1, 40), rng.randint(n, 25))
        found = {t: [] for t in "abcd"[:n]}
        for k, p in enumerate(places):
            found["abcd"[k] if k < n else rng.choice(list(found))].append(p)
        counts = [len(v) for v in found.values()]
        score = search.cover_density({t: sorted(v) for t, v in found.items()})
        assert score <= min(n * min(counts), sum(counts) - n + 1) + 1e-9


@pytest.mark.parametrize("count", [False, True])
def test_keyword_index_is_the_leg(spark, tmp_path, monkeypatch, count):
    monkeypatch.setattr(keyword_index, "SEGMENT", 16)
    rng = random.Random(3)
    texts = [[rng.choice("abcdefgh") if rng.random() < 0.9 else "rare" for _ in range(rng.randint(0, 30))] for _ in range(400)]
    rows = [(k, k // 2, "recipe_steps", [(w, n + 1) for n, w in enumerate(t)]) for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_id long, chunk_type string, lexemes array<struct<lexeme:string,pos:int>>")
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["rare"]), (3, ["a", "rare", "c"]), (4, []), (5, ["nowhere", "a"])], "query_id int, terms array<string>")
    path = f"{tmp_path}/index"
    keyword_index.append(chunks.where("chunk_id < 150"), path)
    keyword_index.append(chunks.where("chunk_id >= 150"), path)
    assert spark.read.parquet(f"{path}/chunks").select("segment").distinct().count() >= 25
    want = search.word_leg(chunks.withColumn("words", F.col("lexemes.lexeme")), asked, 5) if count else search.keyword_leg(chunks, asked, 5)
    columns = ["query_id", "chunk_id", "item_id", "rank", "raw_score"]
    assert sorted_rows(keyword_index.keyword_leg(path, asked, 5, count=count), *columns) == sorted_rows(want, *columns)
    some = chunks.where("chunk_id % 3 = 0").select("chunk_id")
    within = chunks.join(some, "chunk_id", "left_semi")
    want = search.word_leg(within.withColumn("words", F.col("lexemes.lexeme")), asked, 5) if count else search.keyword_leg(within, asked, 5)
    assert sorted_rows(keyword_index.keyword_leg(path, asked, 5, some, count), *columns) == sorted_rows(want, *columns)


# -- packing -----------------------------------------------------------------------------------------------------------


def walk(sizes, most, most_size):
    out, batch, count, total = [], 0, 0, 0
    for k, s in enumerate(sizes):
        if k and (count >= most or total + s > most_size):
            batch, count, total = batch + 1, 0, 0
        count, total = count + 1, total + s
        out.append(batch)
    return out


def test_one_long_queue_over_many_tasks(spark):
    sizes = np.random.default_rng(4).integers(0, 500, 10**6)
    sizes[[0, 5000, 999_999]] = 10**6
    rows = spark.createDataFrame(pd.DataFrame({"n": np.arange(10**6), "size": sizes})).withColumn("queue", F.lit("one"))
    got = packing.pack(rows, "queue", ["n"], "size", 100, 20_000, 1 << 14).toPandas().sort_values("n")
    assert got["batch"].tolist() == walk(sizes.tolist(), 100, 20_000)


def test_many_queues(spark):
    rng = random.Random(5)
    rows = [(q, n, rng.randint(0, 9)) for q in [None, "", "a", "b", *map(str, range(60))] for n in range(rng.choice([1, 2, 50]))]
    got = packing.pack(spark.createDataFrame(rows, "queue string, n int, size long"), "queue", ["n"], "size", 4, 15, 8).collect()
    for q in {r[0] for r in rows}:
        mine = sorted((r["n"], r["batch"]) for r in got if r["queue"] == q)
        assert [b for _, b in mine] == walk([s for k, _, s in rows if k == q], 4, 15)
    assert packing.pack(spark.createDataFrame([], "queue string, n int, size long"), "queue", ["n"], "size", 4, 15).count() == 0


# -- versions ----------------------------------------------------------------------------------------------------------


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = spark.range(3).withColumn("status", F.lit("queued"))
    assert versioned.version(spark, path) == -1 and versioned.publish(rows, path) == 0
    mine, theirs = versioned.read(spark, path), versioned.read(spark, path)
    versioned.publish(mine.withColumn("status", F.when(F.col("id") == 0, "ready").otherwise(F.col("status"))), path, 0)
    with pytest.raises(versioned.StaleWriter):
        versioned.publish(theirs.withColumn("status", F.lit("failed")), path, 0)
    # a writer that passed the check before the other published is refused by the log itself
    with pytest.raises(versioned.StaleWriter):
        versioned._publish(spark, path, {"version": 1, "folders": [], "commit": None})
    assert sorted_rows(versioned.read(spark, path), "id", "status") == [(0, "ready"), (1, "queued"), (2, "queued")]
    assert sorted_rows(versioned.read(spark, path, 0), "status") == [("queued",)] * 3
    tries = []

    def slow(table):
        if not tries:  # another writer comes in between
            versioned.append(spark.range(7, 8).withColumn("status", F.lit("queued")), path, "late")
        tries.append(1)
        return table.where("status = 'queued'")

    assert versioned.update(spark, path, slow) == 3 and len(tries) == 2
    assert sorted_rows(versioned.read(spark, path), "id") == [(1,), (2,), (7,)]
    assert versioned.append(spark.range(9, 10).withColumn("status", F.lit("x")), path, "late") is False and versioned.version(spark, path) == 3


def provider_in(folder, dies_at):
    """Answers prompts and notes each; prompts in dies_at break it as long as the folder has no file `well`."""

    def answer(prompts):
        if not os.path.exists(f"{folder}/well") and set(prompts) & dies_at:
            raise ConnectionError("away")
        for p in prompts:
            open(f"{folder}/{p}-{uuid.uuid4().hex}", "w").close()
        return [('{"items": []}', None) for _ in prompts]

    return answer


def test_a_dead_provider_costs_one_commit(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    windows = spark.createDataFrame([("book", w, f"p{w}", f"h{w}") for w in range(20)], "document_id string, window int, prompt string, input_hash string").coalesce(1)
    path, key, beats = f"{tmp_path}/job", ["document_id", "window"], []
    runs.prepare_windows(windows, path, size=5)
    asked = lambda: sorted(int(f.split("-")[0][1:]) for f in os.listdir(notes) if f != "well")
    with pytest.raises(runs.ExtractionFailed, match="away"):
        runs.extract_durably(spark, path, provider_in(str(notes), {"p12"}), key, after=lambda done: beats.append(done.count()))
    assert asked() == list(range(10)) and beats == [5, 5, 5]
    assert sorted_rows(runs.recorded(spark, path, key).groupBy("status").count(), "status", "count") == [("failed", 5), ("success", 10)]
    (notes / "well").touch()
    out = runs.extract_durably(spark, path, provider_in(str(notes), set()), key)
    assert asked() == list(range(20))
    assert sorted_rows(out, "window", "status") == [(w, "success") for w in range(20)]
    again = runs.extract_durably(spark, path, provider_in(str(notes), set()), key)
    assert asked() == list(range(20)) and again.count() == 20


def test_known_inputs_are_not_asked(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "well").touch()
    windows = spark.createDataFrame([(d, w, "p1", "same") for d in ("a", "b") for w in range(12)], "document_id string, window int, prompt string, input_hash string")
    path, key = f"{tmp_path}/job", ["document_id", "window"]
    runs.prepare_windows(windows, path, size=5)
    out = runs.extract_durably(spark, path, provider_in(str(notes), set()), key)
    assert len(os.listdir(notes)) == 2 and out.count() == 24 and math.isclose(out.where("cached").count(), 24, abs_tol=10)


# -- table function ----------------------------------------------------------------------------------------------------


def test_split_text_in_sql(spark):
    from tessera.functions import tables

    tables.register(spark)
    rows = spark.sql("SELECT k, part, part_count, part_text FROM VALUES (1, 'ab\\ncdef'), (2, NULL), (3, '  '), (4, 'x') AS t(k, text), LATERAL split_text(text, 4)")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 1, 2, "ab"), (1, 2, 2, "cdef"), (4, 1, 1, "x")]
    assert spark.sql("SELECT * FROM split_text('short')").columns == ["part", "part_count", "part_text"]
    for bad in ("split_text(5)", "split_text('a', 0)", "split_text('a', 'b')"):
        with pytest.raises(Exception, match="split_text"):
            spark.sql(f"SELECT * FROM {bad}").collect()


# -- batches of requests -----------------------------------------------------------------------------------------------


def test_batches_from_submission_to_results(spark):
    """One batch is refused, one breaks down when it is polled, one comes back; only its documents are driven on."""
    batches = spark.createDataFrame([(b, None, "submitting") for b in (1, 2, 3)], "batch_id int, provider_batch_id string, processing_status string")
    rows = [(f"d{b}", 1, f"h{b}{k}", "submitting", 1, b, f"p{b}{k}") for b in (1, 2, 3) for k in range(2)]
    items = spark.createDataFrame(rows, "document_id string, source_version int, input_hash string, status string, submit_attempts int, batch_id int, prompt string")

    def submit(requests):
        if requests[0][1].startswith("p2"):
            raise ConnectionError("refused")
        return f"x{requests[0][0]}"

    answers = runs.submit_batches(batches, items, submit)
    assert sorted_rows(answers, "batch_id", "provider_batch_id", "error") == [(1, "xh10", None), (2, None, "ConnectionError: refused"), (3, "xh30", None)]
    batches, items = runs.settle_batches(batches, items, answers)
    assert sorted_rows(items.select("batch_id", "status").distinct().fillna(0), "batch_id", "status") == [(0, "pending"), (1, "submitted"), (3, "submitted")]

    def retrieve(batch, hashes):
        if batch == "xh10":
            raise TimeoutError("slow")
        return "ended", [{"input_hash": h, "result_type": "succeeded", "parsed": True, "valid": h.endswith("0")} for h in hashes]

    polled = runs.poll_batches(batches, items, retrieve)
    none = items.limit(0).select("document_id", "source_version", "input_hash")
    after, out, done = runs.ingest_polled(batches, items, none, polled)
    assert sorted_rows(after, "batch_id", "processing_status") == [(1, "submitted"), (2, "failed"), (3, "ended")]
    assert sorted_rows(out.where("run_status IS NOT NULL"), "input_hash", "status", "run_status") == [("h30", "succeeded", "success"), ("h31", "rejected", "rejected")]
    assert sorted_rows(done, "document_id", "source_version") == [("d3", 1)]
    again = runs.ingest_polled(after, out.drop("run_status"), none, runs.poll_batches(after, out, retrieve))
    assert again[2].count() == 0 and again[1].where("run_status IS NOT NULL").count() == 0


def test_vector_index_over_many_tasks(spark, tmp_path):
    """Queries and rows of a cell meet in one task, also where no small tasks are joined into one."""
    chunks, queries = clustered(spark)
    path = f"{tmp_path}/index"
    vector_index.build(chunks, path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted_rows(vector_index.vector_leg(path, queries, 7), "query_id", "chunk_id", "rank")
        assert got == sorted_rows(search.vector_leg(chunks, queries, 7), "query_id", "chunk_id", "rank")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
