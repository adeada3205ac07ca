import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, evaluation, ground, ingest, lifecycle, results, review, runs, search
from tessera.sources import files

GOLDEN = {
    "item_type": "recipe", "title": "Soup", "source_span_ids": ["s1"],
    "structured_data": {"schema": "recipe.v1", "yield": None, "prep_time": "10 min", "cook_time": None, "total_time": None, "ingredients": [{"raw_text": "1 egg", "quantity_value": 1, "unit_normalized": None, "item_normalized": "egg", "preparation": None}], "steps": [{"text": "boil"}]},
}


def changed(path, value, drop=False):
    out = json.loads(json.dumps(GOLDEN))
    at = out
    for k in path[:-1]:
        at = at[k]
    if drop:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def test_goldens(spark):
    s = "structured_data"
    cases = [
        (GOLDEN, []), (changed(["title"], " "), ["title: must not be empty"]), (changed(["title"], None, True), ["recipe: missing keys", "title: must not be empty"]), (changed(["extra"], 1), ["recipe: unknown keys"]),
        (changed([s, "cook_time"], "soon"), ["cook_time: no duration"]), (changed([s, "steps"], []), ["steps: must not be empty"]), (changed([s, "ingredients", 0, "item_normalised"], "egg"), ["ingredients: missing or unknown keys"]),
        (changed(["source_span_ids"], ["s2"]), ["source_span_ids: must be the one span"]), (changed([s, "schema"], "v2"), ["schema: must be recipe.v1"]), (changed([s, "ingredients", 0, "quantity_value"], "much"), ["ingredients: a quantity is no number"]),
    ]
    df = spark.createDataFrame([(k, json.dumps(g)) for k, (g, _) in enumerate(cases)], "k int, g string")
    got = {r["k"]: r["p"] for r in df.select("k", evaluation.golden_problems(F.col("g"), F.lit("s1")).alias("p")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_report_shapes(spark):
    good = {"run": {"query_set": "t", "mode": "hybrid", "k": 10, "limit": 20, "reranking_enabled": False, "embedding_model": "m"}, "aggregate": {m: 0.5 for m in evaluation.METRICS}, "per_query": {"q1": {"metrics": {"ndcg_cut_10": 0.5}, "expected_item_ranks": {"a": 3, "b": None}}}}
    bad = json.loads(json.dumps(good))
    bad["run"]["k"], bad["aggregate"]["recall_5"], bad["per_query"]["q1"]["expected_item_ranks"]["a"] = 0, "NaN", -1
    del bad["run"]["mode"]
    df = spark.createDataFrame([(0, json.dumps(good)), (1, json.dumps(bad)), (2, "{}")], "k int, j string")
    got = {r["k"]: r["p"] for r in df.select("k", evaluation.report_problems(F.col("j")).alias("p")).collect()}
    assert got[0] == [] and got[1] == ["run.mode is missing", "run.k is no positive whole number", "aggregate.recall_5 is no finite number", "a rank is no positive whole number"]
    assert got[2] == ["run is missing", "aggregate is missing", "per_query is missing or empty"]


def test_judges(spark):
    rows = spark.createDataFrame([("a", "good"), ("b", "known"), ("c", "odd"), ("a", "good")], "judge_key string, prompt string")
    cache = spark.createDataFrame([("b", "fail", "old"), ("z", "pass", "other")], "judge_key string, rating string, critique string")
    answer = lambda prompts: ['{"rating": "pass", "critique": "fine"}' if p == "good" else '{"rating": "maybe"}' for p in prompts]
    got = {r["judge_key"]: (r["rating"], r["critique"], r["problem"], r["cached"]) for r in evaluation.judge(rows, cache, answer).collect()}
    assert got == {"a": ("pass", "fine", None, False), "b": ("fail", "old", None, True), "c": (None, None, "no valid verdict", False)}
    broken = evaluation.judge(rows.limit(1), cache.limit(0), lambda prompts: 1 / 0).first()
    assert broken["rating"] is None and broken["problem"].startswith("ZeroDivisionError")
    key = spark.range(1).select(evaluation.judge_key(*[F.lit(x) for x in evaluation.JUDGE_KEY]).alias("k")).first()["k"]
    assert key.startswith("fixture-set__fixture-id__") and len(key.rsplit("--", 1)[1]) == 32


def test_ingredient_slots(spark):
    line = "raw_text string, quantity_value double, unit_normalized string, item_normalized string, preparation string"
    egg, salt = ("1 egg", 1.0, None, "egg", None), ("salt", None, None, None, None)
    df = spark.createDataFrame([([egg, salt], [("Salt ", None, None, None, None), ("2 eggs", 2.0, None, "EGG", None)]), ([], []), ([egg], None), (None, [egg])], f"e array<struct<{line.replace(' ', ':').replace(',:', ',')}>>, f array<struct<{line.replace(' ', ':').replace(',:', ',')}>>")
    got = [r["detail"] for r in evaluation.ingredient_detail(df, "e", "f").collect()]
    assert (got[0]["precision"], got[0]["recall"], got[0]["matched"]) == (0.8, 0.8, 2) and got[0]["accuracy"]["quantity_value"] == 0.5
    assert got[1]["f1"] == 1.0 and got[2]["f1"] == got[3]["f1"] == 0.0 and got[2]["unmatched_expected"] == got[3]["unmatched_found"] == 1


def test_commands_that_repeat(spark):
    docs = spark.createDataFrame([(1, "queued"), (2, "ready")], "document_id int, status string")
    commands = spark.createDataFrame([(1, "failed", 2), (1, "extracting_text", 1), (2, "indexing", 1)], "document_id int, to_status string, at int")
    assert sorted(tuple(r) for r in lifecycle.transition(docs, commands).select("document_id", "status", "applied").collect()) == [(1, "extracting_text", True), (2, "ready", False)]
    assert lifecycle.transition(docs, commands.drop("at")).count() == 2
    stars = catalog.add_favourites(spark.createDataFrame([(1, 5)], "item_id int, created_at int"), spark.createDataFrame([(1, 1), (2, 9), (2, 7)], "item_id int, created_at int"))
    assert sorted(tuple(r) for r in stars.collect()) == [(1, 5), (2, 7)]


def test_spaces_must_agree(spark):
    queries = spark.createDataFrame([(1, "p", "m", [1.0])], "query_id int, provider string, model string, vector array<double>")
    assert results.check_space(queries, "p", "m").count() == 1
    with pytest.raises(Exception, match="not of the space"):
        results.check_space(queries, "p", "other").collect()
    with pytest.raises(ValueError):
        results.search_items(queries, None, None, "both")


def test_nearest_in_batches(spark):
    """Local winners of many small batches are those of all rows; ties fall to the smaller id."""
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, (400, 4)).astype(float)
    chunks = spark.createDataFrame([(k, k, "t", "p", "m", v.tolist()) for k, v in enumerate(vectors)], "chunk_id int, item_id int, chunk_type string, provider string, model string, embedding array<double>").repartition(7)
    queries = spark.createDataFrame([(k, "p", "m", vectors[k * 40 + 1].tolist()) for k in range(9)], "query_id int, provider string, model string, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = search.vector_leg(chunks, queries, 6, 4).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    norms = np.linalg.norm(vectors, axis=1)
    for k in range(9):
        with np.errstate(invalid="ignore", divide="ignore"):
            far = 1 - vectors @ vectors[k * 40 + 1] / (norms * norms[k * 40 + 1])
        order = sorted((round(d, 12), i) for i, d in enumerate(far) if np.isfinite(d))[:6]
        assert [(round(r["distance"], 12), r["chunk_id"]) for r in got if r["query_id"] == k] == order or norms[k * 40 + 1] == 0


def test_details_and_rerank_head(spark):
    merged = spark.createDataFrame([(1, f"c{k}", "i", "recipe_full", 1.0 / (k + 1), ["keyword"]) for k in range(4)], "query_id int, chunk_id string, item_id string, chunk_type string, score double, sources array<string>")
    texts = spark.createDataFrame([(f"c{k}", "x" * 50) for k in range(4)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "what")], "query_id int, question string")
    seen = lambda q, listed: [c for c, t in listed if len(t) == 10][::-1]
    got = {r["chunk_id"]: r["score"] for r in results.rerank(merged, texts, asked, seen, 2, 10).collect()}
    assert got["c1"] == 3.0 and got["c0"] == 2.0 and got["c3"] == 0.25


def test_review_and_authored(spark):
    t = spark.range(1).select(review.resolve_thresholds(F.lit(None).cast("struct<overall:double,boundary:double,normalization:double,min_chars:int,max_chars:int,assembly_min:int,assembly_max:int,assembly_chars:int>")).alias("t")).first()["t"]
    assert t["source"] == "current" and t["values"]["min_chars"] == ingest.THRESHOLDS["min_chars"]
    row = review.authored(spark.createDataFrame([("i", "Tart", ["flour", " ", "butter", "eggs"], [])], "item_id string, title string, ingredients array<string>, steps array<string>")).first()
    assert row["body_text"] == "Tart\n\nflour\nbutter\neggs" and row["status"] == "indexing" and row["warnings"] == [] and row["notes"] == ["assembly"]


def test_failures_and_batches(spark):
    docs = spark.createDataFrame([(1, "indexing"), (2, "ready")], "document_id int, status string")
    none = spark.createDataFrame([], "document_id int, last_status string, reason string, error_message string, failed_at int")
    failed = spark.createDataFrame([(1, "LLMTechnicalError", "x", 2), (1, "Odd", "y", 1), (2, "Odd", "z", 1), (9, "Odd", "z", 1)], "document_id int, error string, message string, failed_at int")
    after, failures = runs.mark_failed(docs, none, failed)
    assert sorted(tuple(r) for r in after.collect()) == [(1, "failed"), (2, "ready")] and [tuple(r) for r in failures.collect()] == [(1, "indexing", "unknown_error", "y", 1)]


def test_footer_and_over_fetch(spark):
    pack = spark.createDataFrame([(1, "b", 2, 1, "cite_2", "ctx_2"), (1, "a", 1, 1, "cite_1", "ctx_1"), (1, "a", 1, 2, "cite_1", "ctx_1")], "query_id int, item_id string, item_place int, chunk_place int, cite_id string, ctx_id string")
    assert ground.allowed_ids(pack).first()["footer"] == "Allowed citation IDs: cite_1, cite_2\nAllowed knowledge_item_ids: a, b"
    assert [ground.over_fetch(k) for k in (5, 1, 0)] == [10, 2, 1]


def test_stored_files_and_reports(spark, tmp_path):
    store = f"{tmp_path}/store"
    one = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")
    files.put_files(one, store)
    files.put_files(spark.createDataFrame([("a", bytearray(b"9")), ("c", bytearray(b"3"))], one.schema), store)
    for bad in ("../a", "/a", "a/../b", "a//b", "", "c:x", "a\\b", "a\n", "./a"):
        with pytest.raises(Exception, match="unsafe path"):
            files.put_files(spark.createDataFrame([(bad, bytearray(b"x"))], one.schema), f"{store}-bad")
    assert not files.has_files(spark, f"{store}-bad") or spark.read.schema(one.schema).parquet(f"{store}-bad").count() == 0
    left = files.delete_files(spark.read.parquet(store), spark.createDataFrame([("b",), ("zz",)], "path string"))
    assert sorted((r["path"], bytes(r["content"])) for r in left.collect()) == [("a", b"1"), ("c", b"3")]
    rows = spark.createDataFrame([("q", 0.5)], "query_id string, ndcg_10 double")
    folder = f"{tmp_path}/reports"
    assert files.latest_run(spark, folder) is None
    for name in ("2024-01-01", "2024-02-01"):
        path = files.write_report(rows, folder, name)
    assert files.latest_run(spark, folder) == path
    assert files.update_report(spark, path, "review", rows) == f"{path}.review" and files.latest_run(spark, folder) == path
    assert files.read_summary(spark, path) is None
    files.append_summary(spark, path, "# Run\n")
    files.append_summary(spark, path, "more")
    assert files.read_summary(spark, path) == "# Run\nmore\n" and files.latest_run(spark, folder) == path
    files.write_items(spark.createDataFrame([("Apple Pie!", "good"), ("soup", "thin")], "name string, note string"), path, "name", "note")
    assert sorted((r["item"], r["value"]) for r in spark.read.text(f"{path}.items").collect()) == [("apple-pie", "good"), ("soup", "thin")]
    with pytest.raises(ValueError):
        files.update_report(spark, files.write_report(rows, folder, "2024-03-01", "failed"), "summary", rows)
    assert files.read_alignment(spark, f"{tmp_path}/none").count() == 0
    records = spark.createDataFrame([("f", "pass", "fail", "disagree", "v1", "h")], files.ALIGNMENT)
    files.write_alignment(records, f"{tmp_path}/aligned", "r1")
    assert files.read_alignment(spark, f"{tmp_path}/aligned/r1").collect() == records.collect()


def test_fixtures_and_cuts(spark, tmp_path):
    root = tmp_path / "set"
    for name, parts in {"a": {"source.md": "soup", "expected.json": '{"title": "Soup"}', "notes.md": "Verification: draft"}, "b": {"source.md": "pie", "expected.json": '{"title": "Pie"}'}}.items():
        (root / name).mkdir(parents=True)
        for file, text in parts.items():
            (root / name / file).write_text(text)
    got = files.read_fixtures(spark, str(root), "title string").orderBy("name").collect()
    assert [(r["name"], r["source"], r["expected"]["title"], r["notes"]) for r in got] == [("a", "soup", "Soup", "Verification: draft"), ("b", "pie", "Pie", None)]
    pages = spark.createDataFrame([("x", k, f"p{k}") for k in range(1, 5)], "book string, page int, text string")
    ranges = spark.createDataFrame([("s", "x", 2, 3, "two")], "set string, book string, first int, last int, name string")
    files.publish_cuts(pages, ranges, f"{tmp_path}/cuts")
    assert spark.read.json(f"{tmp_path}/cuts").first()["text"] == "p2\n\np3"
    with pytest.raises(ValueError, match="no range"):
        files.publish_cuts(pages, ranges.union(spark.createDataFrame([("s", "x", 3, 9, "more")], ranges.schema)), f"{tmp_path}/cuts2")
    with pytest.raises(ZeroDivisionError):
        files.run_report(lambda: 1 / 0, f"{tmp_path}/runs", "r1", spark)
    assert spark.read.json(f"{tmp_path}/runs/r1").first()["run_status"] == "failed"


def test_embedding_requests(spark):
    """Requests keep to both caps; known chunks of the space are not sent again."""
    chunks = spark.createDataFrame([(k, "x" * 4000 if k == 5 else "ж" * 18 if k == 7 else "x" * 36) for k in range(12)], "chunk_id int, text string").coalesce(1)
    known = spark.createDataFrame([(0, "p", "m"), (1, "p", "old")], "chunk_id int, provider string, model string")
    out = ingest.embed_chunks(chunks, known, lambda texts: [[float(len(texts)), float(sum(len(t.encode()) for t in texts))] for t in texts], ("p", "m"), 4, 150).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in out] == list(range(1, 12))
    assert all(r["embedding"][0] <= 4 and (r["embedding"][1] <= 150 or r["embedding"][0] == 1) for r in out)
