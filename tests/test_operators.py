import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import catalog, editing, evaluation, ground, ingest, lifecycle, search


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_titles_and_queries(spark):
    df = spark.createDataFrame([("Crème  Brûlée",), ("“Bob’s” soup–stew",), (None,)], "t string")
    assert [r[0] for r in df.select(X.normalize_title("t")).collect()] == ["creme brulee", '"bob\'s" soup-stew', None]
    assert df.select(X.normalize_query(F.lit("  Two  WORDS! "))).first()[0] == "two words!"


def test_minutes(spark):
    cases = {"45": 45.0, "PT1H30M": 90.0, "PT90S": 1.5, "1.5 hours": 90.0, "2 h and 5m": 125.0, "1 hour 15 minutes": 75.0, "2 hrs": 120.0, "soon": None, "pt": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", X.parse_minutes(F.col("t"))).collect()} == cases


def test_split_text():
    assert X.split_text("a" * 10, 4) == ["aaaa", "aaaa", "aa"]
    assert X.split_text("éé é", 4) == ["éé", " é"]
    assert X.split_text("one\n\ntwo\n\nthree", 9) == ["one\n\ntwo", "three"]
    assert X.split_text(" \n\n ", 2) == []
    assert all(len(p.encode()) <= 50 for p in X.split_text("word é " * 100, 50))


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "filing": "file", "agreed": "agre", "happy": "happi", "adjustment": "adjust", "running": "run", "cats": "cat"}
    assert {w: X.stem(w) for w in pairs} == pairs


def test_labels_and_ingredients(spark):
    df = spark.createDataFrame([(1, 1, "1 1/2 cups flour"), (2, 4, "3/4 tsp. salt"), (None, 3, "eggs")], "a int, b int, line string")
    assert [r[0] for r in df.select(X.page_label(F.col("a"), F.col("b"))).collect()] == ["page 1", "pages 2–4", ""]
    parsed = [tuple(r[0]) for r in df.select(X.ingredient_parts(F.col("line"))).collect()]
    assert parsed == [(1.5, "cup", "flour", None), (0.75, "teaspoon", "salt", None), (None, None, "eggs", None)]
    more = spark.createDataFrame([("• 1½ tbsp. olive oil, warmed, not hot",), ("½ onion.",), ("2 cans",), ("12/4 sticks butter",)], "line string")
    assert [tuple(r[0]) for r in more.select(X.ingredient_parts(F.col("line"))).collect()] == [(1.5, "tablespoon", "olive oil", "warmed, not hot"), (0.5, None, "onion", None), (2.0, "can", None, None), (3.0, "stick", "butter", None)]


def test_windows(spark):
    for n, want in {0: [], 1: [(1, 1)], 3: [(1, 3)], 5: [(1, 3), (3, 5)], 9: [(1, 3), (3, 5), (5, 7), (7, 9)]}.items():
        df = spark.createDataFrame([("d", k) for k in range(1, n + 1)], "d string, page int")
        got = [(r["rows"][0]["page"], r["rows"][-1]["page"]) for r in ingest.windows(df, "d", "page", ["page"]).orderBy("window").collect()]
        assert got == want
    with pytest.raises(ValueError):
        ingest.windows(df, "d", "page", ["page"], 3, 3)


def legs(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, item_id string, chunk_type string, rank int")


def test_fusion_values(spark):
    k = legs(spark, [(1, "a", "i", "recipe_title", 1), (1, "b", "j", "recipe_full", 2)])
    v = legs(spark, [(1, "b", "j", "recipe_full", 5), (1, "c", "j", "unknown", 1)])
    got = {r["chunk_id"]: (r["score"], r["sources"]) for r in search.fuse(k, v).collect()}
    assert math.isclose(got["a"][0], 1.40 / 61) and got["a"][1] == ["keyword"]
    assert math.isclose(got["b"][0], 0.95 / 62 + 1.10 / 65) and got["b"][1] == ["keyword", "vector"]
    assert math.isclose(got["c"][0], 1 / 61)


def test_groups_and_bonus(spark):
    types = ["recipe_full", "recipe_title", "recipe_summary", "recipe_ingredients", "recipe_steps"]
    rows = [(1, f"{n}{t}", f"item{n}", types[t], 1.0, ["keyword"]) for n in range(1, 6) for t in range(n)]
    merged = spark.createDataFrame(rows, "query_id int, chunk_id string, item_id string, chunk_type string, score double, sources array<string>")
    got = {r["item_id"]: round(r["item_score"] - 1, 6) for r in search.group_items(merged).collect()}
    assert got == {"item1": 0.0, "item2": 0.05, "item3": 0.10, "item4": 0.15, "item5": 0.15}


def test_rerank(spark):
    merged = spark.createDataFrame([(1, "a", "i", 0.5), (1, "b", "i", 0.4), (1, "c", "i", 0.3), (2, "d", "i", 0.2)], "query_id int, chunk_id string, item_id string, score double")
    listed = spark.createDataFrame([(1, 0, "nope"), (1, 1, "c"), (1, 2, "a"), (1, 3, "c"), (2, 0, "nope")], "query_id int, pos int, chunk_id string")
    got = {r["chunk_id"]: r["score"] for r in search.apply_rerank(merged, listed).collect()}
    assert got == {"a": 1.5, "b": 0.4, "c": 2.5, "d": 0.2}


def test_keyword_order(spark):
    rows = [("dense", "lemon tart and lemon curd tart"), ("sparse", "lemon cake with a long story before the tart"), ("none", "apple pie"), ("half", "lemon pie")]
    chunks = spark.createDataFrame([(c, c, "recipe_full", t) for c, t in rows], "chunk_id string, item_id string, chunk_type string, t string").withColumn("lexemes", X.lexemes("t"))
    asked = spark.createDataFrame([(1, "lemons & tarts!"), (2, "the of")], "query_id int, q string").select("query_id", F.array_distinct(F.transform(X.lexemes("q"), lambda x: x["lexeme"])).alias("terms"))
    got = [(r["query_id"], r["rank"], r["chunk_id"]) for r in search.keyword_leg(chunks, asked).orderBy("rank").collect()]
    assert got == [(1, 1, "dense"), (1, 2, "sparse")]


def test_vector_spaces_and_zero(spark):
    rows = [("same", "p", [1.0, 0.0]), ("far", "p", [0.0, 1.0]), ("zero", "p", [0.0, 0.0]), ("other", "q", [1.0, 0.0]), ("wrong", "p", [1.0])]
    chunks = spark.createDataFrame([(c, c, "t", m, "m", v) for c, m, v in rows], "chunk_id string, item_id string, chunk_type string, provider string, model string, embedding array<double>")
    asked = spark.createDataFrame([(1, "p", "m", [1.0, 0.0])], "query_id int, provider string, model string, vector array<double>")
    for block in (1024, 1):
        assert [(r["chunk_id"], r["distance"]) for r in search.vector_leg(chunks, asked, 5, block).orderBy("rank").collect()] == [("same", 0.0), ("far", 1.0)]


def test_transitions(spark):
    docs = spark.createDataFrame([(1, "queued"), (2, "ready"), (3, "indexing"), (4, "queued")], "document_id int, status string")
    commands = spark.createDataFrame([(1, "extracting_text"), (2, "indexing"), (3, "ready")], "document_id int, to_status string")
    assert values(lifecycle.transition(docs, commands).fillna(False, ["applied"]), "document_id", "status", "applied") == [(1, "extracting_text", True), (2, "ready", False), (3, "ready", True), (4, "queued", False)]


def test_batch_results(spark):
    items = spark.createDataFrame([(1, 1, h, s, n) for h, s, n in [("a", "submitted", 1), ("b", "submitted", 1), ("c", "submitted", 1), ("d", "submitted", 2), ("e", "pending", 0), ("f", "submitted", 1)]], "document_id int, source_version int, input_hash string, status string, submit_attempts int")
    results = spark.createDataFrame([("a", "succeeded", True, True, False), ("b", "succeeded", False, False, False), ("c", "expired", False, False, False), ("d", "errored", False, False, True), ("e", "succeeded", True, True, False), ("f", "succeeded", True, True, False)], "input_hash string, result_type string, parsed boolean, valid boolean, retryable boolean")
    runs = spark.createDataFrame([(1, 1, "f")], "document_id int, source_version int, input_hash string")
    got = {r["input_hash"]: (r["new_status"], r["run_status"]) for r in lifecycle.batch_results(items, results, runs).collect()}
    assert got == {"a": ("succeeded", "success"), "b": ("rejected", "rejected"), "c": ("pending", None), "d": ("rejected", "rejected"), "e": ("pending", None), "f": ("succeeded", None)}


def test_hand_off_is_forward_only(spark):
    docs = spark.createDataFrame([(1, 2, 3), (2, 2, None), (3, 2, 1)], "document_id int, version int, active_version int")
    items = spark.createDataFrame([(10, 1, 2, "ready"), (20, 2, 2, "ready"), (30, 3, 2, "needs_review")], "item_id int, document_id int, source_version int, status string")
    chunks = spark.createDataFrame([(10,), (20,), (30,)], "item_id int")
    assert values(lifecycle.hand_off(docs, items, chunks, True), "document_id", "status", "active_version") == [(1, "ready", 3), (2, "ready", 2), (3, "needs_review", 1)]


def test_metrics_of_known_run(spark):
    run = spark.createDataFrame([("q1", f"x{r}", r) for r in (1, 2)] + [("q1", "hit", 3), ("q2", "hit", 8)], "query_id string, item_id string, rank int")
    qrels = spark.createDataFrame([("q1", "hit", 1), ("q2", "hit", 1), ("q3", "hit", 1), ("q4", "hit", 0)], "query_id string, item_id string, relevance int")
    got = {r["query_id"]: (round(r["ndcg_10"], 6), r["recall_5"], r["recall_10"], round(r["recip_rank"], 6)) for r in evaluation.ir_metrics(run, qrels).collect()}
    assert got == {"q1": (0.5, 1.0, 1.0, 0.333333), "q2": (round(1 / math.log2(9), 6), 0.0, 1.0, 0.125), "q3": (0, 0, 0, 0), "q4": (0, 0, 0, 0)}


def test_alignment(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c", "b"]), (["a", "a"], ["b", "a", "a"]), (None, ["a"])], "e array<string>, f array<string>")
    got = [[tuple(p) for p in r[0]] for r in df.select(evaluation.align_ingredients("e", "f")).collect()]
    assert got == [[(0, 0), (1, 2), (2, 1)], [(0, 2), (1, 1)], []]


def test_edited_lines(spark):
    items = spark.createDataFrame([(1, [(1, "salt", 1.0, 0.3, False), (2, "salt", 2.0, 0.4, False), (3, "egg", 3.0, 0.5, False), (4, None, 4.0, 0.5, False)]), (2, None)], "item_id int, ingredients array<struct<position:int,raw_text:string,quantity:double,normalization:double,edited:boolean>>")
    edits = spark.createDataFrame([(1, ["salt", "new", "salt", "salt"]), (2, ["egg"]), (3, [])], "item_id int, lines array<string>")
    got = {r["item_id"]: [tuple(x) for x in r["rows"]] for r in editing.matched_lines(items, edits, "ingredients", "raw_text", "position").collect()}
    assert got == {1: [(1, "salt", 1.0, 0.3, False), (2, "new", None, 1.0, True), (3, "salt", 2.0, 0.4, False), (4, "salt", None, 1.0, True)], 2: [(1, "egg", None, 1.0, True)], 3: []}


def test_courses(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "a", 0.9), (1, 2, "b", 0.5), (1, 1, "c", 0.8)], "request_id int, course int, item_id string, score double")
    assert values(ground.assign_courses(rows, 1), "course", "item_id") == [(1, "a"), (2, "b")]
    plans = spark.createDataFrame([(1, [(" Main ", "fish"), ("main", "meat"), ("", "x"), ("dessert", "cake")]), (2, [])], "request_id int, courses array<struct<slot:string,query:string>>")
    assert values(ground.plan_courses(plans), "request_id", "course", "slot", "query") == [(1, 1, "main", "fish"), (1, 2, "dessert", "cake"), (2, 1, "main", "")]
