"""Work that grows no faster than the tables."""

import json
import random

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from tessera.functions import tables
from tessera.functions import text as X
from tessera.operators import evaluation, ingest, packing, payloads


def analyzed(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_payloads_are_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "j string")
    for told in (payloads.report_problems(F.col("j")), payloads.golden_problems(F.col("j"), F.lit("s1"))):
        assert analyzed(df.select(told.alias("p"))).lower().count("parse_json") <= 2  # one call, and maybe the column's name


def test_odd_payloads(spark):
    """Values of all kinds at every level."""
    report = lambda run, queries: json.dumps({"run": run, "aggregate": 1, "per_query": queries})
    odd = [None, "", "null", "5", "[]", '{"run": null}', "{", report([], []), report({"k": 1.5, "limit": True}, {"a": 1, "b": {"metrics": {"ndcg_cut_10": 1}, "expected_item_ranks": {"x": None, "y": 0}}})]
    df = spark.createDataFrame(list(enumerate(odd)), "k int, j string")
    got = {r["k"]: (r["r"], r["g"]) for r in df.select("k", payloads.report_problems(F.col("j")).alias("r"), payloads.golden_problems(F.col("j"), F.lit("s1")).alias("g")).collect()}
    nothing = ["run is missing", "aggregate is missing", "per_query is missing or empty"]
    assert [got[k][0] for k in range(8)] == [nothing] * 8
    assert got[8][0] == [
        *[f"run.{k} is missing" for k in ("query_set", "mode", "reranking_enabled", "embedding_model")], "run.k is no positive whole number", "run.limit is no positive whole number", "aggregate is missing",
        "a query's ndcg_cut_10 is no finite number", "a query has no expected_item_ranks", "a rank is no positive whole number",
    ]
    assert all(g[0] == "recipe: missing keys" and "steps: must not be empty" in g and "source_span_ids: must be the one span" in g for _, g in got.values())


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def chunk_items(spark, texts):
    none = F.lit(None).cast("string")
    return spark.createDataFrame(list(enumerate(texts)), "item_id int, body_text string").select("*", *[none.alias(k) for k in ("title", "summary", "ingredients_text", "steps_text")])


def test_texts_are_split_once_and_short_ones_not_in_python(spark):
    """Long texts reach Python once and not by Arrow batches, whose bytes nothing bounds; short and blank ones don't."""
    texts = ["short", None, " \u2003\n", " " * 50, "word é " * 30, "one\n\ntwo", "x" * 41]
    out = ingest.build_chunks(chunk_items(spark, texts), 40)
    assert optimized(out).count("BatchEvalPython") == 1 and "ArrowEvalPython" not in optimized(out)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["item_id"], r["part"])):
        got.setdefault(r["item_id"], []).append(r["text"])
        assert r["chunk_type"] == "recipe_full" and r["part_count"] == len(X.split_text(texts[r["item_id"]], 40))
    assert got == {k: X.split_text(t, 40) for k, t in enumerate(texts) if t and t.strip()}


def test_present(spark):
    blank = [None, "", " ", "\t\n\x0b\f\r", "\u00a0\u2003\u3000\u0085"]
    df = spark.createDataFrame([(t,) for t in [*blank, " x", "\u200b", "0"]], "t string")
    assert [r[0] for r in df.select(X.is_present(F.col("t"))).collect()] == [False] * len(blank) + [True] * 3


def test_long_queues_stay_spread(spark):
    """One queue of many chunks is numbered by as many tasks as there are partitions; no join brings all its rows together."""
    rows = spark.range(4000).selectExpr("if(id < 3990, 'long', if(id < 3995, NULL, 'z')) AS queue", "id AS n", "id % 7 AS size")
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = packing.pack(rows, "queue", ["n"], "size", 10, 25, 64)
        spread = {r["p"]: r["count"] for r in out.where("queue = 'long'").groupBy(F.spark_partition_id().alias("p")).count().collect()}
        got = {(r["queue"], r["n"]): r["batch"] for r in out.collect()}
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want, state = {}, {}
    for n in range(4000):
        queue, size = "long" if n < 3990 else None if n < 3995 else "z", n % 7
        batch, count, total = state.get(queue, (0, 0, 0))
        batch, count, total = (batch + 1, 1, size) if count and (count == 10 or total + size > 25) else (batch, count + 1, total + size)
        state[queue], want[queue, n] = (batch, count, total), batch
    assert got == want
    assert len(spread) == 4 and max(spread.values()) < 3990 / 2, spread


def test_split_text_takes_rows_as_they_are(spark):
    """A table function over Arrow would build a table for each text."""
    tables.register(spark)
    out = spark.sql("SELECT k, part, part_count, part_text FROM VALUES (1, 'ab\ncdef'), (2, NULL), (3, '  '), (4, 'x') AS t(k, text), LATERAL split_text(text, 4)")
    assert "ArrowEvalPythonUDTF" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, 1, 2, "ab"), (1, 2, 2, "cdef"), (4, 1, 1, "x")]


def test_ingredients_are_aligned_from_plain_lists(spark):
    """Names reach Python as Arrow lists of strings, not as an object for each ingredient; the pairs are those of the plain rule."""
    assert evaluation.align_lines.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    rng = random.Random(5)
    name = lambda: rng.choice([None, "", " A", "a ", "b", "c", "d"])
    side = lambda: None if rng.random() < 0.05 else [(name(), name()) for _ in range(rng.randrange(8))]
    rows = [(k, side(), side()) for k in range(400)]
    line = "array<struct<item_normalized:string,raw_text:string>>"
    df = spark.createDataFrame(rows, f"k int, e {line}, f {line}")
    lists = [evaluation._identities(F.col(c), n) for c in "ef" for n in ("item_normalized", "raw_text")]
    got = {r["k"]: [tuple(p) for p in r["p"]] for r in df.select("k", evaluation.align_lines(*lists).alias("p")).collect()}
    for k, e, f in rows:
        clean = lambda x: [tuple((n or "").strip().lower() or None for n in i) for i in x or []]
        e, f = clean(e), clean(f)
        same = lambda a, b: any(x is not None and x == y for x, y in zip(e[a], f[b]))
        pairs = [(a, a) for a in range(min(len(e), len(f))) if same(a, a)]
        for b in range(len(f)):
            left = [a for a in range(len(e)) if a not in [x for x, _ in pairs] and same(a, b)]
            if left and b not in [y for _, y in pairs]:
                pairs.append((left[0], b))
        assert got[k] == sorted(pairs), (e, f)


def test_plain_titles(spark):
    """Titles without anything to fold come out as by the whole rule."""
    df = spark.createDataFrame([(" A\tB\x1c c ",), ("",), ("A B’s",)], "t string")
    assert [r[0] for r in df.select(X.normalize_title("t")).collect()] == ["a b c", "", "a b's"]


def test_recipes_of_a_report_are_scored_once(spark):
    """Neither sum of a report works the recipes' scores out again."""
    scored = F.struct(*[F.lit(1.0).alias(k) for k in evaluation.SCORES])
    rows = spark.range(4).select(F.when(F.col("id") > 0, scored).alias("scores"), X.normalize_title(F.lit("0.5")).cast("double").alias("confidence"), F.array(F.lit("steps")).alias("missing"))
    out = evaluation.extraction_summary(rows)
    assert "EvalPython" not in optimized(out)
    got = {r["metric"]: r["value"] for r in out.collect()}
    assert (got["count.fixtures"], got["count.success"], got["mean_confidence"], got["accuracy.yield"], got["count.missing.steps"]) == (4, 3, 0.5, 1, 3)
    assert evaluation.extraction_summary(rows.limit(0)).where("metric = 'count.fixtures'").first()["value"] == 0
