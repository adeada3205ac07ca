"""Evaluation: retrieval metrics, field scores, ingredient alignment, calibration, agreement, differences of reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators.payloads import INGREDIENT_KEYS as SUB_FIELDS
from tessera.operators.payloads import METRICS, TIMES, golden_problems, report_problems  # noqa: F401
from tessera.sources import scratch

TOLERANCE, SLACK, HEADLINE, RANK_DROP = 0.01, 1e-9, 0.005, 3


def fold_qrels(qrels: DataFrame) -> DataFrame:
    """qrels: (query_id, item_id, relevance, line): the later of duplicate lines counts."""
    return qrels.groupBy("query_id", "item_id").agg(F.max_by("relevance", "line").alias("relevance"))


def ir_metrics(run: DataFrame, qrels: DataFrame, k: int = 10, recall_at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """run: (query_id, item_id, rank); qrels: (query_id, item_id, relevance). Per judged query: ndcg, recall, reciprocal rank; 0 where
    nothing is found."""
    wanted = qrels.where("relevance > 0")
    hits = wanted.join(run, ["query_id", "item_id"], "left")
    gain = lambda rank, rel: rel / F.log2(rank + 1)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "item_id"))
    scored = hits.withColumn("ideal", order)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    per = scored.groupBy("query_id").agg(
        total(F.when(F.col("rank") <= k, gain(F.col("rank"), F.col("relevance")))).alias("dcg"), total(F.when(F.col("ideal") <= k, gain(F.col("ideal"), F.col("relevance")))).alias("idcg"),
        *[(F.count_if(F.col("rank") <= n) / F.count(F.lit(1))).alias(f"recall_{n}") for n in recall_at], F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("recip_rank"),
    )
    judged = qrels.select("query_id").distinct().join(per, "query_id", "left")
    out = judged.select("query_id", F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias(f"ndcg_{k}"), *[F.coalesce(f"recall_{n}", F.lit(0.0)).alias(f"recall_{n}") for n in recall_at], F.coalesce("recip_rank", F.lit(0.0)).alias("recip_rank"))
    return out


def prf(expected: Column, found: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two id arrays: both empty 1.0, else 0.0 where a denominator is 0."""
    common = F.size(F.array_intersect(expected, found)).cast("double")
    e, f = F.size(F.array_distinct(expected)), F.size(F.array_distinct(found))
    empty = (e == 0) & (f == 0)
    p, r = F.coalesce(F.try_divide(common, f), F.lit(0.0)), F.coalesce(F.try_divide(common, e), F.lit(0.0))
    one = lambda c: F.when(empty, 1.0).otherwise(c)
    return {"precision": one(p), "recall": one(r), "f1": one(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))}


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("expected", T.IntegerType()), T.StructField("found", T.IntegerType())])))
def align_ingredients(expected: pd.Series, found: pd.Series) -> pd.Series:
    """Pairs of places: the same place where the names agree, then for each found one the first expected one left that agrees."""

    def one(e, f):
        e, f = [list(x) if x is not None else [] for x in (e, f)]
        used, pairs = set(), []
        for k in range(min(len(e), len(f))):
            if e[k] == f[k]:
                pairs.append((k, k))
                used.add(k)
        done = {b for _, b in pairs}
        for b, name in enumerate(f):
            if b not in done and (a := next((a for a, x in enumerate(e) if a not in used and x == name), None)) is not None:
                used.add(a)
                pairs.append((a, b))
        return sorted(pairs)

    return pd.Series([one(e, f) for e, f in zip(expected, found)])


def mean_of(parts: Column) -> Column:
    """Mean of the present values of an array; null without any."""
    have = F.filter(parts, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, x: a + x), F.size(have))


def calibration(rows: DataFrame) -> DataFrame:
    """rows: (confidence, accuracy, judge_pass) -> all four buckets with count, mean accuracy, pass rate of rated rows, miscalibrated."""
    from tessera.functions.text import confidence_bucket

    names = rows.sparkSession.createDataFrame([(k, b) for k, b in enumerate([">=0.90", ">=0.75", ">=0.50", "<0.50"])], "place int, bucket string")
    by = rows.groupBy(confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("accuracy").alias("mean_accuracy"), F.avg(F.col("judge_pass").cast("double")).alias("pass_rate"), F.count_if((F.col("accuracy") < 0.8) | ~F.col("judge_pass")).alias("bad"))
    out = F.broadcast(names).join(by, "bucket", "left").fillna(0, ["n", "bad"])
    return out.withColumn("miscalibrated", F.when(F.col("place") < 2, F.col("bad")).otherwise(0)).drop("bad")


def agreement(rows: DataFrame) -> DataFrame:
    """rows: (human_rating, judge_rating)."""
    rated = F.col("human_rating").isNotNull() & F.col("judge_rating").isNotNull()
    same = F.count_if(rated & (F.col("human_rating") == F.col("judge_rating")))
    return rows.agg(F.count_if(rated).alias("rated"), same.alias("agreed"), F.count_if(~rated).alias("unrated"), F.try_divide(same.cast("double"), F.count_if(rated)).alias("rate"))


def disagreements(rows: DataFrame) -> DataFrame:
    """The rated rows where human and judge differ."""
    return rows.where("human_rating IS NOT NULL AND judge_rating IS NOT NULL AND human_rating <> judge_rating")


def metric_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, value) tables -> one row per metric of either with delta and flag."""
    b, c = base.select("metric", F.col("value").alias("base"), F.lit(True).alias("in_base")), current.select("metric", F.col("value").alias("current"), F.lit(True).alias("in_current"))
    rows = b.join(c, "metric", "full_outer").withColumn("delta", F.col("current") - F.col("base"))
    flag = F.when(F.col("base").isNull() & F.col("current").isNull(), "missing").when(F.col("base").isNull(), "new")
    flag = flag.when(F.col("current").isNull(), F.when(F.col("in_current"), "REGRESSION").otherwise("missing")).when(F.col("metric").startswith("count."), "info")
    flag = flag.when(F.col("delta") < -(TOLERANCE + SLACK), "REGRESSION").when(F.col("delta") > TOLERANCE + SLACK, "improved").otherwise("unchanged")
    return rows.select("metric", "base", "current", "delta", flag.alias("flag"))


def retrieval_diff(base: DataFrame, current: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, item_id, rank) of expected items in two runs -> what became of each item of the queries in both."""
    shared = base.select("query_id").distinct().join(current.select("query_id").distinct(), "query_id", "left_semi")
    key = ["query_id", "item_id"]
    rows = base.join(shared, "query_id", "left_semi").select(*key, F.col("rank").alias("base_rank")).join(current.select(*key, F.col("rank").alias("new_rank")), key, "full_outer").join(shared, "query_id", "left_semi")
    inside = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    kind = F.when(inside("base_rank") & ~inside("new_rank"), "dropped_from_top_k").when(F.col("new_rank") - F.col("base_rank") >= RANK_DROP, "rank_drop").otherwise("kept")
    return rows.withColumn("change", kind)


def query_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    """(query_id, change) of the queries that only one run has: added or removed."""
    b, c = (df.select("query_id").distinct() for df in (base, current))
    return c.join(b, "query_id", "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(c, "query_id", "left_anti").withColumn("change", F.lit("removed")))


def comparable(base: dict, current: dict) -> list[str]:
    """The settings in which two runs differ; a comparison needs none."""
    return [k for k in COMPARED if base.get(k) != current.get(k)]


def diff_reports(base: DataFrame, current: DataFrame) -> DataFrame:
    """The difference of two reports' rows as write_report() stores them: of metrics (metric, value) or of retrieval (query_id, item_id, rank). Failed runs and reports of
    different kinds are refused."""
    kinds = []
    for rows in (base, current):
        if "run_status" in rows.columns and not rows.where("run_status <> 'ok'").isEmpty():
            raise ValueError("a failed run can't be compared")
        kinds.append("metrics" if {"metric", "value"} <= set(rows.columns) else "retrieval" if {"query_id", "item_id", "rank"} <= set(rows.columns) else "unknown")
    if len(set(kinds)) > 1 or "unknown" in kinds:
        raise ValueError(f"reports of kinds {kinds} can't be compared")
    return metric_diff(base, current) if kinds[0] == "metrics" else retrieval_diff(base, current)


def run_status(comparable: bool, query_regressions: int, deltas: list[float]) -> str:
    """Status of a difference, the first that holds."""
    if not comparable:
        return "incomparable"
    if query_regressions or any(d < -HEADLINE for d in deltas):
        return "regression"
    return "improvement" if any(d > HEADLINE for d in deltas) else "no_change"


# -- extraction: scores of fields, ingredients and whole sets ----------------------------------------------------------

# Fields of an ingredient that are scored, and of a recipe that hold times.


def _identities(lines: Column, name: str) -> Column:
    """Of each ingredient one of its names, trimmed in lower case, null where empty."""
    return F.transform(F.coalesce(lines, F.array()), lambda i: F.nullif(F.lower(F.trim(i[name])), F.lit("")))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("expected", T.IntegerType()), T.StructField("found", T.IntegerType())])))
def align_lines(expected_items: pa.Array, expected_lines: pa.Array, found_items: pa.Array, found_lines: pa.Array) -> pa.Array:
    """Pairs of places of ingredients that have the item or the line in common: the same place first, then for each found one the first
    expected one left. One recipe's lists at a time."""

    def one(e_items, e_lines, f_items, f_lines):
        same = [(x is not None and x == e_items[k]) or (y is not None and y == e_lines[k]) for k, (x, y) in enumerate(zip(f_items[: len(e_items)], f_lines))]
        pairs = [(k, k) for k, hit in enumerate(same) if hit]
        if len(pairs) == len(f_items):
            return pairs
        used = {k for k, _ in pairs}
        by_item, by_line = {}, {}
        for names, table in ((e_items, by_item), (e_lines, by_line)):
            for k in range(len(names) - 1, -1, -1):
                if k not in used and names[k] is not None:
                    table.setdefault(names[k], []).append(k)
        for b, (x, y) in enumerate(zip(f_items, f_lines)):
            if b >= len(same) or not same[b]:
                places = []
                for left in (by_item.get(x), by_line.get(y)):
                    while left and left[-1] in used:
                        left.pop()
                    if left:
                        places.append(left[-1])
                if places:
                    used.add(min(places))
                    pairs.append((min(places), b))
        return sorted(pairs)

    pairs = [one(e, g, f, h) for e, g, f, h in zip(*((x or [] for x in side.to_pylist()) for side in (expected_items, expected_lines, found_items, found_lines)))]
    ends = np.cumsum([0, *map(len, pairs)])
    flat = np.array([p for row in pairs for p in row], np.int32).reshape(-1, 2)
    places = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["expected", "found"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)


def ingredient_detail(rows: DataFrame, expected: str, found: str) -> DataFrame:
    """Adds `detail`: precision, recall, F1 over the SUB_FIELDS of all ingredients, numbers of matched and unmatched ones, accuracy of each field over the
    matched pairs."""
    e, f = F.coalesce(expected, F.array()), F.coalesce(found, F.array())
    rows = rows.withColumn("__pairs", align_lines(*[_identities(F.col(side), name) for side in (expected, found) for name in ("item_normalized", "raw_text")]))
    matched = F.size("__pairs")

    def right(name: str) -> Column:
        pair = lambda p: (F.get(e, p["expected"])[name], F.get(f, p["found"])[name])
        same = (lambda p: X.same_text(*pair(p))) if name != "quantity_value" else (lambda p: pair(p)[0].eqNullSafe(pair(p)[1]))
        return F.size(F.filter("__pairs", same))

    rows = rows.withColumn("__right", F.struct(*[right(k).alias(k) for k in SUB_FIELDS]))
    total = sum((F.col(f"__right.{k}") for k in SUB_FIELDS), F.lit(0)).cast("double")
    slots = lambda side: F.size(side) * len(SUB_FIELDS)
    p, r = F.coalesce(F.try_divide(total, slots(f)), F.lit(0.0)), F.coalesce(F.try_divide(total, slots(e)), F.lit(0.0))
    both_empty = (F.size(e) == 0) & (F.size(f) == 0)
    rate = lambda c: F.when(both_empty, 1.0).otherwise(c)
    accuracy = F.struct(*[F.coalesce(F.try_divide(F.col(f"__right.{k}").cast("double"), matched), F.lit(0.0)).alias(k) for k in SUB_FIELDS])
    detail = F.struct(rate(p).alias("precision"), rate(r).alias("recall"), rate(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))).alias("f1"), matched.alias("matched"), (F.size(f) - matched).alias("unmatched_found"), (F.size(e) - matched).alias("unmatched_expected"), accuracy.alias("accuracy"))
    return rows.withColumn("detail", detail).drop("__pairs", "__right")


def field_scores(rows: DataFrame, expected: str = "expected", found: str = "found") -> DataFrame:
    """expected, found: recipes (title, yield, the TIMES, ingredients, steps, source_span_ids; found is null where the extraction failed) -> adds `scores`. A
    yield or a time that the expected recipe doesn't have (or whose time can't be read) is not comparable: null."""
    rows = ingredient_detail(rows.withColumn("__e", F.col(f"{expected}.ingredients")).withColumn("__f", F.col(f"{found}.ingredients")), "__e", "__f")
    rows = rows.withColumn("__et", X.normalize_title(F.coalesce(f"{expected}.title", F.lit("")))).withColumn("__ft", X.normalize_title(F.coalesce(f"{found}.title", F.lit(""))))
    e, f = F.col(expected), F.col(found)
    time = lambda k: F.when(X.parse_minutes(e[k]).isNotNull(), F.coalesce(X.parse_minutes(e[k]) == X.parse_minutes(f[k]), F.lit(False)))
    size = lambda side, k: F.size(F.coalesce(side[k], F.array()))
    spans = prf(F.coalesce(e["source_span_ids"], F.array()), F.coalesce(f["source_span_ids"], F.array()))
    scores = F.struct(
        F.coalesce(e["title"] == f["title"], F.lit(False)).alias("title_exact"), (F.col("__et") == F.col("__ft")).alias("title_normalized"), F.when(e["yield"].isNotNull(), X.same_text(e["yield"], f["yield"])).alias("yield"), *[time(k).alias(k) for k in TIMES],
        (size(e, "ingredients") == size(f, "ingredients")).alias("ingredient_count"), (size(e, "steps") == size(f, "steps")).alias("step_count"), F.col("detail.f1").alias("ingredients_f1"), spans["f1"].alias("spans_f1"),
    )
    return rows.withColumn("scores", F.when(f.isNotNull(), scores)).drop("__e", "__f", "__et", "__ft")


SCORES = ("title_exact", "title_normalized", "yield", *TIMES, "ingredient_count", "step_count", "ingredients_f1", "spans_f1")


def objective_accuracy(scores: Column) -> Column:
    """Mean of a recipe's comparable scores; null without any."""
    return F.when(scores.isNotNull(), mean_of(F.array(*[scores[k].cast("double") for k in SCORES if k != "title_exact"])))


def missing_fields(expected: Column, found: Column) -> Column:
    """Fields that the expected recipe has and the found one lacks."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    checks = [(X.is_present(expected["title"]) & ~X.is_present(found["title"]), "title"), *[(expected[k].isNotNull() & found[k].isNull(), k) for k in ("yield", *TIMES)], *[((size(expected[k]) > 0) & (size(found[k]) == 0), k) for k in ("ingredients", "steps")]]
    return F.array_compact(F.array(*[F.when(c, k) for c, k in checks]))


def extraction_summary(rows: DataFrame) -> DataFrame:
    """rows: as field_scores() gives, with confidence and missing -> (metric, value): counts, success rate, mean confidence, mean of each score over
    the fixtures where it is comparable, how often each field is missing."""
    rows = scratch.stored(rows.select("scores", "confidence", "missing"), "scored")  # both sums below read it; the recipes are scored once
    one = rows.agg(
        F.count(F.lit(1)).cast("double").alias("count.fixtures"), F.count_if(F.col("scores").isNotNull()).cast("double").alias("count.success"), F.avg(F.col("scores").isNotNull().cast("double")).alias("success_rate"), F.avg(F.when(F.col("scores").isNotNull(), F.col("confidence"))).alias("mean_confidence"),
        *[F.avg(F.col(f"scores.{k}").cast("double")).alias(f"accuracy.{k}") for k in SCORES],
    )
    named = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in one.columns])
    lost = rows.where("scores IS NOT NULL").select(F.explode("missing").alias("field")).groupBy("field").count().select(F.concat(F.lit("count.missing."), "field").alias("metric"), F.col("count").cast("double").alias("value"))
    return one.select(F.explode(named).alias("m")).select("m.metric", "m.value").unionByName(lost)


def samples(per_query: DataFrame, metric: str = "ndcg_10", size: int = 3) -> DataFrame:
    """The best and the worst queries of a report."""
    best = per_query.orderBy(F.desc(metric), F.asc("query_id")).limit(size).withColumn("sample", F.lit("best"))
    return best.unionByName(per_query.orderBy(F.asc(metric), F.asc("query_id")).limit(size).withColumn("sample", F.lit("worst")))


def worst_drops(base: DataFrame, current: DataFrame, metric: str = "ndcg_10", most: int = 5) -> DataFrame:
    """The queries of both runs that lost most, losses only."""
    rows = base.select("query_id", F.col(metric).alias("base")).join(current.select("query_id", F.col(metric).alias("current")), "query_id")
    return rows.withColumn("delta", F.col("current") - F.col("base")).where("delta < 0").orderBy("delta", "query_id").limit(most)


def run_means(per_query: DataFrame, qrels: DataFrame) -> DataFrame:
    """Means of all metrics over the judged queries; one without results counts as 0."""
    names = [c for c in per_query.columns if c != "query_id"]
    judged = qrels.select("query_id").distinct().join(per_query, "query_id", "left")
    return judged.agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in names])


def retrieval_report(found: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """found: (query_id, item_id, rank) -> (query_id, metrics, retrieved_ids in order, expected_item_ranks: null where not found) of every judged
    query: the per_query part of a report."""
    listed = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda r: r["item_id"]).alias("retrieved_ids"))
    ranks = qrels.where("relevance > 0").join(found, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("item_id", "rank")))).alias("expected_item_ranks"))
    return ir_metrics(found, qrels, k).join(listed, "query_id", "left").join(ranks, "query_id", "left")


# -- goldens, judges, alignment ----------------------------------------------------------------------------------------

# The key of the line that states it, and the states of a verification.
VERIFICATION, VERIFIED = "Verification:", ("draft", "verified")


def verification_status(notes: Column) -> Column:
    """"draft" or "verified" as the first line of the notes says that begins, maybe after a bullet, with the key; else null."""
    lines = F.transform(F.split(notes, "\n"), lambda line: F.ltrim(F.regexp_replace(F.trim(line), "^[-*]", "")))
    stated = F.try_element_at(F.filter(lines, lambda line: line.startswith(VERIFICATION)), F.lit(1))
    word = F.lower(F.regexp_extract(F.trim(F.substr(stated, F.lit(len(VERIFICATION) + 1))), "^[A-Za-z]+", 0))
    return F.when(word.isin(*VERIFIED), word)


def fixture_hash(source: Column, expected: Column) -> Column:
    return F.sha2(F.concat(source, F.char(F.lit(0)), expected), 256)


# The parts of a cached rating's name.
JUDGE_KEY = ("fixture_set", "fixture_id", "fixture_content_hash", "extraction_prompt_version", "artifact_hash", "judge_name", "judge_version", "provider", "model")


def judge_key(*parts: Column) -> Column:
    """The name of a cached rating: all parts as slugs, then a digest of them."""
    digest = F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 32)
    return F.concat(F.substring(F.array_join(F.array(*[F.substring(X.slug(p), 1, 32) for p in parts]), "__"), 1, 120), F.lit("--"), digest)


def judge(rows: DataFrame, cache: DataFrame, judge_of, key: str = "judge_key") -> DataFrame:
    """rows: (key, prompt) -> (key, rating, critique, problem, cached). Known ratings are joined from the cache (key, rating, critique); judge_of: prompts -> JSON texts, asked once
    for each other key. A verdict must be pass or fail with a critique; anything else is a problem and is not to be cached."""
    from tessera.operators.runs import call_provider

    known = cache.groupBy(key).agg(F.min_by("rating", F.struct("rating", "critique")).alias("rating"), F.min("critique").alias("critique"))
    asked = rows.join(known, key, "left_anti").groupBy(key).agg(F.min("prompt").alias("prompt"))
    told = call_provider(asked, lambda prompts: [(x, None) for x in judge_of(prompts)], [key]).withColumn("v", F.from_json("output", "rating string, critique string"))
    good = F.coalesce(F.col("v.rating").isin("pass", "fail") & F.col("v.critique").isNotNull(), F.lit(False))
    fresh = told.select(key, F.when(good, F.col("v.rating")).alias("rating"), F.when(good, F.col("v.critique")).alias("critique"), F.when(~good, F.coalesce("error", F.lit("no valid verdict"))).alias("problem"), F.lit(False).alias("cached"))
    return fresh.unionByName(known.join(rows.select(key).distinct(), key, "left_semi").select(key, "rating", "critique", F.lit(None).cast("string").alias("problem"), F.lit(True).alias("cached")))


def drifted(fixtures: DataFrame, run: DataFrame) -> DataFrame:
    """Fixtures (fixture_id, content_hash) that changed since a run recorded their hash."""
    return fixtures.join(run.select("fixture_id", F.col("content_hash").alias("recorded")), "fixture_id").where(F.col("recorded") != F.col("content_hash"))


def alignment(current: DataFrame, records: DataFrame) -> DataFrame:
    """current: (fixture_id, judge_version, artifact_hash, judge_rating); records: earlier ones with human_rating. A human rating holds only for the same judge version
    and artifact; agreement is told where both sides rated."""
    human = records.where("human_rating IN ('pass', 'fail')").groupBy("fixture_id", "judge_version", "artifact_hash").agg(F.max("human_rating").alias("human_rating"))
    rows = current.join(human, ["fixture_id", "judge_version", "artifact_hash"], "left")
    status = F.when(F.col("human_rating").isNull() | F.col("judge_rating").isNull(), "unrated").when(F.col("human_rating") == F.col("judge_rating"), "agree").otherwise("disagree")
    return rows.withColumn("agreement_status", status)
