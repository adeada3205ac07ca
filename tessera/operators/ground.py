"""Grounding: context packs with citation ids, checks of generated answers and menus, assignment of items to courses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default caps.
ITEMS, CHUNKS_PER_ITEM = 6, 3
MENU_COURSES, MENU_CANDIDATES = 6, 5
# Prompt version of each answer style; an unknown style takes the first.
PROMPT_VERSIONS = {"recommendation": "answer-recommendation-v2", "summary": "answer-summary-v2", "comparison": "answer-comparison-v2", "direct_answer": "answer-direct-answer-v2"}


def context_pack(chunks: DataFrame, items: int = ITEMS, per_item: int = CHUNKS_PER_ITEM) -> DataFrame:
    """chunks: (query_id, item_id, item_place, chunk_place, chunk_id, text, span_ids, known_spans) -> one row per kept chunk with ctx_id,
    cite_id. The caps come first; then chunks without text or known span go, and items without chunks; cite ids count the first valid
    spans within their item."""
    by_item = Window.partitionBy("query_id", "item_id").orderBy("chunk_place")
    # all windows below are within a query, so one shuffle serves them
    capped = chunks.where(F.col("item_place") <= items).repartition("query_id").withColumn("__n", F.row_number().over(by_item)).where(F.col("__n") <= per_item)
    span = F.element_at(F.filter("span_ids", lambda s: F.array_contains("known_spans", s)), 1)
    kept = capped.withColumn("span_id", F.when(F.size(F.array_intersect("span_ids", "known_spans")) > 0, span)).where((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & F.col("span_id").isNotNull())
    first = Window.partitionBy("query_id", "item_id", "span_id").orderBy("chunk_place")
    kept = kept.withColumn("__first", F.row_number().over(first) == 1)
    ctx = F.dense_rank().over(Window.partitionBy("query_id").orderBy("item_place"))
    count = F.sum(F.col("__first").cast("int")).over(Window.partitionBy("query_id").orderBy("item_place", "chunk_place").rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("ctx_id", F.concat(F.lit("ctx_"), ctx.cast("string"))).withColumn("__cite", F.when(F.col("__first"), count))
    cite = F.max("__cite").over(Window.partitionBy("query_id", "item_id", "span_id"))
    return kept.withColumn("cite_id", F.concat(F.lit("cite_"), cite.cast("string"))).drop("__n", "__first", "__cite", "known_spans")


def check_citations(answers: DataFrame, pack: DataFrame) -> DataFrame:
    """answers: (query_id, recommendation, item_id, cite_ids) -> (query_id, unknown_items, unknown, wrong_owner, uncited, total, valid)."""
    owned = pack.select("query_id", "cite_id", F.col("item_id").alias("owner")).distinct()
    known = pack.select("query_id", "item_id").distinct().withColumn("known_item", F.lit(True))
    cited = answers.withColumn("cite_id", F.explode_outer("cite_ids")).join(owned, ["query_id", "cite_id"], "left").join(known, ["query_id", "item_id"], "left")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = cited.groupBy("query_id").agg(
        one(F.col("known_item").isNull()).alias("unknown_items"), one(F.col("cite_id").isNotNull() & F.col("owner").isNull()).alias("unknown"), one(F.col("owner") != F.col("item_id")).alias("wrong_owner"),
        one(F.col("cite_id").isNull()).alias("uncited"), one(F.col("cite_id").isNotNull()).alias("total"),
    )
    return out.withColumn("valid", (F.col("unknown_items") == 0) & (F.col("unknown") == 0) & (F.col("wrong_owner") == 0) & (F.col("uncited") == 0) & (F.col("total") > 0))


def rebuilt_citations(answers: DataFrame, pack: DataFrame) -> DataFrame:
    """Citations as the pack has them, in the order of first use."""
    used = answers.select("query_id", "recommendation", F.posexplode("cite_ids").alias("at", "cite_id")).groupBy("query_id", "cite_id").agg(F.min(F.struct("recommendation", "at")).alias("first"))
    known = pack.groupBy("query_id", "cite_id").agg(F.min("span_id").alias("span_id"), F.min("item_id").alias("item_id"))
    return used.join(known, ["query_id", "cite_id"]).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).drop("first")


def answer_status(n_results: Column, n_pack: Column, technical: Column, parsed: Column, valid: Column) -> Column:
    """Why an answer falls back to the results themselves, or "answered"."""
    false = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(F.coalesce(n_results, F.lit(0)) == 0, "no_results").when(F.coalesce(n_pack, F.lit(0)) == 0, "no_context").when(F.coalesce(technical, F.lit(False)), "technical_error").when(false(parsed), "unparsable").when(false(valid), "invalid").otherwise("answered")


def plan_courses(plans: DataFrame, most: int = MENU_COURSES) -> DataFrame:
    """plans: (request_id, courses: array of (slot, query)) -> (request_id, course, slot, query): slots trimmed in lower case, unusable ones
    dropped, the first of duplicates kept, at most `most`; without any, one course "main"."""
    rows = plans.select("request_id", F.posexplode_outer("courses").alias("pos", "c")).select("request_id", "pos", F.lower(F.trim("c.slot")).alias("slot"), F.trim("c.query").alias("query"))
    good = rows.where((F.length("slot") > 0) & (F.length("query") > 0))
    good = good.withColumn("__n", F.row_number().over(Window.partitionBy("request_id", "slot").orderBy("pos"))).where("__n = 1")
    good = good.withColumn("course", F.row_number().over(Window.partitionBy("request_id").orderBy("pos"))).where(F.col("course") <= most).select("request_id", "course", "slot", "query")
    bare = plans.select("request_id").join(good, "request_id", "left_anti").select("request_id", F.lit(1).alias("course"), F.lit("main").alias("slot"), F.lit("").alias("query"))
    return good.unionByName(bare)


def assign_courses(candidates: DataFrame, cap: int = MENU_CANDIDATES) -> DataFrame:
    """candidates: (request_id, course, item_id, score). Greedy by (score desc, course, item_id) over a request: an item goes to one course, a
    course takes `cap`. What each step may take depends on all before it, so a request's candidates (courses times the over-fetch)
    are taken together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, filled, keep = set(), {}, []
        for k, course, item in pdf.sort_values(["score", "course", "item_id"], ascending=[False, True, True])[["course", "item_id"]].itertuples():
            good = item not in taken and filled.get(course, 0) < cap
            if good:
                taken.add(item)
                filled[course] = filled.get(course, 0) + 1
                keep.append(k)
        return pdf.loc[keep]

    return candidates.groupBy("request_id").applyInPandas(run, candidates.schema)


def check_menu(menu: DataFrame, plan: DataFrame, assigned: DataFrame, pack: DataFrame) -> DataFrame:
    """menu: (request_id, course, item_id, cite_ids) -> counts of what is wrong, and `valid`."""
    planned = plan.select("request_id", "course").withColumn("planned", F.lit(True))
    bound = assigned.select("request_id", "course", "item_id").withColumn("bound", F.lit(True))
    rows = menu.join(planned, ["request_id", "course"], "left").join(bound, ["request_id", "course", "item_id"], "left")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = rows.groupBy("request_id").agg(one(F.col("planned").isNull()).alias("unplanned"), one(F.col("bound").isNull()).alias("unbound"), (F.count(F.lit(1)) - F.count_distinct("course")).alias("twice"), (F.count(F.lit(1)) - F.count_distinct("item_id")).alias("reused"), one(F.coalesce(F.size("cite_ids"), F.lit(0)) < 1).alias("uncited"))
    owned = pack.select(F.col("query_id").alias("request_id"), F.explode(F.array("cite_id")).alias("cite"), F.col("item_id").alias("owner")).distinct()
    wrong = menu.select("request_id", "item_id", F.explode("cite_ids").alias("cite")).join(owned, ["request_id", "cite"], "left").where("owner IS NULL OR owner <> item_id").groupBy("request_id").agg(F.count(F.lit(1)).alias("foreign"))
    open_slots = assigned.select("request_id", "course").distinct().join(menu.select("request_id", "course"), ["request_id", "course"], "left_anti").groupBy("request_id").agg(F.count(F.lit(1)).alias("unfilled"))
    out = counts.join(wrong, "request_id", "left").join(open_slots, "request_id", "left").fillna(0, ["foreign", "unfilled"])
    bad = ["unplanned", "unbound", "twice", "reused", "uncited", "foreign", "unfilled"]
    return out.withColumn("valid", sum((F.col(c) for c in bad), F.lit(0)) == 0)


def best_per_course(plan: DataFrame, assigned: DataFrame) -> DataFrame:
    """The fallback menu in plan order: each course's best candidate, or none."""
    best = assigned.groupBy("request_id", "course").agg(F.max_by("item_id", F.struct("score", F.col("item_id"))).alias("item_id"))
    return plan.join(best, ["request_id", "course"], "left")


def prompt_version_of(style: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PROMPT_VERSIONS.items() for x in kv])
    return F.coalesce(known[style], F.lit(next(iter(PROMPT_VERSIONS.values()))))


# The sentences of the footer, which prompts rely on.
CITATIONS, ITEMS, NONE = "Allowed citation IDs: ", "Allowed knowledge_item_ids: ", "(none)"


def allowed_ids(pack: DataFrame) -> DataFrame:
    """(query_id, footer): the citation and item ids that an answer may name, each once, in the pack's order."""
    order = F.struct("item_place", "chunk_place")
    once = lambda name: pack.groupBy("query_id", name).agg(F.min(order).alias("at")).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", name))), lambda s: s[name].cast("string")).alias(name))
    both = once("cite_id").join(once("item_id"), "query_id")
    listed = lambda name: F.coalesce(F.nullif(F.array_join(name, ", "), F.lit("")), F.lit(NONE))
    return both.select("query_id", F.concat(F.lit(CITATIONS), listed("cite_id"), F.lit(f"\n{ITEMS}"), listed("item_id")).alias("footer"))


def pack_counts(queries: DataFrame, pack: DataFrame) -> DataFrame:
    """Per query how many items and citations its context has."""
    sums = pack.groupBy("query_id").agg(F.count_distinct("ctx_id").alias("n_context_items"), F.count_distinct("cite_id").alias("n_citations"))
    return queries.select("query_id").join(sums, "query_id", "left").fillna(0)


def over_fetch(cap: int = MENU_CANDIDATES) -> int:
    """Results that each course asks for: twice what it may keep, so that others may take some from it; one more at least."""
    return max(2 * cap, cap + 1)


def menu_payload(plan: DataFrame, menu: DataFrame, assigned: DataFrame, valid: DataFrame) -> DataFrame:
    """plan: (request_id, course, slot); menu: (request_id, course, item_id); valid: (request_id, valid) -> a row for each planned course in order: the
    chosen item, else (where the menu is not valid) the course's best candidate, or none; status: menu, fallback or empty."""
    best = best_per_course(plan.select("request_id", "course"), assigned).withColumnRenamed("item_id", "best_item")
    chosen = menu.groupBy("request_id", "course").agg(F.min("item_id").alias("menu_item"))
    rows = plan.join(best, ["request_id", "course"], "left").join(chosen, ["request_id", "course"], "left").join(valid, "request_id", "left")
    good = F.coalesce("valid", F.lit(False))
    rows = rows.withColumn("item_id", F.when(good, F.col("menu_item")).otherwise(F.col("best_item")))
    filled = F.max(F.col("item_id").isNotNull()).over(Window.partitionBy("request_id"))
    return rows.withColumn("status", F.when(~filled, "empty").when(good, "menu").otherwise("fallback")).select("request_id", "course", "slot", "item_id", "status")
