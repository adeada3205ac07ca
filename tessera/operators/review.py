"""Review of items: recorded and current thresholds, reasons, warnings derived again after edits, recipes that a person typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import ingest

#: Confidence where none is recorded, and of what a person wrote.
ASSUMED = 1.0
# Fixed values (the keys): codes of stored warnings, as ingest.soft_warnings() gives them.
MESSAGES = {
    "no_ingredients": "The recipe has no ingredients.",
    "no_steps": "The recipe has no steps.",
    "low_overall_confidence": "The confidence of the whole extraction is too low.",
    "low_boundary_confidence": "The confidence of where the recipe begins and ends is too low.",
    "recipe_too_short": "The text is very short.",
    "recipe_too_long": "The text is very long.",
    "low_normalization_confidence": "The confidence of some ingredient is too low.",
}


def thresholds_record(values: dict = ingest.THRESHOLDS) -> Column:
    """The thresholds that hold now, as a struct to store beside the warnings."""
    return F.struct(*[F.lit(v).cast("double" if k in ("overall", "boundary", "normalization") else "int").alias(k) for k, v in values.items()])


def resolve_thresholds(recorded: Column, current: dict = ingest.THRESHOLDS) -> Column:
    """(values, source): those that were recorded with the warnings if the record is complete, else the current ones."""
    whole = recorded.isNotNull()
    for name in current:
        whole = whole & recorded[name].isNotNull()
    now = thresholds_record(current)
    return F.struct(F.when(whole, recorded).otherwise(now).alias("values"), F.when(whole, "recorded").otherwise("current").alias("source"))


def review_reasons(status: Column, warnings: Column, overall: Column, boundary: Column, ingredients: Column, thresholds: Column) -> Column:
    """Why an item needs review: array of (code, message, value, threshold, positions); empty for other statuses. Known warnings have their
    message, all else is told as "llm_warning". ingredients: array of (position, normalization); a missing position is the place in the list."""
    scored = F.filter(F.transform(F.coalesce(ingredients, F.array()), lambda i, k: F.struct(F.coalesce(i["position"], k).cast("int").alias("position"), i["normalization"].cast("double").alias("score"))), lambda s: s["score"].isNotNull())
    lowest = F.array_min(F.transform(scored, lambda s: s["score"]))
    places = lambda keep: F.transform(F.filter(scored, keep), lambda s: s["position"])
    below = places(lambda s: s["score"] < thresholds["normalization"])
    positions = F.when(F.size(scored) == 0, None).when(F.size(below) > 0, below).otherwise(places(lambda s: s["score"] == lowest))
    known = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    pick = lambda w, parts: F.coalesce(*[F.when(w == code, value) for code, value in parts.items()])

    def reason(w: Column) -> Column:
        message = known[w]
        return F.struct(
            F.when(message.isNotNull(), w).otherwise("llm_warning").alias("code"), F.coalesce(message, w).alias("message"),
            pick(w, {"low_overall_confidence": overall, "low_boundary_confidence": boundary, "low_normalization_confidence": lowest}).alias("value"),
            pick(w, {f"low_{k}_confidence": thresholds[k] for k in ("overall", "boundary", "normalization")}).alias("threshold"),
            F.when(w == "low_normalization_confidence", positions).alias("positions"),
        )

    found = F.transform(F.coalesce(warnings, F.array()), reason)
    return F.when(status == "needs_review", found).otherwise(F.slice(found, 1, 0))


def with_assumed(rec: Column) -> Column:
    """A stored recipe as the checks want it: missing confidences count as ASSUMED."""
    sure = lambda c: F.coalesce(c, F.lit(ASSUMED))
    lines = F.transform(F.coalesce(rec["ingredients"], F.array()), lambda i: F.struct(i["raw_text"].alias("raw_text"), sure(i["normalization"]).alias("normalization")))
    return F.struct(rec["title"].alias("title"), rec["body_text"].alias("body_text"), sure(rec["overall"]).alias("overall"), sure(rec["boundary"]).alias("boundary"), lines.alias("ingredients"), rec["steps"].alias("steps"))


def rederive(items: DataFrame, rec: str = "rec", thresholds: dict = ingest.THRESHOLDS) -> DataFrame:
    """Warnings, notes and thresholds computed anew from the content (never carried forward), so a mended fault is gone and low confidences stay.
    A short recipe of a few ingredients without steps has a note instead of warnings."""
    full = with_assumed(F.col(rec))
    note = F.when(ingest.is_assembly(full, thresholds), F.array(F.lit("assembly"))).otherwise(F.array().cast("array<string>"))
    return items.withColumn("warnings", ingest.soft_warnings(full, thresholds)).withColumn("notes", note).withColumn("thresholds", thresholds_record(thresholds))


def authored(recipes: DataFrame, thresholds: dict = ingest.THRESHOLDS) -> DataFrame:
    """recipes: (item_id, title, ingredients: array of lines, steps: array of lines) that a person typed -> items that go straight to indexing, with
    composed text, full confidence and the warnings that the checks find (they hold nothing up)."""
    line = lambda x: F.struct(x.alias("raw_text"), F.lit(ASSUMED).alias("normalization"))
    given = lambda name: F.filter(F.coalesce(name, F.array()), X.is_present)
    rows = recipes.withColumn("ingredients_text", F.array_join(given("ingredients"), "\n")).withColumn("steps_text", F.array_join(given("steps"), "\n"))
    rows = rows.withColumn("body_text", X.compose_body(F.col("title"), F.col("ingredients_text"), F.col("steps_text")))
    rec = F.struct("title", "body_text", F.lit(ASSUMED).alias("overall"), F.lit(ASSUMED).alias("boundary"), F.transform(given("ingredients"), line).alias("ingredients"), F.transform(given("steps"), lambda x: F.struct(x.alias("text"), F.array().cast("array<string>").alias("source_span_ids"))).alias("steps"))
    out = rederive(rows.withColumn("rec", rec), "rec", thresholds)
    return out.select("item_id", "title", X.normalize_title("title").alias("normalized_title"), "ingredients_text", "steps_text", "body_text", F.lit("indexing").alias("status"), "warnings", "notes", "thresholds")
