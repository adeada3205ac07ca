"""Edits of a whole recipe: lines matched to what was there, text composed anew where lines changed, warnings derived anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators import ingest, review
from tessera.operators.lifecycle import first_of

#: Fields that an edit may set besides the lines; a set field may be null.
PLAIN = ("title", "summary", "yield", "prep_time", "cook_time", "total_time")
#: Fields of a line that say how sure its parse is; a person is.
SURE = ("confidence", "normalization")
EDITABLE = ("ready", "needs_review")


def _sure(kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[F.lit(review.ASSUMED).cast(f.dataType).alias(f.name) for f in kind])
    return F.lit(review.ASSUMED).cast(kind)


def _written(kind: T.StructType, text: str, number: str, line: Column, at: Column) -> Column:
    """A line that a person wrote: no parse, nothing cited, full confidence."""

    def value(f: T.StructField) -> Column:
        if f.name == number:
            return at.cast(f.dataType)
        if f.name == text:
            return line
        if f.name == "edited":
            return F.lit(True)
        if f.name in SURE:
            return _sure(f.dataType)
        return F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast(f.dataType)

    return F.struct(*[value(f).alias(f.name) for f in kind])


def matched_lines(items: DataFrame, edits: DataFrame, column: str, text: str, number: str) -> DataFrame:
    """(item_id, rows): for each edit with lines (item_id, lines) the rows that its item's `column` has then. A line takes over the row that had the same
    text, of equal lines the first the first row, and so on, and only the row's number changes; a line that no row is left for is written by a person.
    Equal texts meet by their rank, so work grows with the lines."""
    kind = items.schema[column].dataType.elementType
    rank = lambda key, at: F.row_number().over(Window.partitionBy("item_id", key).orderBy(at))
    old = items.join(edits.select("item_id"), "item_id", "left_semi").select("item_id", F.posexplode(column).alias("__at", "__row")).withColumn("__line", F.col("__row")[text]).where("__line IS NOT NULL")
    old = old.select("item_id", "__line", rank("__line", "__at").alias("__rank"), "__row")
    new = edits.select("item_id", F.posexplode("lines").alias("__k", "__line"))
    new = new.withColumn("__rank", rank("__line", "__k"))
    at = F.col("__k") + 1
    kept = F.struct(*[(at.cast(f.dataType) if f.name == number else F.col("__row")[f.name]).alias(f.name) for f in kind])
    rows = new.join(old, ["item_id", "__line", "__rank"], "left").withColumn("__new", F.when(F.col("__row").isNotNull(), kept).otherwise(_written(kind, text, number, F.col("__line"), at)))
    listed = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("__k", "__new"))).alias("rows")).withColumn("rows", F.transform("rows", lambda r: r["__new"]))
    none = F.array().cast(T.ArrayType(kind))
    return edits.select("item_id").join(listed, "item_id", "left").withColumn("rows", F.coalesce("rows", none))


def apply_edits(items: DataFrame, edits: DataFrame, thresholds: dict = ingest.THRESHOLDS) -> DataFrame:
    """items: (item_id, status, title, summary, body_text, yield, prep_time, cook_time, total_time, ingredients: rows with position and raw_text,
    steps: rows with step_number and text, ingredients_text, steps_text, overall, boundary, snapshot, warnings, ...) -> the same after the edits, with
    `body_rebuilt`. edits: (item_id, fields: the names set, those of PLAIN that are set, ingredients and steps: arrays of lines, maybe `at`).

    Of several edits of an item the first holds, as in first_of(). Only items in EDITABLE change; the first edit keeps a snapshot of the content. Fields that are
    not set stay. The text of a list is written anew only if its rows changed, and the body only if some rows did, so a change of title keeps prose that
    stands in the body alone. Warnings come from the content that is there now. A ready item goes to indexing, one under review stays."""
    columns = items.columns
    plain = [c for c in PLAIN if c in columns and c in edits.columns]
    asked = first_of(edits.select("item_id", "fields", *plain, "ingredients", "steps", *(["at"] if "at" in edits.columns else [])), ["item_id"])
    asked = asked.join(items.where(F.col("status").isin(*EDITABLE)).select("item_id"), "item_id", "left_semi").where(F.size("fields") > 0)
    has = lambda name: F.array_contains("__fields", name)
    rows = items.join(asked.select("item_id", F.col("fields").alias("__fields"), *[F.col(c).alias(f"__{c}") for c in plain]), "item_id", "left")
    edited = F.col("__fields").isNotNull()
    content = [c for c in ("title", "summary", "body_text", "ingredients", "steps", "ingredients_text", "steps_text", *PLAIN[2:]) if c in columns]
    rows = rows.withColumn("snapshot", F.when(edited, F.coalesce("snapshot", F.to_json(F.struct(*content)))).otherwise(F.col("snapshot")))
    for name in plain:
        rows = rows.withColumn(name, F.when(edited & has(name), F.col(f"__{name}")).otherwise(F.col(name)))
    changed = {}
    for name, text, number in (("ingredients", "raw_text", "position"), ("steps", "text", "step_number")):
        lines = asked.where(F.array_contains("fields", name)).select("item_id", F.coalesce(name, F.array().cast("array<string>")).alias("lines"))
        rows = rows.join(matched_lines(items, lines, name, text, number).withColumnRenamed("rows", f"__{name}"), "item_id", "left")
        changed[name] = F.col(f"__{name}").isNotNull() & ~F.col(f"__{name}").eqNullSafe(F.coalesce(name, F.array().cast(items.schema[name].dataType)))
        rows = rows.withColumn(f"__{name}_changed", changed[name])
        joined = F.array_join(F.transform(F.col(f"__{name}")[text], lambda x: F.coalesce(x, F.lit(""))), "\n")
        rows = rows.withColumn(f"{name}_text", F.when(F.col(f"__{name}_changed"), joined).otherwise(F.col(f"{name}_text"))).withColumn(name, F.coalesce(f"__{name}", name))
    rebuilt = F.col("__ingredients_changed") | F.col("__steps_changed")
    body = X.compose_body(F.col("title"), X.resolve_lines(F.col("ingredients_text"), F.col("ingredients"), "raw_text"), X.resolve_lines(F.col("steps_text"), F.col("steps"), "text"))
    rows = rows.withColumn("body_rebuilt", rebuilt).withColumn("body_text", F.when(rebuilt, body).otherwise(F.col("body_text")))
    rec = F.struct("title", "body_text", "overall", "boundary", "ingredients", "steps")
    fresh = review.rederive(rows.withColumn("__rec", rec).withColumn("__old", F.col("warnings")), "__rec", thresholds)
    out = fresh.withColumn("warnings", F.when(edited, F.col("warnings")).otherwise(F.col("__old"))).withColumn("status", F.when(edited & (F.col("status") == "ready"), "indexing").otherwise(F.col("status")))
    return out.select(*columns, "body_rebuilt")
