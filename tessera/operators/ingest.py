"""Ingest: page windows, validation, scores, one winner per title, finalize, chunks, packing of requests."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

# Default settings.
WINDOW, OVERLAP, SPARSE_CHARS = 3, 1, 20
THRESHOLDS = {"overall": 0.5, "boundary": 0.5, "normalization": 0.5, "min_chars": 200, "max_chars": 20_000, "assembly_min": 3, "assembly_max": 12, "assembly_chars": 400}
BATCH_REQUESTS, BATCH_BYTES = 10_000, 200_000_000
EMBED_INPUTS, EMBED_TOKENS = 100, 300_000


def page_spans(pages: DataFrame, sparse: int = SPARSE_CHARS, extractor: str = "pages-v1") -> DataFrame:
    """pages: (document_id, page, text) -> spans with digests and the extractor's identity; nearly empty pages get confidence 0.0."""
    thin = F.length(F.trim(F.coalesce("text", F.lit("")))) < sparse
    return pages.select(
        "document_id", "page", F.coalesce("text", F.lit("")).alias("text"), F.when(thin, F.lit(0.0)).alias("confidence"), F.lit("embedded_text").alias("method"),
        X.content_hash(F.coalesce("text", F.lit(""))).alias("text_hash"), X.locator_hash(F.col("page"), F.col("page"), F.lit("page")).alias("locator_hash"),
        F.to_json(F.struct(F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.struct(F.lit(extractor).alias("extractor_identity")).alias("meta"))).alias("locator"),
    )


def windows(spans: DataFrame, key: str, order: str, columns: list[str], size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping windows of each key's rows in order: (key, window, rows). A row knows its windows from its place, so long
    documents are never gathered whole."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("a window needs size >= 1 and 0 <= overlap < size")
    step = size - overlap
    numbered = spans.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    last = F.ceil(F.greatest(F.col("__n") - size, F.lit(0)) / step)
    first = F.greatest(F.ceil((F.col("__at") - size + 1) / step), F.lit(0))
    placed = numbered.withColumn("window", F.explode(F.when(first <= F.least(F.floor(F.col("__at") / step), last), F.sequence(first, F.least(F.floor(F.col("__at") / step), last)))))
    rows = F.sort_array(F.collect_list(F.struct("__at", *columns)))
    return placed.groupBy(key, "window").agg(rows.alias("rows")).withColumn("rows", F.transform("rows", lambda r: r.dropFields("__at")))


def hard_failures(rec: Column, window_ids: Column) -> Column:
    """Codes of the hard checks that a recipe fails."""
    cited = F.array_distinct(F.concat(F.coalesce(rec["source_span_ids"], F.array()), F.flatten(F.coalesce(F.transform(rec["steps"], lambda s: F.coalesce(s["source_span_ids"], F.array())), F.array(F.array().cast("array<string>"))))))
    bad = lambda c: c.isNull() | F.isnan(c) | (c < 0) | (c > 1)
    checks = [
        (~F.coalesce(rec["item_type"] == "recipe", F.lit(False)), "item_type"),
        (~X.is_present(rec["title"]), "title"),
        (F.coalesce(F.size(rec["source_span_ids"]), F.lit(0)) < 1, "source_spans"),
        (F.size(F.array_except(cited, window_ids)) > 0, "span_outside_window"),
        (bad(rec["overall"]) | bad(rec["boundary"]), "confidence"),
        (F.exists(F.coalesce(rec["ingredients"], F.array()), lambda i: ~X.is_present(i["raw_text"])), "blank_ingredient"),
    ]
    return F.array_compact(F.array(*[F.when(c, code) for c, code in checks]))


def is_assembly(rec: Column, t: dict = THRESHOLDS) -> Column:
    """A short recipe of a few ingredients without steps."""
    n = F.coalesce(F.size(rec["ingredients"]), F.lit(0))
    return (F.coalesce(F.size(rec["steps"]), F.lit(0)) == 0) & n.between(t["assembly_min"], t["assembly_max"]) & (F.length(rec["body_text"]) <= t["assembly_chars"])


def soft_warnings(rec: Column, t: dict = THRESHOLDS) -> Column:
    size = F.length(F.trim(F.coalesce(rec["body_text"], F.lit(""))))
    n = lambda name: F.coalesce(F.size(rec[name]), F.lit(0))
    least = F.array_min(F.transform(rec["ingredients"], lambda i: i["normalization"]))
    exempt = is_assembly(rec, t)
    checks = [
        (n("ingredients") == 0, "no_ingredients"), ((n("steps") == 0) & ~exempt, "no_steps"), (rec["overall"] < t["overall"], "low_overall_confidence"), (rec["boundary"] < t["boundary"], "low_boundary_confidence"),
        ((size < t["min_chars"]) & ~exempt, "recipe_too_short"), (size > t["max_chars"], "recipe_too_long"), (least < t["normalization"], "low_normalization_confidence"),
    ]
    return F.array_compact(F.array(*[F.when(c, code) for c, code in checks]))


def item_status(warnings: Column, staged: bool = False) -> Column:
    return F.lit("extracting") if staged else F.when(F.size(warnings) == 0, "ready").otherwise("needs_review")


def candidate_score(overall: Column, boundary: Column, has_ingredients: Column, has_steps: Column, cited: Column, window: Column) -> Column:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    share = F.least(F.lit(1.0), cited.cast("double") / F.greatest(window, F.lit(1)))
    return F.lit(0.35) * overall + F.lit(0.25) * boundary + F.lit(0.15) * one(has_ingredients) + F.lit(0.15) * one(has_steps) + F.lit(0.10) * share


def best_per_title(candidates: DataFrame, by: list[str] = ("normalized_title",)) -> DataFrame:
    """`chosen` for one candidate of each title: highest score (null as 0.0), then smallest item_id."""
    window = Window.partitionBy(*by).orderBy(F.desc(F.coalesce("candidate_score", F.lit(0.0))), F.asc("item_id"))
    return candidates.withColumn("chosen", F.row_number().over(window) == 1)


def finalize(items: DataFrame) -> DataFrame:
    """items: (document_id, item_id, run_id, normalized_title, candidate_score, status, warnings, carried) at one version -> the same with
    `new_status`; "deleted" for staged losers. carried: promoted items of windows that were not extracted anew."""
    candidate = (F.col("status") == "extracting") | (F.col("carried") & F.col("status").isin("ready", "needs_review"))
    won = best_per_title(items.where(candidate), ["document_id", "normalized_title"])
    staged = F.col("status") == "extracting"
    after = F.when(F.col("chosen") & staged, item_status(F.col("warnings"))).when(F.col("chosen"), F.col("status")).when(staged, "deleted").otherwise("superseded")
    won = won.select("document_id", "item_id", "run_id", "chosen", after.alias("new_status"))
    per_document = won.where("chosen").groupBy("document_id").agg(F.max(F.col("new_status") == "ready").alias("has_ready"))
    runs = won.where("chosen").select("document_id", "run_id").distinct().withColumn("kept_run", F.lit(True))
    out = items.join(won.select("document_id", "item_id", "new_status"), ["document_id", "item_id"], "left").join(per_document, "document_id", "left").join(runs, ["document_id", "run_id"], "left")
    stale = F.col("has_ready") & F.col("kept_run").isNull() & ~F.col("status").isin("superseded", "rejected", "indexing", "extracting")
    return out.withColumn("new_status", F.coalesce("new_status", F.when(stale, "superseded"), "status")).drop("has_ready", "kept_run")


def build_chunks(items: DataFrame, cap: int = 8000) -> DataFrame:
    """items: (item_id, title, summary, ingredients_text, steps_text, body_text) -> (item_id, chunk_type, part, part_count, text) in the usual
    order of types; long texts in parts."""
    kinds = [("recipe_full", "body_text"), ("recipe_title", "title"), ("recipe_summary", "summary"), ("recipe_ingredients", "ingredients_text"), ("recipe_steps", "steps_text")]
    rows = F.array(*[F.struct(F.lit(k).alias("type_order"), F.lit(name).alias("chunk_type"), F.col(column).alias("text")) for k, (name, column) in enumerate(kinds)])
    texts = items.select("item_id", F.explode(rows).alias("c")).select("item_id", "c.*").where(X.is_present(F.col("text")))
    parts = texts.withColumn("parts", X.split_bytes(cap)(F.col("text"))).withColumn("part_count", F.size("parts"))
    # outer, as Spark would else split all texts a second time, to tell beforehand which have parts
    rows = parts.select("item_id", "type_order", "chunk_type", "part_count", F.posexplode_outer("parts").alias("part", "text"))
    return rows.where("part IS NOT NULL").withColumn("part", F.col("part") + 1)


def chunk_ready(items: DataFrame, chunks: DataFrame, cap: int = 8000) -> DataFrame:
    """build_chunks() of ready items that have no chunks yet: a replay adds nothing."""
    return build_chunks(items.where("status = 'ready'").join(chunks.select("item_id").distinct(), "item_id", "left_anti"), cap)


def embed_chunks(chunks: DataFrame, known: DataFrame, provider: Callable[[list[str]], list], space: tuple[str, str], most: int = EMBED_INPUTS, most_tokens: int = EMBED_TOKENS) -> DataFrame:
    """Embeddings (chunk_id, provider, model, embedding) of the chunks (chunk_id, text) that have none in the space (provider, model). provider: at most `most` texts of most_tokens together (a text has at most
    as many tokens as UTF-8 bytes; a longer text goes alone) -> as many vectors, or it raises and the job fails. Another model is another space: all chunks are embedded again and the old space stays."""
    had = known.where((F.col("provider") == space[0]) & (F.col("model") == space[1])).select("chunk_id")
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            tokens, at = [len((t or "").encode()) for t in pdf["text"]], 0
            while at < len(pdf):
                end, total = at + 1, tokens[at]
                while end < min(len(pdf), at + most) and total + tokens[end] <= most_tokens:
                    total, end = total + tokens[end], end + 1
                part, at = pdf.iloc[at:end], end
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "embedding": list(provider(list(part["text"].fillna(""))))})

    out = chunks.join(had, "chunk_id", "left_anti").select("chunk_id", "text").mapInPandas(run, f"chunk_id {kind}, embedding array<float>")
    return out.select("chunk_id", F.lit(space[0]).alias("provider"), F.lit(space[1]).alias("model"), "embedding")


def unregistered(windows: DataFrame, registered: DataFrame, key: list[str] = ("document_id", "source_version", "input_hash")) -> DataFrame:
    """Windows whose input no batch item has yet, one for each input (the first by window)."""
    fresh = windows.join(registered.select(*key).distinct(), list(key), "left_anti")
    return fresh.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("window"))).where("__n = 1").drop("__n")


def first_claim(items: DataFrame, order: list[str], size: str, most: int = BATCH_REQUESTS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """The longest front of the queue within both caps; the first row always. Spark takes the first `most` rows of each task and then of all, so one
    task sees no more than these."""
    items = items.orderBy(*order).limit(max(most, 1))
    window = Window.orderBy(*order)
    place, running = F.row_number().over(window), F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("place", place).withColumn("running", running).where((F.col("place") == 1) | ((F.col("place") <= most) & (F.col("running") <= most_bytes)))


def hash_embedding(provider: str = "fake", model: str = "hash", dimensions: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for an embedding service: components from digests of (provider, model, dimensions, text); an
    empty text has the zero vector."""

    def embed(text: Column) -> Column:
        seed = F.concat_ws(":", F.lit(provider), F.lit(model), F.lit(str(dimensions)), text)
        value = lambda i: (F.conv(F.substring(F.sha2(F.concat_ws(":", seed, i.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(2147483648.0) - 1).cast("float")
        return F.when(X.is_present(text), F.transform(F.sequence(F.lit(1), F.lit(dimensions)), value)).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dimensions))

    return embed


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """new replaces old rows of the same key, but for the columns of `keep`, which stay as they were."""
    known = old.select(*key, *[F.col(c).alias(f"__{c}") for c in keep])
    merged = new.join(known, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in old.columns])
    return old.join(new.select(*key), key, "left_anti").unionByName(merged)
