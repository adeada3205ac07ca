"""From queries and tables to results: the searchable rows, both legs over them, rerank, grouping, the envelope of results and what a client shows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import keyword_index, search, vector_index

# Schema names of a result and of its preview; ingredients of a preview.
SCHEMA, PREVIEW_SCHEMA, TOP_INGREDIENTS = "recipe.v1", "recipe.preview.v1", 5
MODES = ("keyword", "vector", "hybrid")
#: What a reranker gets of each query, and of each text.
RERANK_TOP, RERANK_CHARS = 50, 2000


def searchable(chunks: DataFrame, items: DataFrame, documents: DataFrame, predicate: Column) -> DataFrame:
    """The chunks of items that a search may return, with the columns of chunks (item_id among them), document_id and the filter's columns.
    items: (item_id, document_id, item_type, status, source_version, ...); documents: (document_id, category, subcategory, active_version, ...). Items
    and documents are filtered before they meet the chunks."""
    docs = documents.select("document_id", "category", "subcategory", "active_version")
    rows = items.select("item_id", "document_id", "item_type", F.col("status").alias("item_status"), F.col("source_version").alias("item_version"))
    allowed = rows.join(docs, "document_id").withColumn("parent_type", F.lit("knowledge_item")).where(predicate)
    known = chunks if "parent_type" not in chunks.columns else chunks.where("parent_type = 'knowledge_item'").drop("parent_type")
    return known.join(allowed.select("item_id", "document_id", "category", "subcategory"), "item_id")


def keyword_search(chunks: DataFrame, items: DataFrame, documents: DataFrame, queries: DataFrame, predicate: Column, top_k: int = 50, index: str | None = None) -> DataFrame:
    """search.keyword_leg() over searchable chunks, whose texts are stemmed here if they have no lexemes; with a stored index (keyword_index) only the blocks
    of the queries' terms are read."""
    found = searchable(chunks, items, documents, predicate)
    if index is None and "lexemes" not in found.columns:
        found = found.withColumn("lexemes", X.lexemes(F.col("text")))
    return search.keyword_leg(found, queries, top_k) if index is None else keyword_index.keyword_leg(index, queries, top_k, found.select("chunk_id"))


def check_space(queries: DataFrame, provider: str, model: str) -> DataFrame:
    """The queries; a job over one of another space than (provider, model) fails."""
    right = (F.col("provider") == provider) & (F.col("model") == model)
    return queries.withColumn("provider", F.when(right, F.col("provider")).otherwise(F.raise_error(F.concat(F.lit(f"query vector is not of the space {provider}/{model}: "), F.concat_ws("/", "provider", "model")))))


def vector_search(embeddings: DataFrame, chunks: DataFrame, items: DataFrame, documents: DataFrame, queries: DataFrame, predicate: Column, provider: str, model: str, top_k: int = 50, index: str | None = None) -> DataFrame:
    """search.vector_leg() over the embeddings of searchable chunks in one space. embeddings: (chunk_id, provider, model, embedding); with a stored index
    (vector_index) its rows are used instead, and only cells that can hold a result are read."""
    if index is not None:
        return vector_index.vector_leg(index, check_space(queries, provider, model), top_k, searchable(chunks, items, documents, predicate).select("chunk_id"))
    rows = embeddings.where((F.col("provider") == provider) & (F.col("model") == model)).join(searchable(chunks, items, documents, predicate).select("chunk_id", "item_id", "chunk_type"), "chunk_id")
    return search.vector_leg(rows, check_space(queries, provider, model), top_k)


def rerank(merged: DataFrame, texts: DataFrame, questions: DataFrame, scorer: Callable[[str, list[tuple[str, str]]], list], top_n: int = RERANK_TOP, size: int = RERANK_CHARS) -> DataFrame:
    """merged with the scores that a reranker gives, and `reranked`. scorer: (question, [(chunk_id, text)]) -> chunk_ids, best first. A query whose
    scorer raises or names no known chunk keeps its scores. A query's head (top_n rows) is one group."""
    head = search.rerank_head(merged, texts, top_n, size).join(questions.select("query_id", "question"), "query_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        try:
            listed = list(scorer(pdf["question"].iloc[0], list(zip(pdf["chunk_id"], pdf["text"].fillna("")))))
        except Exception:  # a reranker never breaks a search
            listed = []
        known = set(pdf["chunk_id"])
        listed = [c for c in listed if c in known]
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(listed), "pos": range(len(listed)), "chunk_id": listed})

    kinds = {f.name: f.dataType.simpleString() for f in merged.schema}
    listed = head.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, pos int, chunk_id {kinds['chunk_id']}")
    done = listed.select("query_id").distinct().withColumn("reranked", F.lit(True))
    return search.apply_rerank(merged, listed).join(done, "query_id", "left").fillna(False, ["reranked"])


def envelope(top: DataFrame, items: DataFrame, documents: DataFrame, chunk_spans: DataFrame, spans: DataFrame) -> DataFrame:
    """top: as group_items() gives -> one row per result: item, document, matched chunks, citations with labels in the order of first use. An item
    that is gone by now is left out; a document that is gone has empty names."""
    item = F.struct(F.col("item_id").alias("knowledge_item_id"), "item_type", "title", "summary", "status").alias("item")
    rows = top.join(items.select("item_id", "document_id", item), "item_id")
    names = documents.select("document_id", F.col("title").alias("d_title"), F.col("author").alias("d_author"))
    rows = rows.join(names, "document_id", "left").join(search.citations(top, chunk_spans, spans).select("query_id", "item_id", "citations"), ["query_id", "item_id"], "left")
    cited = F.transform(F.coalesce("citations", F.array().cast(search.citations(top, chunk_spans, spans).schema["citations"].dataType)), lambda c: F.struct(c["span_id"].alias("source_span_id"), X.page_label(c["page_start"], c["page_end"]).alias("label"), c["page_start"].alias("page_start"), c["page_end"].alias("page_end")))
    matched = F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["chunk_type"].alias("chunk_type"), c["score"].alias("score")))
    document = F.struct("document_id", F.coalesce("d_title", F.lit("")).alias("title"), F.coalesce("d_author", F.lit("")).alias("author")).alias("document")
    return rows.select("query_id", "place", "item_id", "item", document, "item_score", matched.alias("matched_chunks"), cited.alias("source_citations"))


def debug_counts(queries: DataFrame, keyword: DataFrame | None, vector: DataFrame | None, merged: DataFrame, mode: str) -> DataFrame:
    """Per query: candidates of each leg, merged chunks, grouped items before the limit, whether a reranker's order holds."""
    out = queries.select("query_id").withColumn("mode", F.lit(mode))
    for name, rows in (("keyword_candidates", keyword), ("vector_candidates", vector)):
        counts = None if rows is None else rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
        out = out.withColumn(name, F.lit(0).cast("long")) if counts is None else out.join(counts, "query_id", "left")
    flag = F.max("reranked") if "reranked" in merged.columns else F.lit(False)
    sums = merged.groupBy("query_id").agg(F.count(F.lit(1)).alias("merged_chunks"), F.count_distinct("item_id").alias("grouped_items"), flag.alias("rerank_applied"))
    return out.join(sums, "query_id", "left").fillna(0, ["keyword_candidates", "vector_candidates", "merged_chunks", "grouped_items"]).fillna(False, ["rerank_applied"])


def search_items(queries: DataFrame, keyword: DataFrame | None, vector: DataFrame | None, mode: str = "hybrid", limit: int = 10, reranker: Callable[[DataFrame], DataFrame] | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """The items of each query and the debug counts, from the legs that the mode uses. reranker: as rerank() with its other arguments bound; where its
    order holds, the bonus for further chunk types is left out."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    keyword, vector = (keyword if mode != "vector" else None), (vector if mode != "keyword" else None)
    present = keyword if keyword is not None else vector
    merged = search.fuse(keyword if keyword is not None else present.limit(0), vector if vector is not None else present.limit(0), **settings)
    if reranker is not None:
        merged = reranker(merged)
    return search.group_items(merged, limit), debug_counts(queries, keyword, vector, merged, mode)


def top_ingredients(ingredients: Column, most: int = TOP_INGREDIENTS) -> Column:
    """The first names of a recipe's ingredients: the normalized item, else the item's text, else the line."""
    name = lambda i: F.coalesce(*[F.nullif(i[k], F.lit("")) for k in ("item_normalized", "item_text", "raw_text")])
    return F.slice(F.filter(F.transform(F.coalesce(ingredients, F.array()), name), lambda x: x.isNotNull()), 1, most)


def project(found: DataFrame, structured: DataFrame) -> DataFrame:
    """What a client shows of a result. structured: (item_id, data: struct with schema, yield, prep_time, cook_time, total_time, ingredients;
    confidence)."""
    rows = found.join(structured, "item_id", "left")
    data = F.col("data")
    display = F.struct(F.col("item.title").alias("title"), X.snippet(F.col("item.summary")).alias("snippet"), X.badges(data["yield"], data["cook_time"], data["total_time"], data["prep_time"]).alias("badges"), F.coalesce(F.try_element_at("source_citations", F.lit(1))["label"], F.lit("")).alias("source_label"))
    preview = F.struct(F.lit(PREVIEW_SCHEMA).alias("schema"), data["yield"].alias("yield"), top_ingredients(data["ingredients"]).alias("top_ingredients"))
    return rows.select("query_id", "place", "item_id", F.coalesce(data["schema"], F.lit(SCHEMA)).alias("schema"), "confidence", display.alias("display"), preview.alias("structured_preview"), "document", "matched_chunks", "source_citations")


def previews(top: DataFrame, chunks: DataFrame, per_item: int) -> DataFrame:
    """The chunk texts that a context pack may use: of each result only its first per_item chunks are fetched."""
    some = top.select("query_id", "item_id", "place", F.posexplode(F.slice("chunks", 1, per_item)).alias("pos", "c"))
    return some.select("query_id", "item_id", F.col("place").alias("item_place"), (F.col("pos") + 1).alias("chunk_place"), F.col("c.chunk_id").alias("chunk_id")).join(chunks, "chunk_id")
