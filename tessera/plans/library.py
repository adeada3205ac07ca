"""Queries of whole searches, listings, reviews, runs, answers and evaluations over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import catalog, evaluation, ground, ingest, lifecycle, results, review, runs, search
from tessera.plans.queries import _FUSED_SQL, _JUDGED_SQL, _ITEMS_SQL, _PACK_SQL, _VECTOR_SQL, _WORDS, _judged, _legs, _pack, _vectors
from tessera.plans.registry import query
from tessera.plans.stems_sql import stemmed_search
from tessera.plans.views import LIBRARY_SQL, LINES_SQL, items, library, lines, table

# -- search ------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {LIBRARY_SQL}, asked AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format("text")}[1:2]) AS word FROM benchmark), sizes AS (SELECT query_id, count(*) AS n_terms FROM asked GROUP BY query_id),
hits AS (SELECT query_id, chunk_id, item_id, chunk_type, count(DISTINCT word) AS n_found, count(*) AS score FROM (SELECT chunk_id, item_id, chunk_type, category, unnest({_WORDS.format("text")}) AS word FROM searchable WHERE category = 'src0') JOIN asked USING (word) GROUP BY ALL)
SELECT query_id, chunk_id, item_id, chunk_type, CAST(rank AS BIGINT) AS rank, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits JOIN sizes USING (query_id) WHERE n_found = n_terms) WHERE rank <= 50"""
)
def search_words(spark, sf_dir):
    """Word search over the chunks of ready items at the active version of the books of one category."""
    lib = library(spark, sf_dir)
    rows = results.searchable(lib["chunks"], lib["items"], lib["documents"], search.search_predicate(category="src0"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(F.slice(X.words(F.col("text")), 1, 2)).alias("terms"))
    hits = search.word_leg(rows.withColumn("words", X.words(F.col("text"))), asked)
    return hits.select("query_id", "chunk_id", "item_id", "chunk_type", F.col("rank").cast("long").alias("rank"), F.col("raw_score").alias("score"))


@query(
    f"""WITH {LIBRARY_SQL}, shelf AS (SELECT chunk_id, item_id, text FROM searchable WHERE category = 'src0'),
{stemmed_search("shelf", 2)}
SELECT query_id, chunk_id, item_id, CAST(rank AS INTEGER) AS rank, round(raw_score, 6) AS score FROM found JOIN shelf USING (chunk_id)"""
)
def search_keyword(spark, sf_dir):
    """The stemmed leg over the same tables."""
    lib = library(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.lexemes(F.col("text")).alias("l")).select("query_id", F.array_distinct(F.slice(F.transform("l", lambda x: x["lexeme"]), 1, 2)).alias("terms"))
    hits = results.keyword_search(lib["chunks"], lib["items"], lib["documents"], asked, search.search_predicate(category="src0"))
    return hits.select("query_id", "chunk_id", "item_id", "rank", F.round("raw_score", 6).alias("score"))


def _shelf(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Vectors as chunks: five to an item, four items to a document."""
    chunks, queries = _vectors(spark, sf_dir)
    vecs = chunks.select("item_id").distinct()
    rows = vecs.select("item_id", F.floor(F.col("item_id") / 4).alias("document_id"), F.lit("recipe").alias("item_type"), F.when(F.col("item_id") % 7 == 0, "needs_review").otherwise("ready").alias("status"), (F.col("item_id") % 3 % 2).cast("int").alias("source_version"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"), F.lit("short").alias("summary"))
    docs = rows.select("document_id").distinct().select("document_id", F.lit("recipes").alias("category"), F.when(F.col("document_id") % 2 == 0, "en").otherwise("de").alias("subcategory"), F.lit(0).alias("active_version"), F.concat(F.lit("Book "), F.col("document_id").cast("string")).alias("title"), F.lit("A. Author").alias("author"))
    docs = docs.where("document_id % 10 <> 9")
    return {"chunks": chunks.select("chunk_id", "item_id", "chunk_type"), "embeddings": chunks.select("chunk_id", "provider", "model", "embedding"), "items": rows, "documents": docs, "queries": queries.where("model = 'even'")}


def _found(spark, sf_dir, top_k=50):
    shelf = _shelf(spark, sf_dir)
    return shelf, results.vector_search(shelf["embeddings"], shelf["chunks"], shelf["items"], shelf["documents"], shelf["queries"], search.search_predicate(subcategory="en"), "fake", "even", top_k)


_SHELF_SQL = """found AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS place FROM vec
  WHERE query_label % 2 = 0 AND item_id % 7 <> 0 AND item_id % 3 % 2 = 0 AND (item_id // 4) % 2 = 0 AND (item_id // 4) % 10 <> 9
)"""


@query(f"WITH {_VECTOR_SQL}, {_SHELF_SQL} SELECT query_id, chunk_id, item_id, CAST(place AS BIGINT) AS rank, round(distance, 6) AS distance FROM found WHERE place <= 20")
def search_vector(spark, sf_dir):
    return _found(spark, sf_dir, 20)[1].select("query_id", "chunk_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {_VECTOR_SQL}, {_SHELF_SQL}, merged AS (SELECT query_id, chunk_id, item_id, chunk_type, (CASE chunk_type WHEN 'recipe_summary' THEN 1.2::DOUBLE WHEN 'recipe_full' THEN 1.1::DOUBLE WHEN 'recipe_steps' THEN 1.0::DOUBLE WHEN 'recipe_ingredients' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END) * (1.0::DOUBLE / (60 + place)) AS score FROM found WHERE place <= 50), {_ITEMS_SQL.format("merged")},
m AS (SELECT query_id, item_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY score DESC, chunk_id) AS matched, string_agg(concat('page ', chunk_id % 9), ';' ORDER BY score DESC, chunk_id) AS labels FROM merged GROUP BY ALL)
SELECT query_id, CAST(place AS BIGINT) AS place, item_id, concat('Item ', item_id) AS title, concat('Book ', item_id // 4) AS book, 'A. Author' AS author, round(item_score, 9) AS item_score, matched, labels FROM top_items JOIN m USING (query_id, item_id)"""
)
def search_results(spark, sf_dir):
    """The envelope of a vector search; every chunk cites a span of its own."""
    shelf, hits = _found(spark, sf_dir)
    top, _ = results.search_items(shelf["queries"], None, hits, "vector")
    cited = shelf["chunks"].select("chunk_id", F.array("chunk_id").alias("span_ids"))
    spans = shelf["chunks"].select(F.col("chunk_id").alias("span_id"), (F.col("chunk_id") % 9).alias("page_start"), (F.col("chunk_id") % 9).alias("page_end"))
    out = results.envelope(top, shelf["items"], shelf["documents"], cited, spans)
    joined = lambda c, k, sep: F.array_join(F.transform(c, lambda x: x[k].cast("string")), sep)
    return out.select("query_id", F.col("place").cast("long").alias("place"), "item_id", "item.title", F.col("document.title").alias("book"), F.col("document.author").alias("author"), F.round("item_score", 9).alias("item_score"), joined("matched_chunks", "chunk_id", ",").alias("matched"), joined("source_citations", "label", ";").alias("labels"))


@query(
    f"""WITH {_FUSED_SQL} SELECT q.query_id, 'hybrid' AS mode, coalesce(k.n, 0) AS keyword_candidates, coalesce(v.n, 0) AS vector_candidates, coalesce(m.n, 0) AS merged_chunks, coalesce(m.i, 0) AS grouped_items, false AS rerank_applied
FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN (SELECT query_id, count(*) AS n FROM keyword GROUP BY 1) k USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM vector GROUP BY 1) v USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n, count(DISTINCT item_id) AS i FROM merged GROUP BY 1) m USING (query_id)"""
)
def search_debug(spark, sf_dir):
    return results.search_items(_vectors(spark, sf_dir)[1], *_legs(spark, sf_dir))[1]


@query(
    f"""WITH {_FUSED_SQL}, head AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS h FROM merged), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) AS i, count(*) OVER (PARTITION BY query_id) AS n FROM head WHERE h <= 50 AND query_id % 300 <> 0),
s AS (SELECT m.query_id, m.item_id, m.chunk_type, CASE WHEN n.i IS NOT NULL THEN max(m.score) OVER (PARTITION BY m.query_id) + 1 + (n.n - n.i) ELSE m.score END AS score, m.query_id % 300 <> 0 AS plain FROM merged m LEFT JOIN n ON n.query_id = m.query_id AND n.chunk_id = m.chunk_id),
g AS (SELECT query_id, item_id, max(score) AS best, CASE WHEN bool_or(plain) THEN 0 ELSE least(0.05::DOUBLE * (count(DISTINCT chunk_type) - 1), 0.15::DOUBLE) END AS bonus FROM s GROUP BY ALL)
SELECT query_id, item_id, CAST(place AS BIGINT) AS place, round(best + bonus, 9) AS item_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best + bonus DESC, best DESC, item_id) AS place FROM g) WHERE place <= 10"""
)
def search_reranked(spark, sf_dir):
    """A scorer that lists chunks by falling id, and breaks down for some queries."""

    def scorer(question, listed):
        if int(question) % 300 == 0:
            raise RuntimeError("no answer")
        return sorted((c for c, _ in listed), reverse=True)

    chunks, queries = _vectors(spark, sf_dir)
    texts = chunks.select("chunk_id", F.col("chunk_id").cast("string").alias("text"))
    questions = queries.select("query_id", F.col("query_id").cast("string").alias("question"))
    top, _ = results.search_items(queries, *_legs(spark, sf_dir), reranker=lambda merged: results.rerank(merged, texts, questions, scorer))
    return top.select("query_id", "item_id", F.col("place").cast("long").alias("place"), F.round("item_score", 9).alias("item_score"))


@query(
    """SELECT o_orderkey AS item_id, array_to_string(list(CASE WHEN l_linenumber % 3 = 0 THEN concat('item ', l_partkey) WHEN l_linenumber % 3 = 1 THEN concat('text ', l_partkey) ELSE concat('raw ', l_partkey) END ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) [1:5], ';') AS top_ingredients
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def top_ingredients(spark, sf_dir):
    named = lambda k, word: F.when(F.col("l_linenumber") % 3 == k, F.concat(F.lit(f"{word} "), F.col("l_partkey").cast("string")))
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.coalesce(named(0, "item"), F.when(F.col("l_linenumber") % 2 == 0, "")).alias("item_normalized"), named(1, "text").alias("item_text"), F.concat(F.lit("raw "), F.col("l_partkey").cast("string")).alias("raw_text"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("ingredients"))
    return rows.select(F.col("l_orderkey").alias("item_id"), F.array_join(results.top_ingredients(F.col("ingredients")), ";").alias("top_ingredients"))


# -- catalog -----------------------------------------------------------------------------------------------------------


def _orders(spark, sf_dir):
    """Orders as items and runs of customers' books."""
    status = F.when(F.col("o_orderkey") % 5 == 0, "superseded").when(F.col("o_orderkey") % 5 == 1, "rejected").when(F.col("o_orderstatus") == "F", "ready").otherwise("needs_review")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("source_version"), (F.col("o_orderkey") % 50).cast("int").alias("page_end"), "o_totalprice")


_ORDERS_SQL = """o AS (SELECT o_orderkey AS item_id, o_custkey AS document_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 5 = 0 THEN 'superseded' WHEN o_orderkey % 5 = 1 THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'needs_review' END AS status,
  CAST(o_orderkey % 3 + 1 AS INTEGER) AS source_version, CAST(o_orderkey % 50 AS INTEGER) AS page_end, o_totalprice FROM orders)"""


@query(f"WITH {_ORDERS_SQL}, b AS (SELECT min(o_custkey) AS book FROM orders) SELECT o.item_id, c_name AS document_title, o.status FROM o JOIN b ON o.document_id = b.book JOIN customer ON c_custkey = o.document_id WHERE o.status NOT IN ('superseded', 'rejected') ORDER BY created_at DESC, item_id DESC LIMIT 200")
def book_items(spark, sf_dir):
    book = table(spark, sf_dir, "orders").agg(F.min("o_custkey")).first()[0]
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"))
    return catalog.list_book_items(_orders(spark, sf_dir), docs, book, limit=200).select("item_id", "document_title", "status")


@query(f"WITH {_ORDERS_SQL} SELECT item_id, status, CASE WHEN o_totalprice > 200000 THEN created_at + INTERVAL 1 DAY END AS favourited_at FROM o")
def starred_items(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    later = rows.where("o_totalprice > 200000").select("item_id", (F.col("created_at") + F.expr("INTERVAL 2 DAYS")).alias("created_at"))
    stars = catalog.add_favourites(later.limit(0), later.union(later.select("item_id", F.col("created_at") - F.expr("INTERVAL 1 DAY"))))
    gone = rows.where("o_totalprice <= 200000").select("item_id")
    return catalog.with_stars(rows, catalog.remove_favourites(stars, gone)).select("item_id", "status", "favourited_at")


@query(f"WITH {_ORDERS_SQL} SELECT item_id AS run_id, document_id FROM o JOIN customer ON c_custkey = document_id WHERE c_mktsegment = 'MACHINERY' AND source_version = 2 AND status = 'ready'")
def run_list(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("document_id"))
    return catalog.list_runs(_orders(spark, sf_dir), docs, 2, "ready").select("run_id", "document_id")


@query(
    f"""WITH {_ORDERS_SQL}, i AS (SELECT document_id, count(*) FILTER (WHERE status <> 'rejected') AS total, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'needs_review') AS pending, count(*) AS n_spans FROM o GROUP BY 1),
c AS (SELECT o_custkey AS document_id, count(*) AS n_chunks FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey AS document_id, coalesce(total, 0) AS total, coalesce(ready, 0) AS ready, coalesce(pending, 0) AS needs_review, coalesce(n_spans, 0) AS n_spans, coalesce(n_chunks, 0) AS n_chunks, CASE WHEN coalesce(pending, 0) > 0 THEN 'needs_review' ELSE 'ready' END AS shown_status
FROM customer LEFT JOIN i ON i.document_id = c_custkey LEFT JOIN c ON c.document_id = c_custkey"""
)
def document_details(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.lit("needs_review").alias("status"))
    rows = _orders(spark, sf_dir)
    chunks = table(spark, sf_dir, "lineitem").join(rows.select(F.col("item_id").alias("l_orderkey"), "document_id"), "l_orderkey")
    return catalog.document_details(docs, rows, rows, chunks).select("document_id", "total", "ready", "needs_review", "n_spans", "n_chunks", "shown_status")


@query(
    f"""WITH {_ORDERS_SQL}, d AS (SELECT c_custkey AS document_id, (['ready', 'failed', 'extracting_items', 'indexing'])[CAST(c_custkey % 4 AS INTEGER) + 1] AS status, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 AS INTEGER) END AS active_version FROM customer),
v AS (SELECT d.*, m.newest, status IN ('ready', 'failed') AS terminal FROM d LEFT JOIN (SELECT document_id, max(source_version) AS newest FROM o GROUP BY 1) m USING (document_id)),
s AS (SELECT *, CASE WHEN terminal THEN active_version WHEN active_version IS NULL OR active_version <> coalesce(newest, 1) THEN coalesce(newest, 1) END AS shown FROM v),
f AS (SELECT document_id, arg_max(reason, (failed_at, reason)) AS reason FROM (SELECT user_id AS document_id, event_type AS reason, ts AS failed_at FROM events) GROUP BY 1)
SELECT s.document_id, s.status, s.active_version, CASE WHEN NOT terminal THEN coalesce(newest, 1) END AS current_version, count(o.item_id) AS pages_processed, max(o.page_end) AS pages_total, terminal, any_value(CASE WHEN s.status = 'failed' THEN f.reason END) AS reason
FROM s LEFT JOIN o ON o.document_id = s.document_id AND o.source_version = s.shown LEFT JOIN f ON f.document_id = s.document_id GROUP BY s.document_id, s.status, s.active_version, newest, terminal"""
)
def ingestion_progress(spark, sf_dir):
    states = F.array(*[F.lit(x) for x in ("ready", "failed", "extracting_items", "indexing")])
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.element_at(states, (F.col("c_custkey") % 4 + 1).cast("int")).alias("status"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 3).cast("int")).alias("active_version"))
    failures = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("reason"), F.lit("indexing").alias("last_status"), F.col("ts").alias("failed_at"))
    return catalog.ingestion_status(docs, _orders(spark, sf_dir), failures).withColumn("reason", F.col("failure.reason")).drop("failure")


@query("WITH h AS (SELECT doc_id, length(text) = 0 AS bad, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) SELECT count(*) AS total, count(*) FILTER (WHERE NOT bad AND n = 1) AS created, count(*) FILTER (WHERE NOT bad AND n > 1) AS duplicates, count(*) FILTER (WHERE bad) AS errors FROM h")
def upload_totals(spark, sf_dir):
    content = F.when(F.length("text") > 0, F.concat(F.lit("%PDF-"), "text")).otherwise("").cast("binary")
    files = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("path"), content.alias("content"))
    return catalog.upload_totals(catalog.classify_uploads(files, files.limit(0).select(F.lit("").alias("content_hash"))))


@query(f"WITH {LINES_SQL} SELECT doc_id * 1000000 + page AS span_id, page AS page_start FROM pages WHERE page >= 4 AND page <= 9")
def span_list(spark, sf_dir):
    spans = library(spark, sf_dir)["spans"]
    return catalog.list_spans(spans, 4, 9).select("span_id", "page_start")


@query(
    f"""WITH {_ORDERS_SQL}, n AS (SELECT document_id, max(source_version) AS newest FROM o GROUP BY 1), x AS (SELECT o.*, newest, CASE WHEN item_id % 4 = 0 THEN 'approve' WHEN item_id % 4 = 1 THEN 'reject' END AS decision, document_id % 6 <> 0 AS done FROM o JOIN n USING (document_id)),
y AS (SELECT *, CASE WHEN decision IS NULL THEN NULL WHEN NOT done THEN 'document_busy' WHEN status <> 'needs_review' THEN 'not_pending' WHEN decision = 'approve' AND source_version < newest THEN 'stale' WHEN decision = 'approve' THEN 'indexing' ELSE 'rejected' END AS outcome FROM x)
SELECT item_id, outcome, CASE WHEN outcome IN ('indexing', 'rejected') THEN outcome ELSE status END AS status FROM y"""
)
def review_decisions(spark, sf_dir):
    """Of two decisions for an item the earlier one holds."""
    rows = _orders(spark, sf_dir)
    docs = rows.select("document_id").distinct().select("document_id", F.when(F.col("document_id") % 6 == 0, "indexing").otherwise("ready").alias("status"))
    first = rows.where("item_id % 4 < 2").select("item_id", F.when(F.col("item_id") % 4 == 0, "approve").otherwise("reject").alias("decision"), F.lit(1).alias("at"))
    second = first.select("item_id", F.lit("approve").alias("decision"), F.lit(2).alias("at"))
    return catalog.decide(rows, second.union(first), docs).select("item_id", "outcome", "status")


@query(
    f"""WITH {_ORDERS_SQL} SELECT item_id, CASE WHEN e THEN 'new' ELSE 'old' END AS title, CASE WHEN e THEN '{{"title":"old","body_text":"body"}}' END AS snapshot, CASE WHEN e AND status = 'ready' THEN 'indexing' ELSE status END AS status FROM (SELECT *, item_id % 3 = 0 AND status IN ('ready', 'needs_review') AS e FROM o)"""
)
def edited_items(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("title", F.lit("old")).withColumn("body_text", F.lit("body")).withColumn("snapshot", F.lit(None).cast("string"))
    edits = rows.where("item_id % 3 = 0").select("item_id", F.lit("new").alias("title"), F.lit(None).cast("string").alias("body_text"), F.lit(1).alias("at"))
    return catalog.apply_edits(rows, edits.union(edits.select("item_id", F.lit("newer"), "body_text", F.lit(2)))).select("item_id", "title", "snapshot", "status")


@query(f"WITH {_ORDERS_SQL} SELECT item_id, document_id FROM o WHERE status = 'needs_review' AND document_id % 6 <> 0")
def review_queue(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    docs = rows.select("document_id").distinct().select("document_id", F.when(F.col("document_id") % 6 == 0, "indexing").otherwise("ready").alias("status"))
    return catalog.review_queue(rows, docs).select("item_id", "document_id")


@query("SELECT o_orderkey AS item_id, string_agg(CAST(s AS VARCHAR), ',' ORDER BY p) AS span_ids FROM (SELECT o_orderkey, l_linenumber AS s, min(CASE WHEN l_linenumber = 5 THEN 0 ELSE l_linenumber END) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber IN (1, 2, 5) GROUP BY ALL) GROUP BY 1")
def item_spans(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id")).distinct()
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.array(*[F.col("o_orderkey") * 10 + k for k in (5, 1, 2, 5, 1)]).alias("span_ids"))
    out = catalog.ordered_spans(rows, spans)
    return out.select("item_id", F.array_join(F.transform("span_ids", lambda s: (s % 10).cast("string")), ",").alias("span_ids"))


# -- review ------------------------------------------------------------------------------------------------------------


def _flagged(spark, sf_dir):
    """Documents as recipes whose lines are ingredients; warnings, scores and recorded thresholds from the id."""
    doc = F.col("doc_id")
    scores = F.transform(F.split("text", "\n", -1), lambda x, k: F.struct(F.when(k % 4 == 3, k + 100).cast("int").alias("position"), F.when((k + doc) % 6 > 0, ((k + doc) % 10 / 10.0)).alias("normalization")))
    record = F.struct(F.when(doc % 2 == 0, 0.6).alias("overall"), F.lit(0.7).alias("boundary"), F.lit(0.3).alias("normalization"), *[F.lit(v).alias(k) for k, v in list(ingest.THRESHOLDS.items())[3:]])
    warnings = F.array_compact(F.array(F.when(doc % 3 == 0, "low_overall_confidence"), F.when(doc % 4 == 0, "low_normalization_confidence"), F.when(doc % 5 == 0, "odd words")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(doc % 7 == 0, "ready").otherwise("needs_review").alias("status"), warnings.alias("warnings"), scores.alias("ingredients"), review.resolve_thresholds(record).alias("t"))
    return rows.select("doc_id", "t.source", F.explode_outer(review.review_reasons(F.col("status"), F.col("warnings"), doc % 100 / 100.0, F.lit(0.4), F.col("ingredients"), F.col("t.values"))).alias("r"))


@query(
    """WITH n AS (SELECT doc_id, CASE WHEN (k - 1) % 4 = 3 THEN k + 99 ELSE k - 1 END AS position, CAST((k - 1 + doc_id) % 10 AS DOUBLE) / 10 AS score FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents) WHERE (k - 1 + doc_id) % 6 > 0),
b AS (SELECT doc_id, min(score) AS lowest FROM n GROUP BY 1), t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'recorded' ELSE 'current' END AS source, CASE WHEN doc_id % 2 = 0 THEN 0.6 ELSE 0.5 END AS o, CASE WHEN doc_id % 2 = 0 THEN 0.3 ELSE 0.5 END AS z, lowest FROM documents LEFT JOIN b USING (doc_id)),
p AS (SELECT doc_id, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM (SELECT n.*, bool_or(score < z) OVER (PARTITION BY doc_id) AS any_below, z, lowest FROM n JOIN t USING (doc_id)) WHERE CASE WHEN any_below THEN score < z ELSE score = lowest END GROUP BY 1),
r AS (SELECT doc_id, 'low_overall_confidence' AS code, doc_id % 100 / 100.0::DOUBLE AS value, o AS threshold, NULL AS positions FROM t WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'low_normalization_confidence', lowest, z, p.positions FROM t LEFT JOIN p USING (doc_id) WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'llm_warning', NULL, NULL, NULL FROM t WHERE doc_id % 5 = 0)
SELECT t.doc_id, t.source, r.code, round(r.value, 6) AS value, CAST(r.threshold AS DOUBLE) AS threshold, r.positions FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND t.doc_id % 7 <> 0"""
)
def review_reasons(spark, sf_dir):
    places = F.array_join(F.transform(F.array_sort("r.positions"), lambda p: p.cast("string")), ",")
    return _flagged(spark, sf_dir).select("doc_id", "source", "r.code", F.round("r.value", 6).alias("value"), "r.threshold", places.alias("positions"))


@query(
    """WITH x AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g')) <> '') AS i, doc_id % 3 > 0 AS has_steps FROM documents), y AS (SELECT *, array_to_string(list_concat(['A title'], CASE WHEN len(i) > 0 THEN [array_to_string(i, chr(10))] ELSE [] END, CASE WHEN has_steps THEN ['stir well'] ELSE [] END), chr(10) || chr(10)) AS body FROM x),
z AS (SELECT *, NOT has_steps AND len(i) BETWEEN 3 AND 12 AND length(body) <= 400 AS assembly FROM y)
SELECT doc_id, 'indexing' AS status, sha256(body) AS body_hash, array_to_string(list_filter([CASE WHEN len(i) = 0 THEN 'no_ingredients' END, CASE WHEN NOT has_steps AND NOT assembly THEN 'no_steps' END, CASE WHEN length(trim(body)) < 200 AND NOT assembly THEN 'recipe_too_short' END, CASE WHEN length(trim(body)) > 20000 THEN 'recipe_too_long' END], lambda w: w IS NOT NULL), ',') AS warnings, CASE WHEN assembly THEN 'assembly' ELSE '' END AS notes FROM z"""
)
def authored_recipes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("item_id"), F.lit("A title").alias("title"), F.split("text", "\n", -1).alias("ingredients"), F.when(F.col("doc_id") % 3 > 0, F.array(F.lit("stir well"), F.lit("  "))).otherwise(F.array().cast("array<string>")).alias("steps"))
    out = review.authored(rows)
    return out.select(F.col("item_id").alias("doc_id"), "status", F.sha2("body_text", 256).alias("body_hash"), F.array_join("warnings", ",").alias("warnings"), F.array_join("notes", ",").alias("notes"))


# -- runs and lifecycle ------------------------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT o_orderkey AS document_id, (['queued', 'extracting_items', 'ready', 'failed', 'indexing'])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS status FROM orders), f AS (SELECT l_orderkey AS document_id, arg_min((['EmptyPdfError', 'OddError', 'LLMTechnicalError'])[CAST(l_linenumber % 3 AS INTEGER) + 1], (l_linenumber, (['EmptyPdfError', 'OddError', 'LLMTechnicalError'])[CAST(l_linenumber % 3 AS INTEGER) + 1])) AS error FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT document_id, CASE WHEN error IS NOT NULL AND d.status IN ('queued', 'extracting_items', 'indexing') THEN 'failed' ELSE d.status END AS status, CASE WHEN error IS NOT NULL AND d.status IN ('queued', 'extracting_items', 'indexing') THEN d.status END AS last_status,
  CASE WHEN d.status IN ('queued', 'extracting_items', 'indexing') THEN CASE error WHEN 'EmptyPdfError' THEN 'pdf_empty' WHEN 'LLMTechnicalError' THEN 'llm_extraction_failed' WHEN 'OddError' THEN 'unknown_error' END END AS reason FROM d LEFT JOIN f USING (document_id)"""
)
def failed_documents(spark, sf_dir):
    states, errors = (F.array(*[F.lit(x) for x in xs]) for xs in (("queued", "extracting_items", "ready", "failed", "indexing"), ("EmptyPdfError", "OddError", "LLMTechnicalError")))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.element_at(states, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("status"))
    failed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"), F.element_at(errors, (F.col("l_linenumber") % 3 + 1).cast("int")).alias("error"), F.lit("broke").alias("message"), F.col("l_linenumber").alias("failed_at"))
    none = failed.limit(0).select("document_id", F.lit("").alias("last_status"), F.lit("").alias("reason"), F.lit("").alias("error_message"), "failed_at")
    docs, failures = runs.mark_failed(docs, none, failed)
    return docs.join(failures.select("document_id", "last_status", "reason"), "document_id", "left").select("document_id", "status", "last_status", "reason")


def _windows(spark, sf_dir):
    """Turns of conversations as windows; a turn's prompt is its text, known by its digest."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("window"), "text", F.sha2("text", 256).alias("input_hash"))
    return rows.withColumn("prompt", runs.render_prompt(F.lit("read: {window}"), F.col("text")))


@query("SELECT conv_id AS document_id, turn AS window, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS INTEGER) AS \"commit\" FROM conversations")
def window_commits(spark, sf_dir):
    return runs.commit_batches(_windows(spark, sf_dir), size=3).select("document_id", "window", "commit")


@query(
    """WITH w AS (SELECT conv_id, turn, text, sha256(text) AS h FROM conversations), c AS (SELECT DISTINCT h FROM w WHERE h < '4'), a AS (SELECT *, length(text) % 5 AS k FROM w)
SELECT conv_id AS document_id, turn AS window, CASE WHEN h < '4' THEN 'success' WHEN k = 0 THEN 'rejected' WHEN k = 1 THEN 'rejected' ELSE 'success' END AS status, h < '4' AS cached, CASE WHEN h < '4' THEN 'known' WHEN k = 0 THEN NULL WHEN k = 1 THEN '{"items": [{"title": "t"}]}' ELSE '{"items": [{"title": "t", "body_text": "b"}]}' END AS output_json FROM a"""
)
def extraction_runs(spark, sf_dir):
    """A provider that refuses some windows and leaves out a field in others; a quarter of the inputs have runs already."""

    def provider(prompts):
        kinds = [(len(p) - len("read: ")) % 5 for p in prompts]
        return [(None, "refused") if k == 0 else ('{"items": [{"title": "t"}]}', None) if k == 1 else ('{"items": [{"title": "t", "body_text": "b"}]}', None) for k in kinds]

    rows = _windows(spark, sf_dir)
    known = rows.where("input_hash < '4'").select("input_hash", F.lit("success").alias("status"), F.lit("known").alias("output_json"), F.col("window").alias("created_at"), F.col("document_id").alias("run_id"))
    old = known.select("input_hash", F.lit("failed").alias("status"), F.lit("no").alias("output_json"), (F.col("created_at") + 100).alias("created_at"), "run_id")
    out = runs.extract(rows, known.union(old), provider, ["document_id", "window"])
    return out.select("document_id", "window", "status", "cached", "output_json")


@query(
    """WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS k, min(l_extendedprice) AS p, min(l_returnflag) AS f, min(l_linestatus) AS s, min(CAST(l_quantity AS BIGINT)) AS size FROM lineitem GROUP BY 1),
q AS (SELECT k, size, row_number() OVER (ORDER BY k) AS n, sum(size) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS running FROM i WHERE f = 'N' AND s = 'O'), t AS (SELECT k FROM q WHERE n = 1 OR (n <= 500 AND running <= 9000))
SELECT k AS item_id, CASE WHEN k IN (SELECT k FROM t) THEN 'submitting' WHEN f = 'N' THEN 'pending' ELSE 'succeeded' END AS status, CASE WHEN k IN (SELECT k FROM t) THEN 'b1' END AS batch_id FROM i"""
)
def batch_claim(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id")).agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min(F.col("l_quantity").cast("long")).alias("size"))
    rows = rows.select("item_id", "size", F.when(F.col("f") == "N", "pending").otherwise("succeeded").alias("status"), F.lit(None).cast("string").alias("batch_id"), F.when(F.col("s") == "O", "v2").otherwise("v1").alias("schema_version"))
    return runs.claim_batch(rows, "b1", "v2", ["item_id"], "size", 500, 9000).select("item_id", "status", "batch_id")


@query(
    """WITH b AS (SELECT o_orderkey AS batch_id, CASE WHEN o_orderstatus = 'P' THEN 'ended' ELSE 'submitting' END AS s, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 THEN 'submitted' WHEN o_orderdate < TIMESTAMP '1995-01-01' - INTERVAL 15 MINUTE THEN 'failed' END AS a FROM orders), x AS (SELECT batch_id, CASE WHEN s = 'submitting' THEN a END AS moved, s FROM b)
SELECT l_orderkey * 10 + l_linenumber AS item_id, max(CASE moved WHEN 'failed' THEN 'pending' WHEN 'submitted' THEN 'submitted' ELSE 'submitting' END) AS status, max(CASE WHEN moved = 'failed' THEN NULL ELSE batch_id END) AS batch_id, max(coalesce(moved, s)) AS batch_status FROM lineitem JOIN x ON batch_id = l_orderkey GROUP BY 1"""
)
def batch_answers(spark, sf_dir):
    """A third of the batches is refused, a third accepted, of the rest those that are late go back."""
    o = table(spark, sf_dir, "orders")
    batches = o.select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "P", "ended").otherwise("submitting").alias("processing_status"), F.lit(None).cast("string").alias("provider_batch_id"), F.col("o_orderdate").alias("created_at"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.col("l_orderkey").alias("batch_id"), F.lit("submitting").alias("status")).distinct()
    answers = batches.where("batch_id % 3 < 2").select("batch_id", F.when(F.col("batch_id") % 3 == 1, F.concat(F.lit("p"), F.col("batch_id").cast("string"))).alias("provider_batch_id"))
    late = runs.stale_batches(batches.where("batch_id % 3 = 2"), F.lit("1995-01-01").cast("timestamp_ntz"))
    after, moved = runs.settle_batches(batches, rows, answers.union(late))
    state = after.select(F.col("batch_id").alias("b"), F.col("processing_status").alias("batch_status"))
    return moved.withColumn("b", F.floor(F.col("item_id") / 10)).join(state, "b").select("item_id", "status", "batch_id", "batch_status")


@query(f"WITH {_ORDERS_SQL} SELECT item_id, concat('w', item_id % 8) AS window_key, item_id % 8 >= 3 AS carried FROM o")
def carried_items(spark, sf_dir):
    rows = _orders(spark, sf_dir).select("item_id", "run_id")
    made = rows.select("run_id", F.concat(F.lit("w"), (F.col("run_id") % 8).cast("string")).alias("window_key"))
    return runs.produced_by(rows, made, made.where("run_id % 8 < 3")).select("item_id", "window_key", "carried")


@query(
    f"""WITH {_ORDERS_SQL}, r AS (SELECT DISTINCT document_id, source_version AS v FROM o WHERE status = 'ready' AND item_id % 2 = 0), d AS (SELECT c_custkey AS document_id, 2 AS v, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 + 1 AS INTEGER) END AS a FROM customer)
SELECT d.document_id, CASE WHEN r.v IS NOT NULL THEN 'ready' ELSE 'needs_review' END AS status, CASE WHEN r.v IS NOT NULL AND (a IS NULL OR a < d.v) THEN d.v ELSE a END AS active_version FROM d LEFT JOIN r ON r.document_id = d.document_id AND r.v = d.v"""
)
def version_hand_off(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.lit(2).alias("version"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 3 + 1).cast("int")).alias("active_version"))
    rows = _orders(spark, sf_dir)
    return lifecycle.hand_off(docs, rows, rows.where("item_id % 2 = 0").select("item_id"), True).select("document_id", "status", "active_version")


@query(
    """WITH i AS (SELECT o_custkey AS document_id, o_orderkey AS h, CASE WHEN o_orderkey % 7 = 0 THEN 'pending' ELSE 'submitted' END AS s, o_orderkey % 3 AS n, o_orderkey % 5 AS k, o_orderkey % 11 = 0 AS had FROM orders), x AS (SELECT *, s = 'submitted' AND k < 4 AS active, k = 0 AS good, k IN (1, 2) AND n < 2 AS again FROM i)
SELECT h AS input_hash, CASE WHEN NOT active THEN s WHEN had OR good THEN 'succeeded' WHEN again THEN 'pending' ELSE 'rejected' END AS new_status, CASE WHEN NOT active OR had THEN NULL WHEN good THEN 'success' WHEN again THEN NULL ELSE 'rejected' END AS run_status FROM x"""
)
def batch_outcomes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = o.select(F.col("o_custkey").alias("document_id"), F.lit(1).alias("source_version"), key.alias("input_hash"), F.when(key % 7 == 0, "pending").otherwise("submitted").alias("status"), (key % 3).alias("submit_attempts"))
    kind = F.when(key % 5 == 0, "succeeded").when(key % 5 == 1, "expired").when(key % 5 == 2, "errored").otherwise("succeeded")
    told = o.where(key % 5 < 4).select(key.alias("input_hash"), kind.alias("result_type"), (key % 5 == 0).alias("parsed"), F.lit(True).alias("valid"), F.lit(True).alias("retryable"), F.lit(1).alias("at"))
    had = o.where(key % 11 == 0).select(F.col("o_custkey").alias("document_id"), F.lit(1).alias("source_version"), key.alias("input_hash"))
    again = told.select("input_hash", F.lit("succeeded").alias("result_type"), F.lit(False).alias("parsed"), F.lit(True).alias("valid"), F.lit(False).alias("retryable"), F.lit(2).alias("at"))
    return lifecycle.batch_results(rows, again.union(told), had).select("input_hash", "new_status", "run_status")


@query("SELECT o_custkey AS document_id, 1 AS source_version FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'P') = 0")
def finished_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.lit(1).alias("source_version"), F.when(F.col("o_orderstatus") == "P", "submitted").otherwise("succeeded").alias("status"))
    return lifecycle.finished(rows)


@query(
    f"""WITH {_ORDERS_SQL} SELECT item_id, CASE WHEN status = 'ready' AND created_at < TIMESTAMP '1996-01-01' - INTERVAL 15 MINUTE THEN 'needs_review' WHEN status = 'ready' THEN 'indexing' ELSE status END AS status,
(['fresh', 'reuse', 'resume', 'embed', 'index', 'skip'])[CAST(item_id % 6 AS INTEGER) + 1] AS resume, CASE WHEN item_id % 3 = 0 THEN 'reuse_source_spans' ELSE 'new_source_version' END AS mode FROM o"""
)
def stuck_and_resumed(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("status", F.when(F.col("status") == "ready", "indexing").otherwise(F.col("status"))).withColumn("updated_at", F.col("created_at"))
    out = lifecycle.stuck_items(rows, F.lit("1996-01-01").cast("timestamp_ntz"))
    k = F.col("item_id") % 6
    state = F.when(k < 2, "queued").when(k == 2, "extracting_items").when(k == 3, "creating_chunks").when(k == 4, "embedding_chunks").otherwise("ready")
    mode = lifecycle.reprocess_mode(F.lit(True), F.when(F.col("item_id") % 3 != 1, True), F.col("item_id") % 3 == 0)
    return out.select("item_id", "status", lifecycle.resume_point(state, k == 1).alias("resume"), mode.alias("mode"))


@query(f"WITH {_ORDERS_SQL} SELECT item_id, arg_max(r.o_orderkey, (r.o_orderdate, r.o_orderkey)) AS run_id FROM o LEFT JOIN orders r ON r.o_custkey = o.document_id AND r.o_orderstatus = 'F' GROUP BY item_id")
def cached_windows(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))
    return catalog.cached_runs(_orders(spark, sf_dir).select("item_id", "document_id"), done, ["document_id"]).select("item_id", "run_id")


@query(
    f"""WITH {_ORDERS_SQL} SELECT item_id, 'recipe_full' AS chunk_type, concat('body ', item_id) AS text FROM o WHERE status = 'ready' AND item_id % 3 > 0 UNION ALL SELECT item_id, 'recipe_title', 'title' FROM o WHERE status = 'ready' AND item_id % 3 > 0"""
)
def ready_chunks(spark, sf_dir):
    """A third of the items have chunks already."""
    none = F.lit(None).cast("string")
    rows = _orders(spark, sf_dir).withColumn("title", F.lit("title")).withColumn("body_text", F.concat(F.lit("body "), F.col("item_id").cast("string")))
    rows = rows.select("*", *[none.alias(k) for k in ("summary", "ingredients_text", "steps_text")])
    return ingest.chunk_ready(rows, rows.where("item_id % 3 = 0").select("item_id")).select("item_id", "chunk_type", "text")


@query(f"WITH {_ORDERS_SQL} SELECT item_id AS chunk_id, 'p' AS provider, 'm2' AS model, CAST(item_id % 100 AS DOUBLE) AS first FROM o WHERE item_id % 4 > 0")
def embedded_chunks(spark, sf_dir):
    """A quarter of the chunks has its embedding in this space, all have one in another."""
    chunks = _orders(spark, sf_dir).select(F.col("item_id").alias("chunk_id"), F.col("item_id").cast("string").alias("text"))
    known = chunks.select("chunk_id", F.lit("p").alias("provider"), F.lit("m1").alias("model")).union(chunks.where("chunk_id % 4 = 0").select("chunk_id", F.lit("p"), F.lit("m2")))
    out = ingest.embed_chunks(chunks, known, lambda texts: [[float(int(t) % 100), 1.0] for t in texts], ("p", "m2"))
    return out.select("chunk_id", "provider", "model", F.element_at("embedding", 1).cast("double").alias("first"))


@query("SELECT conv_id AS document_id, min(turn) AS window, sha256(text) AS input_hash FROM conversations WHERE sha256(text) >= '8' GROUP BY conv_id, sha256(text)")
def unregistered_windows(spark, sf_dir):
    rows = _windows(spark, sf_dir).withColumn("source_version", F.lit(1))
    return ingest.unregistered(rows, rows.where("input_hash < '8'")).select("document_id", "window", "input_hash")


@query(f"WITH {LINES_SQL} SELECT doc_id, page, 'pages-v1' AS extractor, page AS page_end FROM pages")
def span_locators(spark, sf_dir):
    rows = ingest.page_spans(lines(spark, sf_dir).withColumnRenamed("doc_id", "document_id"))
    return rows.select(F.col("document_id").alias("doc_id"), "page", F.get_json_object("locator", "$.meta.extractor_identity").alias("extractor"), X.json_int(F.col("locator"), "$.page_end").alias("page_end"))


@query(
    """SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS text, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS created FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"""
)
def upserted_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"))
    old = o.where("chunk_id % 2 = 0").select("chunk_id", F.lit("old").alias("text"), F.lit(1).alias("created"))
    new = o.where("chunk_id % 3 = 0").select("chunk_id", F.lit("new").alias("text"), F.lit(2).alias("created"))
    return ingest.upsert(old, new, ["chunk_id"], ["created"])


# -- answers -----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_PACK_SQL}, c AS (SELECT query_id, string_agg(cite_id, ', ' ORDER BY p, q) AS cites FROM (SELECT query_id, cite_id, min(ip) AS p, min(chunk_place) AS q FROM (SELECT pack.*, item_place AS ip FROM pack JOIN (SELECT DISTINCT query_id, item_id, item_place FROM rows) USING (query_id, item_id)) GROUP BY ALL) GROUP BY 1), i AS (SELECT query_id, string_agg(CAST(item_id AS VARCHAR), ', ' ORDER BY item_id) AS ids, count(*) AS n FROM (SELECT DISTINCT query_id, item_id FROM pack) GROUP BY 1)
SELECT query_id, concat('Allowed citation IDs: ', cites, chr(10), 'Allowed knowledge_item_ids: ', ids) AS footer, n AS n_context_items, (SELECT count(DISTINCT cite_id) FROM pack p WHERE p.query_id = c.query_id) AS n_citations FROM c JOIN i USING (query_id)"""
)
def answer_footer(spark, sf_dir):
    pack = _pack(spark, sf_dir)
    return ground.allowed_ids(pack).join(ground.pack_counts(pack.select("query_id").distinct(), pack), "query_id")


@query(
    f"""WITH {_PACK_SQL}, u AS (SELECT query_id, cite_id, min((r, p)) AS first FROM (SELECT o_custkey AS query_id, o_orderkey AS r, unnest([1, 2]) AS p, concat('cite_', CAST((o_orderkey + unnest([1, 2])) % 4 AS BIGINT)) AS cite_id FROM orders) GROUP BY ALL), k AS (SELECT query_id, cite_id, min(span_id) AS span_id, min(item_id) AS item_id FROM pack GROUP BY ALL)
SELECT query_id, cite_id, span_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM u JOIN k USING (query_id, cite_id)"""
)
def answer_citations(spark, sf_dir):
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("recommendation"), F.array(*[F.concat(F.lit("cite_"), ((F.col("o_orderkey") + k) % 4).cast("string")) for k in (1, 2)]).alias("cite_ids"))
    out = ground.rebuilt_citations(answers, _pack(spark, sf_dir))
    return out.select("query_id", "cite_id", "span_id", "item_id", F.col("place").cast("long").alias("place"))


@query(
    f"""WITH {_PACK_SQL}, a AS (SELECT o_custkey AS query_id, o_orderkey AS item_id, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [NULL] ELSE ['cite_1', 'cite_2'] END) AS cite_id FROM orders), owned AS (SELECT DISTINCT query_id, cite_id, item_id AS owner FROM pack), known AS (SELECT DISTINCT query_id, item_id, true AS k FROM pack)
SELECT query_id, count(*) FILTER (WHERE k IS NULL) AS unknown_items, count(*) FILTER (WHERE cite_id IS NOT NULL AND owner IS NULL) AS unknown, count(*) FILTER (WHERE owner <> a.item_id) AS wrong_owner, count(*) FILTER (WHERE cite_id IS NULL) AS uncited, count(cite_id) AS total,
  count(*) FILTER (WHERE k IS NULL OR cite_id IS NULL OR owner IS NULL OR owner <> a.item_id) = 0 AS valid FROM a LEFT JOIN owned USING (query_id, cite_id) LEFT JOIN known USING (query_id, item_id) GROUP BY query_id"""
)
def answer_checks(spark, sf_dir):
    """Answers of which some recommendations cite nothing."""
    cites = F.when(F.col("o_orderkey") % 3 > 0, F.array(F.lit("cite_1"), F.lit("cite_2"))).otherwise(F.array().cast("array<string>"))
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("recommendation"), F.col("o_orderkey").alias("item_id"), cites.alias("cite_ids"))
    return ground.check_citations(answers, _pack(spark, sf_dir))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no_results' WHEN o_orderkey % 5 = 0 THEN 'no_context' WHEN o_orderkey % 3 = 0 THEN 'technical_error' WHEN o_orderkey % 2 = 0 THEN 'unparsable' WHEN o_orderstatus <> 'F' THEN 'invalid' ELSE 'answered' END AS status,
CASE o_orderkey % 5 WHEN 0 THEN 'answer-summary-v2' WHEN 1 THEN 'answer-comparison-v2' WHEN 2 THEN 'answer-direct-answer-v2' ELSE 'answer-recommendation-v2' END AS prompt_version FROM orders"""
)
def answer_states(spark, sf_dir):
    k = F.col("o_orderkey")
    style = F.when(k % 5 == 0, "summary").when(k % 5 == 1, "comparison").when(k % 5 == 2, "direct_answer").when(k % 5 == 3, "rhyme")
    state = ground.answer_status(F.when(k % 7 > 0, k), k % 5, F.when(k % 3 == 0, True), k % 2 > 0, F.when(F.col("o_orderstatus") == "F", True))
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("status"), ground.prompt_version_of(style).alias("prompt_version"))


def _menus(spark, sf_dir):
    """Customers plan a menu: their first four lines of orders are courses, candidates are parts."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.groupBy(F.col("o_custkey").alias("request_id"), F.col("l_linenumber").alias("course"), F.col("l_partkey").alias("item_id")).agg(F.max(F.round(F.col("l_discount") + F.col("l_tax"), 2)).alias("score"))
    cands = rows.where("course <= 4")
    plan = cands.where("course < 4 OR request_id % 2 = 0").select("request_id", "course").distinct().withColumn("slot", F.concat(F.lit("slot "), F.col("course").cast("string")))
    return plan, cands


_MENUS_SQL = """cands AS (SELECT o_custkey AS request_id, l_linenumber AS course, l_partkey AS item_id, max(round(l_discount + l_tax, 2)) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 4 GROUP BY ALL),
plan AS (SELECT DISTINCT request_id, course FROM cands WHERE course < 4 OR request_id % 2 = 0), best AS (SELECT request_id, course, arg_max(item_id, (score, item_id)) AS best_item, min(item_id) AS menu_item FROM cands GROUP BY ALL)"""


@query(
    f"""WITH {_MENUS_SQL} SELECT p.request_id, p.course, concat('slot ', p.course) AS slot, CASE WHEN p.request_id % 3 = 0 THEN CASE WHEN p.course < 3 THEN menu_item END ELSE best_item END AS item_id,
CASE WHEN p.request_id % 3 <> 0 THEN 'fallback' WHEN min(p.course) OVER (PARTITION BY p.request_id) >= 3 THEN 'empty' ELSE 'menu' END AS status FROM plan p LEFT JOIN best USING (request_id, course)"""
)
def menu_payloads(spark, sf_dir):
    plan, cands = _menus(spark, sf_dir)
    menu = cands.where("course < 3").groupBy("request_id", "course").agg(F.min("item_id").alias("item_id"))
    valid = plan.select("request_id").distinct().withColumn("valid", F.col("request_id") % 3 == 0)
    return ground.menu_payload(plan, menu, cands, valid)


@query(
    f"""WITH {_MENUS_SQL}, m AS (SELECT request_id, course, min(item_id) AS item_id FROM cands GROUP BY ALL), a AS (SELECT DISTINCT request_id, course, item_id FROM cands WHERE score >= 0.05), r AS (SELECT m.*, p.course IS NULL AS unplanned, a.item_id IS NULL AS unbound FROM m LEFT JOIN plan p USING (request_id, course) LEFT JOIN a USING (request_id, course, item_id)),
c AS (SELECT request_id, count(*) FILTER (WHERE unplanned) AS unplanned, count(*) FILTER (WHERE unbound) AS unbound, count(*) - count(DISTINCT item_id) AS reused, count(*) FILTER (WHERE course = 2) AS uncited FROM r GROUP BY 1)
SELECT request_id, unplanned, unbound, reused, uncited, unplanned + unbound + reused + uncited = 0 AS valid FROM c"""
)
def menu_check(spark, sf_dir):
    """A menu of the least part of each course; what scores under 0.05 was never assigned, the second course is without citations."""
    plan, cands = _menus(spark, sf_dir)
    menu = cands.groupBy("request_id", "course").agg(F.min("item_id").alias("item_id")).withColumn("cite_ids", F.when(F.col("course") == 2, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), F.col("item_id").cast("string")))))
    pack = menu.select(F.col("request_id").alias("query_id"), F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("cite_id"), "item_id").distinct()
    return ground.check_menu(menu, plan, cands.where("score >= 0.05"), pack).select("request_id", "unplanned", "unbound", "reused", "uncited", "valid")


@query(
    """WITH c AS (SELECT o_custkey AS request_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, lower(trim(o_orderpriority)) AS slot, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('q', o_orderkey) END AS q FROM orders), g AS (SELECT * FROM c WHERE q <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY request_id, slot ORDER BY pos) AS n FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS course FROM f WHERE n = 1)
SELECT request_id, CAST(course AS INTEGER) AS course, slot, q AS query FROM k WHERE course <= 3 UNION ALL SELECT DISTINCT o_custkey, 1, 'main', '' FROM orders WHERE o_custkey NOT IN (SELECT request_id FROM k)"""
)
def menu_plans(spark, sf_dir):
    course = F.struct("o_orderkey", F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("slot"), F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.concat(F.lit("q"), F.col("o_orderkey").cast("string"))).alias("query"))
    plans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("request_id")).agg(F.sort_array(F.collect_list(course)).alias("courses"))
    return ground.plan_courses(plans, 3)


# -- evaluation --------------------------------------------------------------------------------------------------------


def _fixtures(spark, sf_dir):
    """Orders as expected recipes with their lines as ingredients; what was found lacks some lines, and some words differ."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    word = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = F.struct("l_linenumber", word("Line ", "l_partkey").alias("raw_text"), F.col("l_quantity").alias("quantity_value"), F.when(F.col("l_tax") > 0.04, "cup").alias("unit_normalized"), word("part ", "l_partkey").alias("item_normalized"), F.col("l_returnflag").alias("preparation"))
    rows = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(one)).alias("lines")).join(o, "o_orderkey")
    odd = F.filter("lines", lambda x: x["l_linenumber"] % 3 > 0)
    seen = F.transform(odd, lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), F.upper(x["raw_text"]).alias("raw_text"), (x["quantity_value"] + F.when(x["l_linenumber"] % 2 == 0, 1).otherwise(0)).alias("quantity_value"), x["unit_normalized"].alias("unit_normalized"), x["item_normalized"].alias("item_normalized"), x["preparation"].alias("preparation")))
    k = F.col("o_orderkey")
    time = lambda c: F.concat(c.cast("string"), F.lit(" min"))
    recipe = lambda lines_, n, title: F.struct(title.alias("title"), F.when(k % 4 > 0, F.lit("4 servings")).alias("yield"), time(k % 50).alias("prep_time"), F.when(k % 3 == 0, time(k % 60 + n)).alias("cook_time"), F.lit(None).cast("string").alias("total_time"), lines_.alias("ingredients"), F.array_repeat(F.lit("step"), F.when(k % 6 == 0, n).otherwise(1).cast("int")).alias("steps"), F.array(F.lit("s1"), F.concat(F.lit("s"), (k % (2 + n)).cast("string"))).alias("source_span_ids"))
    out = rows.select("o_orderkey", recipe(F.col("lines"), 0, F.col("o_orderpriority")).alias("expected"), F.when(k % 10 > 0, recipe(seen, 1, F.when(k % 5 > 1, F.lower("o_orderpriority")).otherwise(F.lit("other")))).alias("found"), (k % 100 / 100.0).alias("confidence"))
    return out


@query(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS dup FROM lineitem), s AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 3 > 0) AS m, 5 * count(*) FILTER (WHERE l_linenumber % 3 > 0) - count(*) FILTER (WHERE l_linenumber % 3 > 0 AND l_linenumber % 2 = 0) AS hits, max(dup) AS dup FROM l GROUP BY 1),
k AS (SELECT o.o_orderkey, o_orderkey AS k, o_orderpriority, n, m, hits::DOUBLE AS hits, dup FROM orders o JOIN s USING (o_orderkey))
SELECT o_orderkey, k % 5 > 1 AND o_orderpriority = lower(o_orderpriority) AS title_exact, k % 5 > 1 AS title_normalized, CASE WHEN k % 4 > 0 THEN true END AS "yield", true AS prep_time, CASE WHEN k % 3 = 0 THEN false END AS cook_time, n = m AS ingredient_count, k % 6 <> 0 AS step_count,
round(CASE WHEN m = 0 THEN 0 ELSE 2 * (hits / (5 * m)) * (hits / (5 * n)) / (hits / (5 * m) + hits / (5 * n)) END, 6) AS ingredients_f1 FROM k WHERE k % 10 > 0 AND dup = 1"""
)
def recipe_scores(spark, sf_dir):
    """Recipes that name no part twice."""
    distinct = F.size(F.array_distinct(F.transform("expected.ingredients", lambda i: i["item_normalized"]))) == F.size("expected.ingredients")
    out = evaluation.field_scores(_fixtures(spark, sf_dir).where(distinct)).where("scores IS NOT NULL")
    return out.select("o_orderkey", *[F.col(f"scores.{c}").alias(c) for c in ("title_exact", "title_normalized", "yield", "prep_time", "cook_time", "ingredient_count", "step_count")], F.round("scores.ingredients_f1", 6).alias("ingredients_f1"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 3 > 0) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), f AS (SELECT * FROM x WHERE k % 10 > 0)
SELECT 'count.fixtures' AS metric, CAST(count(*) AS DOUBLE) AS value FROM x UNION ALL SELECT 'count.success', CAST(count(*) AS DOUBLE) FROM f UNION ALL SELECT 'success_rate', round(avg(CASE WHEN k % 10 > 0 THEN 1.0 ELSE 0.0 END), 6) FROM x UNION ALL SELECT 'mean_confidence', round(avg(k % 100 / 100.0::DOUBLE), 6) FROM f
UNION ALL SELECT 'accuracy.title_normalized', round(avg(CASE WHEN k % 5 > 1 THEN 1.0 ELSE 0.0 END), 6) FROM f UNION ALL SELECT 'accuracy.yield', 1.0 UNION ALL SELECT 'accuracy.prep_time', 1.0 UNION ALL SELECT 'accuracy.cook_time', 0.0 UNION ALL SELECT 'accuracy.ingredient_count', round(avg(CASE WHEN n = m THEN 1.0 ELSE 0.0 END), 6) FROM f UNION ALL SELECT 'accuracy.step_count', round(avg(CASE WHEN k % 6 <> 0 THEN 1.0 ELSE 0.0 END), 6) FROM f
UNION ALL SELECT 'count.missing.steps', CAST(count(*) AS DOUBLE) FROM f WHERE false HAVING count(*) > 0"""
)
def extraction_report(spark, sf_dir):
    rows = evaluation.field_scores(_fixtures(spark, sf_dir)).withColumn("missing", evaluation.missing_fields(F.col("expected"), F.col("found")))
    out = evaluation.extraction_summary(rows).where("metric NOT IN ('accuracy.title_exact', 'accuracy.total_time', 'accuracy.ingredients_f1', 'accuracy.spans_f1')")
    return out.where("metric <> 'count.missing.ingredients'").select("metric", F.round("value", 6).alias("value"))


_METRICS_SQL = f"""{_VECTOR_SQL}, {_JUDGED_SQL}, per AS (SELECT query_id, coalesce(sum(CASE WHEN rank <= 10 THEN relevance / log2(rank + 1) END), 0) / sum(CASE WHEN ideal <= 10 THEN relevance / log2(ideal + 1) END) AS ndcg_10, coalesce(1.0::DOUBLE / min(rank), 0) AS recip_rank FROM hits GROUP BY query_id)"""


@query(
    f"""WITH {_METRICS_SQL}, b AS (SELECT *, row_number() OVER (ORDER BY round(ndcg_10, 9) DESC, query_id) AS n, row_number() OVER (ORDER BY round(ndcg_10, 9), query_id) AS w FROM per)
SELECT query_id, round(ndcg_10, 6) AS ndcg_10, 'best' AS sample FROM b WHERE n <= 3 UNION ALL SELECT query_id, round(ndcg_10, 6), 'worst' FROM b WHERE w <= 3"""
)
def report_samples(spark, sf_dir):
    per = evaluation.ir_metrics(*_judged(spark, sf_dir)).withColumn("ndcg_10", F.round("ndcg_10", 9))
    return evaluation.samples(per).select("query_id", F.round("ndcg_10", 6).alias("ndcg_10"), "sample")


@query(f"WITH {_METRICS_SQL} SELECT round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recip_rank), 6) AS recip_rank FROM per")
def report_means(spark, sf_dir):
    run, qrels = _judged(spark, sf_dir)
    return evaluation.run_means(evaluation.ir_metrics(run, qrels), qrels).select(F.round("ndcg_10", 6).alias("ndcg_10"), F.round("recip_rank", 6).alias("recip_rank"))


@query(
    f"""WITH {_METRICS_SQL}, d AS (SELECT query_id, round(ndcg_10, 6) AS base, round(ndcg_10 * (query_id % 700) / 600, 6) AS current FROM per) SELECT query_id, base, current, round(current - base, 6) AS delta FROM d WHERE current < base ORDER BY current - base, query_id LIMIT 5"""
)
def report_drops(spark, sf_dir):
    base = evaluation.ir_metrics(*_judged(spark, sf_dir)).select("query_id", F.col("ndcg_10").alias("raw"))
    current = base.select("query_id", F.round(F.col("raw") * (F.col("query_id") % 700) / 600, 6).alias("ndcg_10"))
    return evaluation.worst_drops(base.select("query_id", F.round("raw", 6).alias("ndcg_10")), current).withColumn("delta", F.round("delta", 6))


@query(
    f"""WITH {_VECTOR_SQL}, {_JUDGED_SQL}, l AS (SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS retrieved FROM vector GROUP BY 1) SELECT h.query_id, l.retrieved, count(*) AS n_expected, count(rank) AS n_found, sum(rank) AS ranks FROM hits h LEFT JOIN l USING (query_id) GROUP BY ALL"""
)
def retrieval_report(spark, sf_dir):
    out = evaluation.retrieval_report(*_judged(spark, sf_dir))
    ranks = F.filter(F.map_values("expected_item_ranks"), lambda r: r.isNotNull())
    return out.select("query_id", F.array_join(F.transform("retrieved_ids", lambda i: i.cast("string")), ",").alias("retrieved"), F.size("expected_item_ranks").cast("long").alias("n_expected"), F.size(ranks).cast("long").alias("n_found"), F.when(F.size(ranks) > 0, F.aggregate(ranks, F.lit(0).cast("long"), lambda a, r: a + r)).alias("ranks"))


@query("SELECT o_custkey AS query_id, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'removed' ELSE 'added' END AS change FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F') <> bool_or(o_orderstatus = 'O')")
def query_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("query_id", F.col("o_custkey"))
    return evaluation.query_changes(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"))


@query("SELECT doc_id FROM labels WHERE quality <> toxic AND doc_id % 4 > 0")
def judge_disagreements(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("human_rating"), F.when(F.col("doc_id") % 4 > 0, F.col("toxic")).alias("judge_rating"))
    return evaluation.disagreements(rows).select("doc_id")


@query("SELECT l_orderkey AS query_id, l_suppkey AS item_id, CAST(arg_max(l_linenumber % 3, l_linenumber) AS INTEGER) AS relevance FROM lineitem GROUP BY ALL")
def folded_qrels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("item_id"), (F.col("l_linenumber") % 3).cast("int").alias("relevance"), F.col("l_linenumber").alias("line"))
    return evaluation.fold_qrels(rows)


@query(
    """WITH r AS (SELECT quality AS h, CASE WHEN doc_id % 4 > 0 THEN toxic END AS j FROM labels) SELECT count(h + j) AS rated, count(*) FILTER (WHERE h = j) AS agreed, count(*) - count(h + j) AS unrated, round(count(*) FILTER (WHERE h = j) / count(h + j), 6) AS rate FROM r"""
)
def judge_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("human_rating"), F.when(F.col("doc_id") % 4 > 0, F.col("toxic")).alias("judge_rating"))
    return evaluation.agreement(rows).withColumn("rate", F.round("rate", 6))


@query(
    """WITH c AS (SELECT doc_id AS f, concat('v', doc_id % 2) AS v, concat('h', doc_id % 3) AS a, CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 1 THEN 'pass' END AS j FROM labels), r AS (SELECT doc_id AS f, 'v0' AS v, 'h0' AS a, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS h FROM labels)
SELECT c.f AS fixture_id, h AS human_rating, CASE WHEN h IS NULL OR j IS NULL THEN 'unrated' WHEN h = j THEN 'agree' ELSE 'disagree' END AS agreement_status FROM c LEFT JOIN r USING (f, v, a)"""
)
def judge_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    current = rows.select(F.col("doc_id").alias("fixture_id"), F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("judge_version"), F.concat(F.lit("h"), (F.col("doc_id") % 3).cast("string")).alias("artifact_hash"), F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 1, "pass").alias("judge_rating"))
    old = rows.select(F.col("doc_id").alias("fixture_id"), F.lit("v0").alias("judge_version"), F.lit("h0").alias("artifact_hash"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("human_rating"))
    return evaluation.alignment(current, old).select("fixture_id", "human_rating", "agreement_status")


@query("SELECT doc_id AS fixture_id, sha256(concat(text, chr(0), lang)) AS content_hash FROM documents WHERE doc_id % 2 = 1")
def drifted_fixtures(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fixture_id"), evaluation.fixture_hash(F.col("text"), F.col("lang")).alias("content_hash"))
    was = rows.select("fixture_id", F.when(F.col("fixture_id") % 2 == 1, "another").otherwise(F.col("content_hash")).alias("content_hash"))
    return evaluation.drifted(rows, was).select("fixture_id", "content_hash")


# -- texts -------------------------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, CASE WHEN k = 0 THEN '' WHEN k = 1 THEN concat('page ', k) ELSE concat('pages ', k, '–', k + 2) END AS label, array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'serves 4' END, CASE WHEN k = 1 THEN 'cook' WHEN k = 2 THEN 'total' ELSE 'prep' END], lambda x: x IS NOT NULL), ',') AS badges,
substr(o_orderpriority, 1, 5) AS snippet, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug, lower(o_orderpriority) = '1-urgent' AS same, CAST(CASE WHEN k - 1 > 0 THEN k - 1 ELSE 7 END AS BIGINT) AS positive, concat('read ', k) AS prompt FROM (SELECT *, o_orderkey % 3 AS k FROM orders)"""
)
def text_labels(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    page = F.when(k > 0, k)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X.page_label(page, F.when(k == 2, k + 2).when(k == 1, k)).alias("label"), F.array_join(X.badges(F.when(F.col("o_orderstatus") == "F", "serves 4"), F.when(k == 1, "cook").otherwise(" "), F.when(k == 2, "total"), F.lit("prep")), ",").alias("badges"),
        X.snippet(F.col("o_orderpriority"), 5).alias("snippet"), X.slug(F.col("o_orderpriority")).alias("slug"), X.same_text(F.concat(F.lit(" "), "o_orderpriority"), F.lit("1-urgent ")).alias("same"), X.positive_or(k - 1, 7).cast("long").alias("positive"), runs.render_prompt(F.lit("read {window}"), k.cast("string")).alias("prompt"),
    )


@query(
    f"""WITH {LINES_SQL}, s AS (SELECT doc_id, string_agg(concat('[SOURCE_SPAN s', page, ' | PDF page ', page, ']', chr(10), text), chr(10) || chr(10) ORDER BY page) AS shown, string_agg(CAST(page AS VARCHAR), ' ' ORDER BY CAST(page AS VARCHAR)) AS keyed,
sha256(concat('{{"prompt_version":"p1","schema_version":"v1","spans":[', string_agg(concat('{{"id":"s', page, '","text_hash":"', sha256(text), '"}}'), ',' ORDER BY page), ']}}')) AS input_hash FROM pages GROUP BY 1) SELECT doc_id, sha256(shown) AS window_hash, keyed AS window_key, input_hash FROM s"""
)
def window_texts(spark, sf_dir):
    """Each document as one window of its lines."""
    one = F.struct("page", F.concat(F.lit("s"), F.col("page").cast("string")).alias("id"), "text", F.sha2("text", 256).alias("text_hash"))
    rows = lines(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    return rows.select("doc_id", F.sha2(X.render_window(F.col("spans")), 256).alias("window_hash"), X.window_key(F.transform("spans", lambda s: s["page"].cast("string"))).alias("window_key"), X.input_hash(F.col("spans"), "p1", "v1").alias("input_hash"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'verified' END AS verification FROM documents")
def verification_states(spark, sf_dir):
    k = F.col("doc_id") % 3
    notes = F.concat(F.lit("# notes\n"), F.when(k == 0, "- Verification: Draft - to do").when(k == 1, "Verification: verified").otherwise("Verification: maybe"), F.lit("\nend"))
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.verification_status(notes).alias("verification"))
