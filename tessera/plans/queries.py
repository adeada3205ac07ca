"""Queries of the engine's operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import catalog, evaluation, ground, ingest, lifecycle, packing, search
from tessera.streaming import events
from tessera.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from tessera.plans.stems_sql import stemmed_search
from tessera.plans.views import CHUNK_TYPE_SQL, ITEMS_SQL, LINES_SQL, chunk_type, items, lines, table
from tessera.sources import scratch

# -- search ------------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    space = [F.lit("fake").alias("provider"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("model")]
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 5).alias("item_id"), chunk_type(F.col("vec_id")).alias("chunk_type"), *space, "embedding", "label")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), *space, F.col("embedding").alias("vector"))
    return chunks, queries


_VECTOR_SQL = f"""vec AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.vec_id // 5 AS item_id, {CHUNK_TYPE_SQL.format("c.vec_id")} AS chunk_type, c.label AS chunk_label, q.label AS query_label,
    list_cosine_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
  FROM embeddings c JOIN embeddings q ON q.vec_id % 100 = 0 AND c.label % 2 = q.label % 2
), vector AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM vec) WHERE rank <= 50
)"""


@query(f"WITH {_VECTOR_SQL} SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance, round(1 - distance, 6) AS raw_score FROM vector WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    chunks, queries = _vectors(spark, sf_dir)
    hits = search.vector_leg(chunks, queries, 10)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"), F.round("raw_score", 6).alias("raw_score"))


def _text_hits(spark, sf_dir):
    """Unstemmed word search: lines that hold all words of a query (the first three words of each benchmark text)."""
    rows = lines(spark, sf_dir).select((F.col("doc_id") * 1000000 + F.col("page")).alias("chunk_id"), F.col("doc_id").alias("item_id"), chunk_type(F.col("page")).alias("chunk_type"), X.words(F.col("text")).alias("words"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(F.slice(X.words(F.col("text")), 1, 3)).alias("terms"))
    return search.word_leg(rows, asked)


_WORDS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_KEYWORD_SQL = f"""{LINES_SQL}, asked AS (
  SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format("text")}[1:3]) AS word FROM benchmark
), sizes AS (SELECT query_id, count(*) AS n_terms FROM asked GROUP BY query_id), postings AS (
  SELECT doc_id * 1000000 + page AS chunk_id, doc_id AS item_id, page, word, count(*) AS n FROM (SELECT doc_id, page, unnest({_WORDS.format("text")}) AS word FROM pages) GROUP BY ALL
), keyword AS (
  SELECT * FROM (SELECT query_id, chunk_id, item_id, {CHUNK_TYPE_SQL.format("page")} AS chunk_type, raw_score, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS rank
    FROM (SELECT query_id, chunk_id, item_id, page, count(*) AS n_found, sum(n) AS raw_score FROM postings JOIN asked USING (word) GROUP BY ALL) JOIN sizes USING (query_id) WHERE n_found = n_terms) WHERE rank <= 50
)"""


@query(f"WITH {_KEYWORD_SQL} SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank, CAST(raw_score AS BIGINT) AS raw_score FROM keyword")
def keyword_topk(spark, sf_dir):
    return _text_hits(spark, sf_dir).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.col("raw_score").cast("long").alias("raw_score"))


@query(f"WITH {LINES_SQL}, lined AS (SELECT doc_id * 1000000 + page AS chunk_id, text FROM pages),\n{stemmed_search('lined', 3)}\nSELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(raw_score, 6) AS raw_score FROM found")
def keyword_stemmed(spark, sf_dir):
    """Stemmed search ranked by cover density."""
    rows = lines(spark, sf_dir).select((F.col("doc_id") * 1000000 + F.col("page")).alias("chunk_id"), F.col("doc_id").alias("item_id"), chunk_type(F.col("page")).alias("chunk_type"), X.lexemes(F.col("text")).alias("lexemes"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.lexemes(F.col("text")).alias("l")).select("query_id", F.array_distinct(F.slice(F.transform("l", lambda x: x["lexeme"]), 1, 3)).alias("terms"))
    return search.keyword_leg(rows, asked).select("query_id", "chunk_id", "rank", F.round("raw_score", 6).alias("raw_score"))


def _boost_sql(leg: str) -> str:
    return "CASE chunk_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in search.BOOSTS[leg].items()) + " ELSE 1.0::DOUBLE END"


def _legs(spark, sf_dir):
    """The vector leg, and as the keyword leg the ranking by label equality and id that SQL shares."""
    chunks, queries = _vectors(spark, sf_dir)
    vector = search.vector_leg(chunks, queries)
    # a query's hits are the next 50 rows of its label: they are found by place, so what is joined grows with the queries and not with the pairs
    placed = scratch.stored(packing.global_places(chunks.where("label IS NOT NULL AND chunk_id IS NOT NULL").select("label", "chunk_id", "item_id", "chunk_type"), ["label", "chunk_id"], "place"), "places")
    asked = placed.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "label", F.col("place").alias("first"))
    asked = asked.withColumn("block", F.explode(F.array(F.floor(F.col("first") / 50), F.floor(F.col("first") / 50) + 1)))
    hits = placed.withColumn("block", F.floor(F.col("place") / 50)).join(asked, ["label", "block"]).withColumn("rank", (F.col("place") - F.col("first") + 1).cast("int"))
    keyword = hits.where("rank BETWEEN 1 AND 50").select("query_id", "chunk_id", "item_id", "chunk_type", "rank").withColumn("retrieval_source", F.lit("keyword"))
    return keyword, vector


_FUSED_SQL = f"""{_VECTOR_SQL}, keyword AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.vec_id // 5 AS item_id, {CHUNK_TYPE_SQL.format("c.vec_id")} AS chunk_type
    FROM embeddings c JOIN embeddings q ON c.label = q.label AND q.vec_id % 100 = 0 AND c.vec_id >= q.vec_id)) WHERE rank <= 50
), merged AS (
  SELECT query_id, chunk_id, item_id, chunk_type,
    coalesce({_boost_sql("keyword")} * (1.0::DOUBLE / (60 + k.rank)), 0) + coalesce({_boost_sql("vector")} * (1.0::DOUBLE / (60 + v.rank)), 0) AS score,
    k.rank IS NOT NULL AS in_keyword, v.rank IS NOT NULL AS in_vector
  FROM keyword k FULL JOIN (SELECT query_id, chunk_id, item_id, chunk_type, rank FROM vector) v USING (query_id, chunk_id, item_id, chunk_type)
)"""


@query(f"WITH {_FUSED_SQL} SELECT query_id, chunk_id, item_id, chunk_type, round(score, 9) AS score, CASE WHEN in_keyword AND in_vector THEN 'keyword,vector' WHEN in_keyword THEN 'keyword' ELSE 'vector' END AS sources FROM merged")
def rrf_fusion(spark, sf_dir):
    return search.fuse(*_legs(spark, sf_dir)).select("query_id", "chunk_id", "item_id", "chunk_type", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"))


_ITEMS_SQL = """grouped AS (
  SELECT query_id, item_id, max(score) AS best, count(DISTINCT chunk_type) AS n_types FROM {0} GROUP BY ALL
), placed AS (
  SELECT *, best + least(0.05::DOUBLE * (n_types - 1), 0.15::DOUBLE) AS item_score FROM grouped
), top_items AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY item_score DESC, best DESC, item_id) AS place FROM placed) WHERE place <= 10
)"""


@query(f"WITH {_FUSED_SQL}, {_ITEMS_SQL.format('merged')} SELECT query_id, item_id, CAST(place AS BIGINT) AS place, n_types, round(item_score, 9) AS item_score FROM top_items")
def group_by_item(spark, sf_dir):
    top = search.hybrid_search(*_legs(spark, sf_dir))
    return top.select("query_id", "item_id", F.col("place").cast("long").alias("place"), "n_types", F.round("item_score", 9).alias("item_score"))


@query(
    f"""WITH {_FUSED_SQL}, listed AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) AS i, count(*) OVER (PARTITION BY query_id) AS n FROM merged WHERE chunk_id % 3 = 0
) SELECT m.query_id, m.chunk_id, round(CASE WHEN i IS NOT NULL THEN max(score) OVER (PARTITION BY m.query_id) + 1 + (n - i) ELSE score END, 9) AS score
FROM merged m LEFT JOIN listed l USING (query_id, chunk_id)"""
)
def rerank_apply(spark, sf_dir):
    merged = search.fuse(*_legs(spark, sf_dir))
    some = merged.where("chunk_id % 3 = 0").select("query_id", "chunk_id", (-F.col("chunk_id")).alias("pos"))
    again = some.withColumn("pos", F.col("pos") + 100000)  # duplicates and unknown ids change nothing
    unknown = merged.select("query_id", F.lit(-1).cast("long").alias("chunk_id"), F.lit(0).cast("long").alias("pos")).distinct()
    return search.apply_rerank(merged, some.union(again).union(unknown)).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query(f"WITH {ITEMS_SQL} SELECT doc_id, category, subcategory FROM items WHERE status = 'ready' AND subcategory = 'en' AND category IN ('src0', 'src1', 'src2')")
def filtered_search(spark, sf_dir):
    rows = items(spark, sf_dir).select("doc_id", "category", "subcategory", F.col("status").alias("item_status"), F.lit(1).alias("item_version"), F.lit(1).alias("active_version"), F.lit("knowledge_item").alias("parent_type"), F.lit("recipe").alias("item_type"))
    out = None
    for source in ("src0", "src1", "src2"):
        one = rows.where(search.search_predicate(category=source, subcategory="en"))
        out = one if out is None else out.unionByName(one)
    return out.select("doc_id", "category", "subcategory")


# -- ingest ------------------------------------------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
w AS (SELECT conv_id, n, unnest(range(1 + CAST(ceil(greatest(n - 3, 0) / 2.0) AS BIGINT))) AS win FROM (SELECT DISTINCT conv_id, n FROM n))
SELECT w.conv_id, w.win, count(*) AS n_rows, sha256(string_agg(concat(CAST(n.turn AS VARCHAR), ':', sha256(n.text)), ' ' ORDER BY n.at)) AS rows_hash
FROM w JOIN n ON n.conv_id = w.conv_id AND n.at BETWEEN w.win * 2 AND w.win * 2 + 2 GROUP BY ALL"""
)
def page_windows(spark, sf_dir):
    out = ingest.windows(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["turn", "text"])
    listed = F.array_join(F.transform("rows", lambda r: F.concat(r["turn"].cast("string"), F.lit(":"), F.sha2(r["text"], 256))), " ")
    return out.select("conv_id", F.col("window").alias("win"), F.size("rows").cast("long").alias("n_rows"), F.sha2(listed, 256).alias("rows_hash"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, page, sha256(text) AS text_hash, sha256(concat('{{"page_end":', page, ',"page_start":', page, ',"type":"page"}}')) AS locator_hash, CASE WHEN length(trim(text)) < 20 THEN 0.0::DOUBLE END AS confidence FROM pages""")
def span_hashes(spark, sf_dir):
    rows = ingest.page_spans(lines(spark, sf_dir).withColumnRenamed("doc_id", "document_id"))
    return rows.select(F.col("document_id").alias("doc_id"), "page", "text_hash", "locator_hash", "confidence")


def _recipes(spark, sf_dir):
    """Documents as extracted recipes: lines with even numbers are ingredients, the others steps; confidences come from the id."""
    docs = table(spark, sf_dir, "documents")
    parts = F.split("text", "\n", -1)
    span = lambda k: F.concat(F.lit("span_"), k.cast("string"))
    pairs = F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("text")))
    return docs.select(
        "doc_id", "text",
        F.struct(
            F.when(F.col("doc_id") % 50 == 0, "note").otherwise("recipe").alias("item_type"), F.substring("text", 1, 30).alias("title"), F.col("text").alias("body_text"),
            F.when(F.col("doc_id") % 40 == 1, F.array().cast("array<string>")).otherwise(F.array(span(F.col("doc_id") % 7))).alias("source_span_ids"),
            (F.col("doc_id") % 100 / 99.0).alias("overall"), (F.col("doc_id") % 101 / 99.0).alias("boundary"),
            F.transform(F.filter(pairs, lambda p: p["i"] % 2 == 0), lambda p: F.struct(p["text"].alias("raw_text"), ((p["i"] + F.col("doc_id")) % 10 / 10.0).alias("normalization"))).alias("ingredients"),
            F.transform(F.filter(pairs, lambda p: (p["i"] % 2 == 1) & (F.col("doc_id") % 3 > 0)), lambda p: F.struct(p["text"].alias("text"), F.array(span(p["i"])).alias("source_span_ids"))).alias("steps"),
        ).alias("rec"),
    )


_RECIPE_SQL = """r AS (
  SELECT doc_id, text, substr(text, 1, 30) AS title, doc_id % 100 / 99.0::DOUBLE AS overall, doc_id % 101 / 99.0::DOUBLE AS boundary, string_split(text, chr(10)) AS parts FROM documents
), recipe AS (
  SELECT *, [p for p, i in parts if (i - 1) % 2 = 0] AS ingr, len(parts) // 2 AS n_odd, [CAST((i - 1 + doc_id) % 10 AS DOUBLE) / 10 for p, i in parts if (i - 1) % 2 = 0] AS norm,
    CASE WHEN doc_id % 3 > 0 THEN len(parts) // 2 ELSE 0 END AS n_steps, (len(parts) + 1) // 2 AS n_ingr FROM r
)"""


@query(
    f"""WITH {_RECIPE_SQL} SELECT doc_id, array_to_string(list_filter([
  CASE WHEN doc_id % 50 = 0 THEN 'item_type' END, CASE WHEN trim(regexp_replace(title, '\\s+', ' ', 'g')) = '' THEN 'title' END, CASE WHEN doc_id % 40 = 1 THEN 'source_spans' END,
  CASE WHEN (doc_id % 40 <> 1 AND doc_id % 7 > 5) OR (doc_id % 3 > 0 AND len(list_filter(range(len(parts)), lambda i: i % 2 = 1 AND i > 5)) > 0) THEN 'span_outside_window' END,
  CASE WHEN overall > 1 OR boundary > 1 THEN 'confidence' END, CASE WHEN len(list_filter(ingr, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) = '')) > 0 THEN 'blank_ingredient' END], lambda x: x IS NOT NULL), ',') AS failures FROM recipe"""
)
def validate_hard(spark, sf_dir):
    window = F.array(*[F.lit(f"span_{k}") for k in range(6)])
    return _recipes(spark, sf_dir).select("doc_id", F.array_join(ingest.hard_failures(F.col("rec"), window), ",").alias("failures"))


_EXEMPT = "(n_steps = 0 AND n_ingr BETWEEN 3 AND 12 AND length(text) <= 400)"
_SOFT = f"""list_filter([
  CASE WHEN n_ingr = 0 THEN 'no_ingredients' END, CASE WHEN n_steps = 0 AND NOT {_EXEMPT} THEN 'no_steps' END, CASE WHEN overall < 0.5 THEN 'low_overall_confidence' END, CASE WHEN boundary < 0.5 THEN 'low_boundary_confidence' END,
  CASE WHEN length(trim(text)) < 200 AND NOT {_EXEMPT} THEN 'recipe_too_short' END, CASE WHEN length(trim(text)) > 20000 THEN 'recipe_too_long' END, CASE WHEN list_min(norm) < 0.5 THEN 'low_normalization_confidence' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {_RECIPE_SQL} SELECT doc_id, array_to_string({_SOFT}, ',') AS warnings, CASE WHEN len({_SOFT}) = 0 THEN 'ready' ELSE 'needs_review' END AS status FROM recipe")
def validate_soft(spark, sf_dir):
    found = ingest.soft_warnings(F.col("rec"))
    return _recipes(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("warnings"), ingest.item_status(found).alias("status"))


def _scored(spark, sf_dir):
    rec = F.col("rec")
    score = ingest.candidate_score(rec["overall"], rec["boundary"], F.size(rec["ingredients"]) > 0, F.size(rec["steps"]) > 0, F.size(rec["source_span_ids"]) + F.least(F.size(rec["steps"]), F.lit(2)), F.lit(3))
    return _recipes(spark, sf_dir).select("doc_id", F.lower(F.substring("text", 1, 12)).alias("normalized_title"), F.round(score, 9).alias("candidate_score"), F.col("doc_id").alias("item_id"))


_SCORE_SQL = """scored AS (
  SELECT doc_id, lower(substr(text, 1, 12)) AS normalized_title, round(0.35::DOUBLE * overall + 0.25::DOUBLE * boundary + 0.15::DOUBLE * CAST(n_ingr > 0 AS INTEGER) + 0.15::DOUBLE * CAST(n_steps > 0 AS INTEGER)
    + 0.10::DOUBLE * least(1.0::DOUBLE, CAST(CAST(doc_id % 40 <> 1 AS INTEGER) + least(n_steps, 2) AS DOUBLE) / 3), 9) AS candidate_score FROM recipe
)"""


@query(f"WITH {_RECIPE_SQL}, {_SCORE_SQL} SELECT doc_id, normalized_title, candidate_score, row_number() OVER (PARTITION BY normalized_title ORDER BY candidate_score DESC, doc_id) = 1 AS chosen FROM scored")
def dedup_best(spark, sf_dir):
    return ingest.best_per_title(_scored(spark, sf_dir)).drop("item_id")


#: Lines as parts of at most 8,000 UTF-8 bytes: a longer line is cut at the last code point that fits, again and again; blank parts are dropped.
_PARTS_SQL = f"""{LINES_SQL}, letters AS (
  SELECT doc_id, page, k, sum(strlen(substr(text, k, 1))) OVER (PARTITION BY doc_id, page ORDER BY k) AS upto FROM (SELECT doc_id, page, text, unnest(range(1, length(text) + 1)) AS k FROM pages WHERE strlen(text) > 8000)
), ends AS (SELECT * FROM letters UNION ALL SELECT DISTINCT doc_id, page, 0, 0 FROM letters), hops AS (
  SELECT a.doc_id, a.page, a.k, b.k AS reach FROM ends a ASOF JOIN ends b ON a.doc_id = b.doc_id AND a.page = b.page AND a.upto + 8000 >= b.upto
), cuts AS (
  SELECT doc_id, page, k, reach FROM hops WHERE k = 0 UNION ALL SELECT h.doc_id, h.page, h.k, h.reach FROM cuts c JOIN hops h ON h.doc_id = c.doc_id AND h.page = c.page AND h.k = c.reach WHERE h.reach > h.k
), pieces AS (
  SELECT doc_id, page, 0 AS k, text FROM pages WHERE strlen(text) <= 8000 UNION ALL SELECT doc_id, page, c.k, substr(p.text, CAST(c.k + 1 AS BIGINT), CAST(c.reach - c.k AS BIGINT)) FROM cuts c JOIN pages p USING (doc_id, page)
), parts AS (
  SELECT doc_id, page, text, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) AS part, count(*) OVER (PARTITION BY doc_id, page) AS part_count FROM pieces WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''
)"""


def _line_chunks(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = lines(spark, sf_dir).select(F.struct("doc_id", "page").alias("item_id"), *[none.alias(k) for k in ("title", "summary", "ingredients_text", "steps_text")], F.col("text").alias("body_text"))
    return ingest.build_chunks(rows)


@query(f"WITH RECURSIVE {_PARTS_SQL} SELECT doc_id, page, {CHUNK_TYPE_SQL.format('page')} AS chunk_type, sha256(text) AS text_hash FROM parts")
def chunk_small(spark, sf_dir):
    """All lines as chunks of the line's type."""
    out = _line_chunks(spark, sf_dir)
    return out.select("item_id.doc_id", "item_id.page", chunk_type(F.col("item_id.page")).alias("chunk_type"), F.sha2("text", 256).alias("text_hash"))


@query(f"WITH RECURSIVE {_PARTS_SQL} SELECT doc_id, page, CAST(part AS INTEGER) AS part, CAST(part_count AS INTEGER) AS part_count, CAST(strlen(text) AS INTEGER) AS bytes, sha256(text) AS text_hash FROM parts")
def chunk_lines(spark, sf_dir):
    """All lines as chunks; long ones in parts."""
    return _line_chunks(spark, sf_dir).select("item_id.doc_id", "item_id.page", "part", "part_count", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("text_hash"))


@query()
def chunk_split_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("ingredients_text"), F.lit(None).cast("string").alias("steps_text"), F.col("text").alias("body_text"))
    return ingest.build_chunks(rows).select("item_id", "chunk_type", "part", "part_count", F.octet_length("text").alias("bytes"))


@query(
    """WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_quantity AS BIGINT) AS size FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')),
r AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place, sum(size) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS running FROM o)
SELECT l_orderkey, l_linenumber, CAST(place AS BIGINT) AS place, CAST(running AS BIGINT) AS running FROM r WHERE place = 1 OR (place <= 10000 AND running <= 20000)"""
)
def batch_claim_prefix(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("size"))
    out = ingest.first_claim(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "size", 10_000, 20_000)
    return out.select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"), "running")


@query(
    """WITH RECURSIVE q AS (
  SELECT user_id, event_id, CAST(floor(abs(value)) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), walk AS (
  SELECT user_id, event_id, n, size AS total, 1 AS cnt, 0 AS batch FROM q WHERE n = 1
  UNION ALL SELECT q.user_id, q.event_id, q.n, CASE WHEN w.cnt >= 4 OR w.total + q.size > 150 THEN q.size ELSE w.total + q.size END, CASE WHEN w.cnt >= 4 OR w.total + q.size > 150 THEN 1 ELSE w.cnt + 1 END,
    CASE WHEN w.cnt >= 4 OR w.total + q.size > 150 THEN w.batch + 1 ELSE w.batch END FROM walk w JOIN q ON q.user_id = w.user_id AND q.n = w.n + 1
) SELECT user_id, event_id, CAST(batch AS BIGINT) AS batch FROM walk"""
)
def batch_packing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.abs("value").cast("long").alias("size"))
    return packing.pack(rows, "user_id", ["event_id"], "size", 4, 150).select("user_id", "event_id", "batch")


@query("SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name)), '\\s+', ' ', 'g')) AS normalized_title FROM part")
def title_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_title("p_name").alias("normalized_title"))


@query(
    """WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS item_id, substr(o_orderpriority, 3) AS normalized_title, round(o_totalprice / 1000000, 6) AS score, o_orderstatus FROM orders),
cand AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'extracting' WHEN 'O' THEN 'ready' ELSE 'needs_review' END AS status FROM c),
won AS (SELECT *, row_number() OVER (PARTITION BY doc_id, normalized_title ORDER BY score DESC, item_id) = 1 AS chosen FROM cand)
SELECT item_id, CASE WHEN chosen AND status = 'extracting' THEN 'ready' WHEN chosen THEN status WHEN status = 'extracting' THEN 'deleted' ELSE 'superseded' END AS new_status FROM won"""
)
def finalize_items(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("run_id"), F.substring("o_orderpriority", 3, 100).alias("normalized_title"), F.round(F.col("o_totalprice") / 1000000, 6).alias("candidate_score"), F.when(F.col("o_orderstatus") == "F", "extracting").when(F.col("o_orderstatus") == "O", "ready").otherwise("needs_review").alias("status"), F.array().cast("array<string>").alias("warnings"), F.lit(True).alias("carried"))
    return ingest.finalize(rows).select("item_id", "new_status")


# -- catalog and lifecycle ---------------------------------------------------------------------------------------------


@query(
    """SELECT c_custkey, count(o_orderkey) AS total, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS ready, count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS needs_review,
  CASE WHEN count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'needs_review' ELSE 'ready' END AS shown_status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def doc_counts_by_status(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.lit("ready").alias("status"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "P", "needs_review").otherwise("indexing").alias("status"))
    return catalog.with_counts(docs, rows).select(F.col("document_id").alias("c_custkey"), "total", "ready", "needs_review", "shown_status")


@query(
    """SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 50 OFFSET 10"""
)
def list_page(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("category"), F.lit("ready").alias("status"), F.col("c_acctbal").alias("created_at"))
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("document_id"), F.lit("needs_review").alias("status"))
    return catalog.list_documents(docs, rows, "BUILDING", "needs_review", 50, 10).select(F.col("document_id").alias("c_custkey"))


@query(f"WITH {LINES_SQL} SELECT doc_id, min(page) AS page_start, max(page) AS page_end, count(*) AS n FROM pages WHERE page >= 3 AND page <= 6 GROUP BY doc_id")
def page_range_overlap(spark, sf_dir):
    spans = lines(spark, sf_dir).select("doc_id", F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    return catalog.overlapping(spans, 3, 6).groupBy("doc_id").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS item_id, min(l_linenumber) AS page_start, max(l_linenumber) AS page_end FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber IN (2, 3, 5) GROUP BY o_orderkey")
def source_pages(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"), F.col("l_linenumber").alias("page_start"), F.col("l_linenumber").alias("page_end"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.array(*[F.col("o_orderkey") * 10 + k for k in (2, 3, 5)]).alias("span_ids"))
    return catalog.source_pages(rows, spans)


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return catalog.latest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("recent")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') AND l_returnflag <> 'R' THEN 'superseded' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'ready' END AS status FROM lineitem")
def supersede_keepset(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", F.when(F.col("l_returnflag") == "R", "rejected").otherwise("ready").alias("status"))
    keep = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"))
    return catalog.supersede(rows, keep).select(F.col("run_id").alias("l_orderkey"), "l_linenumber", "status")


@query("SELECT 'lineitem' AS \"table\", count(*) AS deleted FROM lineitem WHERE l_orderkey % 7 = 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey % 7 = 0")
def delete_cascade_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    doomed = orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("document_id"))
    return catalog.cascade_delete({"lineitem": (table(spark, sf_dir, "lineitem"), "l_orderkey"), "orders": (orders, "o_orderkey")}, doomed)[1]


@query(
    """WITH last AS (SELECT user_id, max(ts) AS seen, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY user_id)
SELECT user_id, stage FROM last WHERE stage NOT IN ('purchase', 'signup') AND seen < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 MINUTE AND NOT (stage = 'view' AND user_id % 5 = 0)"""
)
def stuck_sweep(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("document_id")).agg(F.max("ts").alias("last_progress_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"))
    stages = {"purchase": "creating_source_spans", "signup": "needs_review", "view": "extracting_items", "click": "creating_chunks", "error": "queued"}
    status = F.create_map(*[F.lit(x) for kv in stages.items() for x in kv])
    docs = last.withColumn("status", status[F.col("stage")]).withColumn("updated_at", F.col("last_progress_at"))
    waiting = docs.where("document_id % 5 = 0").select("document_id", F.lit("submitted").alias("status"))
    out = lifecycle.stuck_documents(docs, waiting, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    return out.select(F.col("document_id").alias("user_id"), "stage")


@query(
    """WITH c AS (SELECT o_orderkey, (['queued', 'extracting_text', 'creating_source_spans', 'extracting_items', 'validating_items', 'creating_chunks', 'embedding_chunks', 'indexing', 'ready', 'failed'])[CAST(o_orderkey % 10 AS INTEGER) + 1] AS s,
  (['extracting_text', 'failed', 'queued', 'validating_items', 'ready'])[CAST(o_custkey % 5 AS INTEGER) + 1] AS t FROM orders),
e AS (SELECT unnest(['queued>extracting_text', 'queued>failed', 'extracting_text>failed', 'creating_source_spans>failed', 'extracting_items>validating_items', 'extracting_items>failed', 'validating_items>failed', 'creating_chunks>failed', 'embedding_chunks>failed', 'indexing>failed', 'indexing>ready', 'ready>queued', 'failed>queued']) AS edge)
SELECT o_orderkey, concat(s, '>', t) IN (SELECT edge FROM e) AS applied, CASE WHEN concat(s, '>', t) IN (SELECT edge FROM e) THEN t ELSE s END AS status FROM c"""
)
def state_transitions(spark, sf_dir):
    states = F.array(*[F.lit(x) for x in ("queued", *lifecycle.STEPS, "ready", "failed")])
    goals = F.array(*[F.lit(x) for x in ("extracting_text", "failed", "queued", "validating_items", "ready")])
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").alias("document_id"), F.element_at(states, (F.col("o_orderkey") % 10 + 1).cast("int")).alias("status"))
    commands = o.select(F.col("o_orderkey").alias("document_id"), F.element_at(goals, (F.col("o_custkey") % 5 + 1).cast("int")).alias("to_status"))
    return lifecycle.transition(docs, commands).select(F.col("document_id").alias("o_orderkey"), "applied", "status")


@query("SELECT text_hash, min(doc_id) AS kept, count(*) - 1 AS duplicates FROM (SELECT doc_id, sha256(text) AS text_hash FROM documents) GROUP BY text_hash")
def upload_dedup(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("path"), F.concat(F.lit("%PDF-"), "text").cast("binary").alias("content"), F.sha2("text", 256).alias("text_hash"))
    known = files.limit(0).select(F.lit("").alias("content_hash"))
    status = catalog.classify_uploads(files.select("path", "content"), known)
    rows = status.join(files.select("path", "text_hash"), "path")
    return rows.groupBy("text_hash").agg(F.max(F.when(F.col("status") == "created", F.col("path").cast("long"))).alias("kept"), F.count_if(F.col("status") == "duplicate").alias("duplicates"))


@query("SELECT o_orderkey AS item_id, c_custkey AS document_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def favourites_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stars = o.where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("created_at"))
    rows = o.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("document_id"))
    return catalog.list_favourites(stars, rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))).select("item_id", "document_id")


# -- grounding ---------------------------------------------------------------------------------------------------------


def _pack(spark, sf_dir):
    """Orders of a customer as found items, their lines as chunks; lines over 30 pieces have no text, known spans are even."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    place = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    chunks = rows.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), place.alias("item_place"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")).alias("chunk_place"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.when(F.col("l_quantity") <= 30, "text").alias("text"), F.array(F.col("l_partkey") % 4, F.col("l_suppkey") % 4).alias("span_ids"), F.array(F.lit(0), F.lit(2)).cast("array<bigint>").alias("known_spans"))
    return ground.context_pack(chunks)


_PACK_SQL = """rows AS (
  SELECT o_custkey AS query_id, o_orderkey AS item_id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS item_place, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS chunk_place,
    l_quantity <= 30 AS has_text, CASE WHEN l_partkey % 4 IN (0, 2) THEN l_partkey % 4 WHEN l_suppkey % 4 IN (0, 2) THEN l_suppkey % 4 END AS span_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, item_id, span_id ORDER BY chunk_place) = 1 AS is_first FROM rows WHERE item_place <= 6 AND chunk_place <= 3 AND has_text AND span_id IS NOT NULL
), counted AS (
  SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY item_place) AS ctx, sum(CAST(is_first AS INTEGER)) OVER (PARTITION BY query_id ORDER BY item_place, chunk_place ROWS UNBOUNDED PRECEDING) AS c FROM kept
), pack AS (
  SELECT query_id, item_id, CAST(chunk_place AS INTEGER) AS chunk_place, span_id, concat('ctx_', ctx) AS ctx_id, concat('cite_', max(CASE WHEN is_first THEN c END) OVER (PARTITION BY query_id, item_id, span_id)) AS cite_id FROM counted
)"""


@query(f"WITH {_PACK_SQL} SELECT * FROM pack")
def context_pack(spark, sf_dir):
    return _pack(spark, sf_dir).select("query_id", "item_id", "chunk_place", "span_id", "ctx_id", "cite_id")


@query(
    f"""WITH {_PACK_SQL}, a AS (SELECT o_custkey AS query_id, o_orderkey AS item_id, unnest(['cite_1', concat('cite_', CAST(o_orderkey % 4 AS BIGINT))]) AS cite_id FROM orders WHERE o_orderpriority = '3-MEDIUM'),
owned AS (SELECT DISTINCT query_id, cite_id, item_id AS owner FROM pack), known AS (SELECT DISTINCT query_id, item_id, true AS k FROM pack)
SELECT query_id, count(*) FILTER (WHERE k IS NULL) AS unknown_items, count(*) FILTER (WHERE owner IS NULL) AS unknown, count(*) FILTER (WHERE owner <> a.item_id) AS wrong_owner, count(*) AS total,
  count(*) FILTER (WHERE k IS NULL OR owner IS NULL OR owner <> a.item_id) = 0 AS valid
FROM a LEFT JOIN owned USING (query_id, cite_id) LEFT JOIN known USING (query_id, item_id) GROUP BY query_id"""
)
def citation_check(spark, sf_dir):
    answers = table(spark, sf_dir, "orders").where("o_orderpriority = '3-MEDIUM'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("recommendation"), F.col("o_orderkey").alias("item_id"), F.array(F.lit("cite_1"), F.concat(F.lit("cite_"), (F.col("o_orderkey") % 4).cast("string"))).alias("cite_ids"))
    return ground.check_citations(answers, _pack(spark, sf_dir)).drop("uncited")


@query()
def menu_assign(spark, sf_dir):
    chunks, queries = _vectors(spark, sf_dir)
    hits = search.vector_leg(chunks, queries, 11)
    request = F.floor(F.col("query_id") / 300)
    rows = hits.select(request.alias("request_id"), F.col("query_id").alias("course"), "item_id", F.round("raw_score", 9).alias("score")).groupBy("request_id", "course", "item_id").agg(F.max("score").alias("score"))
    return ground.assign_courses(rows)


# -- evaluation --------------------------------------------------------------------------------------------------------


def _judged(spark, sf_dir):
    chunks, queries = _vectors(spark, sf_dir)
    run = search.vector_leg(chunks, queries).select("query_id", F.col("chunk_id").alias("item_id"), "rank")
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    qrels = chunks.join(asked, "label").where("chunk_id % 3 <> 0").select("query_id", F.col("chunk_id").alias("item_id"), (F.col("chunk_id") % 3).cast("int").alias("relevance"))
    return run, qrels


_JUDGED_SQL = """qrels AS (
  SELECT q.vec_id AS query_id, c.vec_id AS item_id, c.vec_id % 3 AS relevance FROM embeddings c JOIN embeddings q ON q.vec_id % 100 = 0 AND c.label = q.label WHERE c.vec_id % 3 <> 0
), hits AS (
  SELECT r.*, v.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY relevance DESC, r.item_id) AS ideal FROM qrels r LEFT JOIN vector v ON v.query_id = r.query_id AND v.chunk_id = r.item_id
)"""


@query(
    f"""WITH {_VECTOR_SQL}, {_JUDGED_SQL} SELECT query_id, round(coalesce(sum(CASE WHEN rank <= 10 THEN relevance / log2(rank + 1) END), 0) / sum(CASE WHEN ideal <= 10 THEN relevance / log2(ideal + 1) END), 6) AS ndcg_10,
  round(count(*) FILTER (WHERE rank <= 5) / count(*), 6) AS recall_5, round(count(*) FILTER (WHERE rank <= 10) / count(*), 6) AS recall_10, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS recip_rank FROM hits GROUP BY query_id"""
)
def ir_metrics(spark, sf_dir):
    out = evaluation.ir_metrics(*_judged(spark, sf_dir))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(
    f"""WITH {ITEMS_SQL}, r AS (SELECT CAST(n_chars % 101 AS DOUBLE) / 100 AS confidence, CAST(doc_id % 11 AS DOUBLE) / 10 AS accuracy, status, doc_id FROM items JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)),
b AS (SELECT *, CASE WHEN confidence >= 0.9 THEN 0 WHEN confidence >= 0.75 THEN 1 WHEN confidence >= 0.5 THEN 2 ELSE 3 END AS place, CASE status WHEN 'ready' THEN true WHEN 'needs_review' THEN false END AS pass FROM r)
SELECT CAST(p.place AS INTEGER) AS place, (['>=0.90', '>=0.75', '>=0.50', '<0.50'])[p.place + 1] AS bucket, count(b.place) AS n, round(avg(accuracy), 6) AS mean_accuracy, round(avg(CAST(pass AS DOUBLE)), 6) AS pass_rate,
  CASE WHEN p.place < 2 THEN count(*) FILTER (WHERE accuracy < 0.8 OR NOT pass) ELSE 0 END AS miscalibrated FROM (SELECT unnest(range(4)) AS place) p LEFT JOIN b USING (place) GROUP BY p.place"""
)
def calibration_buckets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = items(spark, sf_dir).join(docs, "doc_id").select(((F.col("n_chars") % 101).cast("double") / 100).alias("confidence"), ((F.col("doc_id") % 11).cast("double") / 10).alias("accuracy"), F.when(F.col("status") == "ready", True).when(F.col("status") == "needs_review", False).alias("judge_pass"))
    return evaluation.calibration(rows).select("place", "bucket", "n", F.round("mean_accuracy", 6).alias("mean_accuracy"), F.round("pass_rate", 6).alias("pass_rate"), F.col("miscalibrated").cast("long").alias("miscalibrated"))


@query(
    """WITH b AS (SELECT concat(CASE WHEN n_nationkey % 5 = 0 THEN 'count.' ELSE 'm.' END, n_name) AS metric, round(avg(c_acctbal) / 10000, 6) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey <> 3 GROUP BY ALL),
c AS (SELECT concat(CASE WHEN n_nationkey % 5 = 0 THEN 'count.' ELSE 'm.' END, n_name) AS metric, round(avg(s_acctbal) / 10000, 6) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey <> 4 GROUP BY ALL)
SELECT metric, b.v AS base, c.v AS current, round(c.v - b.v, 6) AS delta, CASE WHEN b.v IS NULL THEN 'new' WHEN c.v IS NULL THEN 'missing' WHEN metric LIKE 'count.%' THEN 'info' WHEN c.v - b.v < -0.010000001 THEN 'REGRESSION' WHEN c.v - b.v > 0.010000001 THEN 'improved' ELSE 'unchanged' END AS flag
FROM b FULL JOIN c USING (metric)"""
)
def metric_diff(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    name = F.concat(F.when(F.col("n_nationkey") % 5 == 0, "count.").otherwise("m."), "n_name").alias("metric")
    of = lambda rows, key, value, without: rows.join(nation, rows[key] == nation["n_nationkey"]).where(F.col("n_nationkey") != without).groupBy(name).agg(F.round(F.avg(value) / 10000, 6).alias("value"))
    out = evaluation.metric_diff(of(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", 3), of(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", 4))
    return out.withColumn("delta", F.round("delta", 6))


@query(
    f"""WITH {_VECTOR_SQL}, base AS (SELECT query_id, chunk_id AS item_id, rank AS base_rank FROM vector WHERE rank <= 20 AND chunk_id % 4 <> 0), cur AS (SELECT query_id, chunk_id AS item_id, rank + chunk_id % 6 AS new_rank FROM vector WHERE rank <= 20 AND chunk_id % 5 <> 0)
SELECT query_id, item_id, CAST(base_rank AS BIGINT) AS base_rank, CAST(new_rank AS BIGINT) AS new_rank, CASE WHEN base_rank <= 10 AND NOT coalesce(new_rank <= 10, false) THEN 'dropped_from_top_k' WHEN new_rank - base_rank >= 3 THEN 'rank_drop' ELSE 'kept' END AS change FROM base FULL JOIN cur USING (query_id, item_id)"""
)
def retrieval_diff(spark, sf_dir):
    chunks, queries = _vectors(spark, sf_dir)
    run = search.vector_leg(chunks, queries, 20).select("query_id", F.col("chunk_id").alias("item_id"), F.col("rank").cast("long").alias("rank"))
    return evaluation.retrieval_diff(run.where("item_id % 4 <> 0"), run.where("item_id % 5 <> 0").withColumn("rank", F.col("rank") + F.col("item_id") % 6))


@query(
    f"""WITH t AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), s AS (SELECT doc_id, list_distinct(w[1 : len(w) - len(w) // 3]) AS e, list_distinct(w[len(w) // 3 + 1 :]) AS f FROM t), c AS (SELECT *, CAST(len(list_intersect(e, f)) AS DOUBLE) AS k FROM s)
SELECT doc_id, round(CASE WHEN len(e) = 0 AND len(f) = 0 THEN 1.0 WHEN len(f) = 0 THEN 0 ELSE k / len(f) END, 6) AS "precision", round(CASE WHEN len(e) = 0 AND len(f) = 0 THEN 1.0 WHEN len(e) = 0 THEN 0 ELSE k / len(e) END, 6) AS recall FROM c"""
)
def prf_spans(spark, sf_dir):
    """The words but the last third against the words but the first third."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w")).withColumn("third", F.floor(F.size("w") / 3).cast("int"))
    parts = evaluation.prf(F.array_distinct(F.slice("w", F.lit(1), F.size("w") - F.col("third"))), F.array_distinct(F.slice("w", F.col("third") + 1, F.size("w"))))
    return rows.select("doc_id", *[F.round(parts[k], 6).alias(k) for k in ("precision", "recall")])


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size * 60.0::DOUBLE WHEN 2 THEN p_size * 60.0::DOUBLE + 15 WHEN 3 THEN p_size + 60.0::DOUBLE END AS minutes FROM part"""
)
def parse_minutes(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 5 == 0, size).when(F.col("p_partkey") % 5 == 1, F.concat(size, F.lit(" hours"))).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("PT"), size, F.lit("H15M"))).when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("About 1 hr and "), size, F.lit(" min"))).otherwise("a while")
    return table(spark, sf_dir, "part").select("p_partkey", X.parse_minutes(text).alias("minutes"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """The streaming operator over the table as a batch."""
    rows = events.tumbling_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS normalized FROM documents")
def normalize_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_query(F.col("text")).alias("normalized"))


#: Earlier names of queries that run over whole texts.
for _name in ("validate_hard", "validate_soft", "dedup_best", "prf_spans"):
    QUERIES[f"{_name}_whole"], ORACLES[f"{_name}_whole"] = QUERIES[_name], ORACLES[_name]
