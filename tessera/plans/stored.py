"""Queries over what the engine stores for itself (vector and keyword indexes, versioned tables, committed extraction), packed queues, edited recipes,
checked payloads, polled batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.functions import text as X
from tessera.operators import catalog, editing, evaluation, keyword_index, lifecycle, packing, payloads, results, runs, search, vector_index
from tessera.plans.library import _shelf
from tessera.plans.queries import _VECTOR_SQL, ORACLES, _vectors, query
from tessera.plans.views import chunk_type, library, lines, table
from tessera.sources import scratch, versioned


@query(ORACLES["vector_topk"])
def vector_indexed(spark, sf_dir):
    """vector_topk from a stored index that was built from some chunks and extended by the others."""
    chunks, queries = _vectors(spark, sf_dir)
    path = scratch.new_path(spark, "vectors")
    vector_index.build(chunks.where("label < 5"), path)
    vector_index.append(chunks.where("label >= 5"), path)
    hits = vector_index.vector_leg(path, queries, 10)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"), F.round("raw_score", 6).alias("raw_score"))


def _lexeme_chunks(spark, sf_dir, lexemes):
    return lines(spark, sf_dir).select((F.col("doc_id") * 1000000 + F.col("page")).alias("chunk_id"), F.col("doc_id").alias("item_id"), chunk_type(F.col("page")).alias("chunk_type"), lexemes.alias("lexemes"))


def _index(spark, chunks):
    """An index of some chunks that is extended by the others."""
    path = scratch.new_path(spark, "keywords")
    keyword_index.append(chunks.where("item_id % 3 > 0"), path)
    keyword_index.append(chunks.where("item_id % 3 = 0"), path)
    return path


@query(ORACLES["keyword_topk"])
def keyword_indexed(spark, sf_dir):
    """keyword_topk from a stored index of words."""
    words = F.transform(X.words(F.col("text")), lambda w, k: F.struct(w.alias("lexeme"), (k + 1).alias("pos")))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(F.slice(X.words(F.col("text")), 1, 3)).alias("terms"))
    hits = keyword_index.keyword_leg(_index(spark, _lexeme_chunks(spark, sf_dir, words)), asked, count=True)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.col("raw_score").cast("long").alias("raw_score"))


@query(ORACLES["keyword_stemmed"])
def keyword_stemmed_indexed(spark, sf_dir):
    """keyword_stemmed from a stored index of stems."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.lexemes(F.col("text")).alias("l")).select("query_id", F.array_distinct(F.slice(F.transform("l", lambda x: x["lexeme"]), 1, 3)).alias("terms"))
    hits = keyword_index.keyword_leg(_index(spark, _lexeme_chunks(spark, sf_dir, X.lexemes(F.col("text")))), asked)
    return hits.select("query_id", "chunk_id", "rank", F.round("raw_score", 6).alias("raw_score"))


@query(
    """WITH RECURSIVE q AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS size, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem),
r AS (SELECT *, sum(size) OVER (ORDER BY n) AS upto FROM q), hops AS MATERIALIZED (
  SELECT a.n, least(greatest(b.n + 1, a.n + 1), a.n + 90) AS hop FROM r a ASOF JOIN r b ON a.upto - a.size + 2000 >= b.upto
), starts AS (SELECT 1::BIGINT AS n, 0 AS batch UNION ALL SELECT h.hop, s.batch + 1 FROM starts s JOIN hops h ON h.n = s.n WHERE h.hop <= (SELECT count(*) FROM q))
SELECT l_orderkey, l_linenumber, CAST(s.batch AS BIGINT) AS batch FROM q ASOF JOIN starts s ON q.n >= s.n"""
)
def queue_packing(spark, sf_dir):
    """All lines of orders as one queue, packed by many tasks."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("size"), F.lit(1).alias("queue"))
    return packing.pack(rows, "queue", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "size", 90, 2000, 4096).select("l_orderkey", "l_linenumber", "batch")


@query(
    """WITH w AS (SELECT conv_id AS document_id, turn AS window, text, sha256(text) AS h FROM conversations)
SELECT document_id, "window", 'success' AS status, sha256(concat('{"items": [{"title": "', h, '", "body_text": "b"}]}')) AS output_hash FROM w"""
)
def durable_extraction(spark, sf_dir):
    """All turns as windows through a provider that breaks down at some prompts, and again through one that doesn't: what the first run had recorded
    is not asked again."""
    import hashlib

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("window"), F.col("text").alias("prompt"), F.sha2("text", 256).alias("input_hash"))
    path = scratch.new_path(spark, "extraction")

    def answer(prompts, broken):
        hashes = [hashlib.sha256(p.encode()).hexdigest() for p in prompts]
        if broken and any(h < "01" for h in hashes):
            raise ConnectionError("the provider is away")
        return [(f'{{"items": [{{"title": "{h}", "body_text": "b"}}]}}', None) for h in hashes]

    runs.prepare_windows(rows, path)
    try:
        out = runs.extract_durably(spark, path, lambda prompts: answer(prompts, True), ["document_id", "window"])
    except runs.ExtractionFailed:
        out = runs.extract_durably(spark, path, lambda prompts: answer(prompts, False), ["document_id", "window"])
    return out.select("document_id", "window", "status", F.sha2("output_json", 256).alias("output_hash"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'indexing' ELSE 'failed' END ELSE 'queued' END AS status,
  CAST(2 AS INTEGER) AS version, true AS first_refused FROM orders"""
)
def guarded_writes(spark, sf_dir):
    """Two writers from one version: the second is refused, and succeeds on the first one's version."""
    path = scratch.new_path(spark, "documents")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "O", "embedding_chunks").otherwise("ready").alias("status"))
    seen = versioned.publish(docs, path)
    mine = versioned.read(spark, path, seen)
    step = lambda rows: lifecycle.transition(rows, rows.where("status = 'embedding_chunks'").select("document_id", F.when(F.col("document_id") % 3 == 0, "indexing").otherwise("failed").alias("to_status"))).drop("applied")
    again = lambda rows: lifecycle.transition(rows, rows.where("status = 'ready'").select("document_id", F.lit("queued").alias("to_status"))).drop("applied")
    versioned.publish(step(mine), path, seen)
    try:
        versioned.publish(again(mine), path, seen)
        refused = False
    except versioned.StaleWriter:
        refused = True
        versioned.update(spark, path, again)
    return versioned.read(spark, path).select(F.col("document_id").alias("o_orderkey"), "status", F.lit(versioned.version(spark, path)).alias("version"), F.lit(refused).alias("first_refused"))


def _cooked(spark, sf_dir):
    """Documents as recipes: each line an ingredient, and maybe one step."""
    doc = F.col("doc_id")
    row = lambda x, k: F.struct((k + 1).alias("position"), x.alias("raw_text"), k.cast("double").alias("quantity"), ((k + doc) % 10 / 10.0).alias("normalization"), F.lit(False).alias("edited"))
    step = F.array(F.struct(F.lit(1).alias("step_number"), F.lit("stir well").alias("text"), F.array(F.lit("s1")).alias("source_span_ids"), F.lit(0.4).alias("confidence"), F.lit(False).alias("edited")))
    status = F.element_at(F.array(*[F.lit(x) for x in ("ready", "needs_review", "ready", "superseded")]), (doc % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        doc.alias("item_id"), status.alias("status"), F.lit("Item").alias("title"), F.lit(None).cast("string").alias("summary"), F.concat(F.lit("prose "), doc.cast("string")).alias("body_text"), F.transform(F.split("text", "\n", -1), row).alias("ingredients"),
        F.when(doc % 3 > 0, step).alias("steps"), F.col("text").alias("ingredients_text"), F.when(doc % 3 > 0, "stir well").alias("steps_text"), (doc % 7 / 7.0).alias("overall"), F.lit(0.9).alias("boundary"), F.lit(None).cast("string").alias("snapshot"), F.array(F.lit("old")).alias("warnings"),
    )


@query(
    """WITH d AS (SELECT *, string_split(text, chr(10)) AS parts, doc_id % 4 <> 3 AND (doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0) AS e FROM documents), f AS (SELECT *, e AND doc_id % 2 = 0 AS e_i, e AND doc_id % 5 = 0 AS e_s, e AND doc_id % 3 = 0 AS e_t FROM d),
old AS (SELECT doc_id, k - 1 AS at, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS rank FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS k FROM f)),
lines AS (SELECT doc_id, CASE WHEN e_i THEN list_concat(['a new line'], list_reverse(parts)) ELSE parts END AS l FROM f),
new AS (SELECT doc_id, k, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS rank FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM lines)),
rows AS (SELECT n.doc_id, count(*) AS n_ingr, min(CASE WHEN o.at IS NULL THEN 1 ELSE (o.at + n.doc_id) % 10 / 10 END) AS norm, string_agg(concat(n.k, ':', sha256(n.line), ':', coalesce(CAST(o.at AS VARCHAR), 'none')), ' ' ORDER BY n.k) AS listed, string_agg(n.line, chr(10) ORDER BY n.k) AS text FROM new n LEFT JOIN old o ON o.doc_id = n.doc_id AND o.line = n.line AND o.rank = n.rank GROUP BY n.doc_id),
g AS (SELECT f.*, n_ingr, norm, listed, CASE WHEN e_i THEN rows.text ELSE f.text END AS i_text, CASE WHEN e_s THEN 'stir well' || chr(10) || 'bake' WHEN doc_id % 3 > 0 THEN 'stir well' ELSE '' END AS s_text, CASE WHEN e_s THEN 2 WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END AS n_steps, CASE WHEN e_t THEN NULL ELSE 'Item' END AS title FROM f JOIN rows USING (doc_id)),
h AS (SELECT *, CASE WHEN e_i OR e_s THEN array_to_string(list_filter([title, i_text, s_text], lambda x: x IS NOT NULL AND trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''), chr(10) || chr(10)) ELSE concat('prose ', doc_id) END AS body FROM g),
z AS (SELECT *, n_steps = 0 AND n_ingr BETWEEN 3 AND 12 AND length(body) <= 400 AS assembly FROM h)
SELECT doc_id, CASE WHEN e AND doc_id % 2 = 0 THEN 'indexing' ELSE (['ready', 'needs_review', 'ready', 'superseded'])[CAST(doc_id % 4 AS INTEGER) + 1] END AS status, title, sha256(listed) AS listed, n_steps, sha256(body) AS body_hash, e_i OR e_s AS body_rebuilt, e AS kept,
  CASE WHEN e THEN array_to_string(list_filter([CASE WHEN n_steps = 0 AND NOT assembly THEN 'no_steps' END, CASE WHEN doc_id % 7 / 7 < 0.5 THEN 'low_overall_confidence' END, CASE WHEN length(trim(body)) < 200 AND NOT assembly THEN 'recipe_too_short' END, CASE WHEN length(trim(body)) > 20000 THEN 'recipe_too_long' END, CASE WHEN norm < 0.5 THEN 'low_normalization_confidence' END], lambda w: w IS NOT NULL), ',') ELSE 'old' END AS warnings FROM z"""
)
def edited_recipes(spark, sf_dir):
    """Lines added and reversed, steps retyped, titles taken away; of two edits of an item the earlier holds."""
    items = _cooked(spark, sf_dir)
    named = lambda name, n: F.when(F.col("item_id") % n == 0, name)
    fields = F.array_compact(F.array(named("ingredients", 2), named("title", 3), named("steps", 5)))
    lines = F.concat(F.array(F.lit("a new line")), F.reverse(F.transform("ingredients", lambda r: r["raw_text"])))
    edits = items.select("item_id", fields.alias("fields"), F.lit(None).cast("string").alias("title"), lines.alias("ingredients"), F.array(F.lit("stir well"), F.lit("bake")).alias("steps"), F.lit(1).alias("at"))
    later = edits.where("size(fields) > 0").withColumn("at", F.lit(2)).withColumn("fields", F.array(F.lit("steps"))).withColumn("steps", F.array(F.lit("too late")))
    out = editing.apply_edits(items, edits.union(later))
    listed = F.array_join(F.transform("ingredients", lambda r: F.concat_ws(":", r["position"].cast("string"), F.sha2(r["raw_text"], 256), F.coalesce(r["quantity"].cast("int").cast("string"), F.lit("none")))), " ")
    return out.select(F.col("item_id").alias("doc_id"), "status", "title", F.sha2(listed, 256).alias("listed"), F.coalesce(F.size("steps"), F.lit(0)).alias("n_steps"), F.sha2("body_text", 256).alias("body_hash"), "body_rebuilt", F.col("snapshot").isNotNull().alias("kept"), F.array_join("warnings", ",").alias("warnings"))


@query(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 > 0 THEN 'run.k is no positive whole number' END, CASE WHEN doc_id % 3 > 0 THEN 'aggregate.ndcg_cut_10 is no finite number' END, CASE WHEN doc_id % 4 > 1 THEN 'a rank is no positive whole number' END], lambda x: x IS NOT NULL), '; ') AS report,
  array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'title: must not be empty' END, CASE WHEN doc_id % 4 IN (1, 2) THEN 'ingredients: a quantity is no number' END, CASE WHEN doc_id % 6 = 5 THEN 'steps: one is empty' END], lambda x: x IS NOT NULL), '; ') AS golden FROM documents"""
)
def payload_checks(spark, sf_dir):
    """Reports and expected recipes with numbers, strings of digits, booleans and nulls in each other's places."""
    of = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    run = F.concat(F.lit('{"run": {"query_set": "t", "mode": "hybrid", "limit": 20, "reranking_enabled": false, "embedding_model": "m", "k": '), of("10", '"10"', "true", "10.0", "0"), F.lit('}, "aggregate": {"recall_5": 1, "recall_10": 0.5, "recip_rank": 1e-3, "ndcg_cut_10": '))
    report = F.concat(run, of("0.5", '"0.5"', "null"), F.lit('}, "per_query": {"q": {"metrics": {"ndcg_cut_10": 0.5}, "expected_item_ranks": {"a": '), of("3", "null", '"3"', "2.5"), F.lit("}}}}"))
    quoted = F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)
    title = F.when(F.col("doc_id") % 7 == 0, "5").otherwise(quoted)
    golden = F.concat(F.lit('{"item_type": "recipe", "source_span_ids": ["s1"], "title": '), title, F.lit(', "structured_data": {"schema": "recipe.v1", "yield": null, "prep_time": "10 min", "cook_time": null, "total_time": null, "steps": [{"text": "stir"}, {"text": '), of('"a"', '"b"', '"c"', '"d"', '"e"', "7"))
    golden = F.concat(golden, F.lit('}], "ingredients": [{"raw_text": "egg", "unit_normalized": null, "item_normalized": "egg", "preparation": null, "quantity_value": '), of("1.5", '"1.5"', "true", "null"), F.lit("}]}}"))
    told = lambda c: F.array_join(c, "; ")
    return table(spark, sf_dir, "documents").select("doc_id", told(payloads.report_problems(report)).alias("report"), told(payloads.golden_problems(golden, F.lit("s1"))).alias("golden"))


@query(ORACLES["chunk_lines"])
def chunk_lines_sql(spark, sf_dir):
    """chunk_lines by the table function, in SQL."""
    tables.register(spark)
    asked = "SELECT l.doc_id, l.page, s.part, s.part_count, octet_length(s.part_text) AS bytes, sha2(s.part_text, 256) AS text_hash FROM {lines} AS l, LATERAL split_text(l.text, 8000) AS s"
    return spark.sql(asked, lines=lines(spark, sf_dir))


@query(
    """WITH i AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS v, (['indexing', 'ready', 'needs_review', 'rejected', 'indexing'])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS s, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 3 END AS active FROM orders),
n AS (SELECT *, max(v) OVER (PARTITION BY o_custkey) AS newest, s = 'indexing' AND o_orderkey % 2 = 0 AS hit FROM i),
d AS (SELECT *, hit AND v = newest AS done, max(CASE WHEN hit AND v = newest THEN v END) OVER (PARTITION BY o_custkey) AS target FROM n), e AS (SELECT *, CASE WHEN target IS NOT NULL AND (active IS NULL OR target > active) THEN target END AS moved, CASE WHEN done THEN 'ready' WHEN hit THEN 'needs_review' ELSE s END AS t FROM d)
SELECT o_orderkey, CASE WHEN moved IS NOT NULL AND v <> moved AND t NOT IN ('superseded', 'rejected', 'indexing') THEN 'superseded' ELSE t END AS status, coalesce(moved, active) AS active_version FROM e"""
)
def indexed_items(spark, sf_dir):
    """Approved items are indexed, unless a newer version came in between."""
    status = F.element_at(F.array(*[F.lit(x) for x in ("indexing", "ready", "needs_review", "rejected", "indexing")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    orders = table(spark, sf_dir, "orders")
    items = orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 3).alias("source_version"), status.alias("status"))
    docs = items.select("document_id").distinct().withColumn("active_version", F.when(F.col("document_id") % 4 > 0, F.col("document_id") % 3))
    docs, items = lifecycle.index_items(docs, items, items.where("item_id % 2 = 0").select("item_id"))
    return items.join(docs, "document_id").select(F.col("item_id").alias("o_orderkey"), "status", "active_version")


@query(
    """WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_linenumber % 3 AS attempts, l_suppkey % 7 > 0 AND l_suppkey % 11 > 0 AND l_suppkey % 5 > 0 AND l_suppkey % 3 > 0 AS ended FROM lineitem),
s AS (SELECT *, CASE WHEN NOT ended THEN 'submitted' WHEN l_linenumber % 4 = 0 THEN 'succeeded' WHEN l_linenumber % 4 = 1 OR attempts >= 2 THEN 'rejected' ELSE 'pending' END AS status FROM i)
SELECT l_orderkey, l_linenumber, status, status = 'pending' AS freed, CASE WHEN status IN ('succeeded', 'rejected') THEN CASE status WHEN 'succeeded' THEN 'success' ELSE 'rejected' END END AS run_status,
  bool_and(status NOT IN ('pending', 'submitted')) OVER (PARTITION BY l_orderkey) AS driven_on, CASE WHEN ended OR l_suppkey % 7 = 0 THEN 'ended' ELSE 'submitted' END AS batch_status FROM s"""
)
def polled_batches(spark, sf_dir):
    """Suppliers as batches, lines as their requests: some calls break down, some batches still run; what came back is recorded, and orders without open
    lines are driven on."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("source_version"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("input_hash"), F.lit("submitted").alias("status"), (F.col("l_linenumber") % 3).alias("submit_attempts"), F.col("l_suppkey").alias("batch_id"), "l_linenumber", F.col("l_suppkey").alias("supplier"))
    batches = items.select("batch_id").distinct().select("batch_id", F.when(F.col("batch_id") % 11 > 0, F.concat(F.lit("p"), F.col("batch_id").cast("string"))).alias("provider_batch_id"), F.when(F.col("batch_id") % 7 == 0, "ended").otherwise("submitted").alias("processing_status"))

    def retrieve(batch, hashes):
        number = int(batch[1:])
        if number % 5 == 0:
            raise TimeoutError("no answer")
        kind = lambda h: int(h.split("-")[1]) % 4
        types = ("succeeded", "succeeded", "expired", "errored")
        return "in_progress" if number % 3 == 0 else "ended", [{"input_hash": h, "result_type": types[kind(h)], "parsed": True, "valid": kind(h) == 0, "retryable": True} for h in hashes]

    none = items.limit(0).select("document_id", "source_version", "input_hash")
    polled = scratch.stored(runs.poll_batches(batches, items, retrieve), "polled")
    after, out, done = runs.ingest_polled(batches, items, none, polled)
    rows = out.withColumn("of", F.col("batch_id")).join(done.select("document_id", F.lit(True).alias("driven_on")), "document_id", "left")
    rows = rows.join(after.select(F.col("batch_id").alias("supplier"), "processing_status"), "supplier")
    return rows.select(F.col("document_id").alias("l_orderkey"), "l_linenumber", "status", F.col("of").isNull().alias("freed"), "run_status", F.coalesce("driven_on", F.lit(False)).alias("driven_on"), F.col("processing_status").alias("batch_status"))


# -- smaller functions -------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g')) <> '') AS l FROM documents)
SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 AND len(l) > 0 THEN text ELSE array_to_string(l, chr(10)) END) AS resolved FROM p"""
)
def resolved_lines(spark, sf_dir):
    """The stored text of some documents, the present lines of the others."""
    rows = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("raw_text")))
    stored = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, "  ")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.resolve_lines(stored, rows, "raw_text"), 256).alias("resolved"))


@query(
    """WITH c AS (SELECT o_custkey AS query_id, o_orderkey AS item_id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS item_place, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS chunk_place, l_partkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT query_id, item_id, CAST(item_place AS INTEGER) AS item_place, CAST(chunk_place AS INTEGER) AS chunk_place, concat('part ', l_partkey) AS text FROM c WHERE chunk_place <= 2"""
)
def result_previews(spark, sf_dir):
    """The texts of the first two chunks of each found item."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    chunk = F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    order = F.struct((-F.col("l_extendedprice")).alias("by"), "l_partkey", "l_linenumber", chunk.alias("chunk_id"))
    top = rows.groupBy(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id")).agg(F.sort_array(F.collect_list(order)).alias("chunks"))
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy("item_id"))
    texts = rows.select(chunk.alias("chunk_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"))
    return results.previews(top.withColumn("place", place), texts, 2).select("query_id", "item_id", "item_place", "chunk_place", "text")


@query(
    """SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN 'recipe.v1' ELSE 'other.v1' END AS schema, p_name AS title, CASE WHEN p_partkey % 4 > 0 THEN concat('p. ', p_size) ELSE '' END AS source_label,
  CASE WHEN p_partkey % 5 > 0 THEN '4 servings' END AS yield, array_to_string(list_filter([p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'line' END, p_name, 'a', 'b', 'c'][1 : 5], lambda x: true), '|') AS top_ingredients FROM part"""
)
def projected_results(spark, sf_dir):
    """What a client shows of parts as results."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    of = lambda norm, text, raw: F.struct(norm.alias("item_normalized"), text.alias("item_text"), raw.alias("raw_text"))
    no = F.lit(None).cast("string")
    listed = F.array(of(F.col("p_brand"), no, no), of(F.when(k % 2 == 0, F.col("p_type")), F.lit(""), F.lit("line")), of(F.lit(""), no, F.lit("")), of(no, F.col("p_name"), F.lit("x")), *[of(F.lit(x), no, no) for x in "abc"])
    data = F.struct(F.when(k % 3 > 0, "other.v1").alias("schema"), F.when(k % 5 > 0, "4 servings").alias("yield"), no.alias("prep_time"), no.alias("cook_time"), no.alias("total_time"), listed.alias("ingredients"))
    cited = F.when(k % 4 > 0, F.array(F.struct(F.concat(F.lit("p. "), F.col("p_size").cast("string")).alias("label")))).otherwise(F.array().cast("array<struct<label:string>>"))
    found = part.select(F.lit(1).alias("query_id"), k.alias("place"), k.alias("item_id"), F.struct(F.col("p_name").alias("title"), F.lit("short").alias("summary")).alias("item"), F.lit("d").alias("document"), F.lit("m").alias("matched_chunks"), cited.alias("source_citations"))
    out = results.project(found, part.select(k.alias("item_id"), data.alias("data"), F.lit(0.5).alias("confidence")))
    return out.select("item_id", "schema", "display.title", "display.source_label", F.col("structured_preview.yield").alias("yield"), F.array_join("structured_preview.top_ingredients", "|").alias("top_ingredients"))


@query(ORACLES["metric_diff"])
def reports_compared(spark, sf_dir):
    """metric_diff between reports as they are stored, of runs that went well."""
    nation, name = table(spark, sf_dir, "nation"), F.concat(F.when(F.col("n_nationkey") % 5 == 0, "count.").otherwise("m."), "n_name").alias("metric")
    of = lambda rows, key, value, without: rows.join(nation, rows[key] == nation["n_nationkey"]).where(F.col("n_nationkey") != without).groupBy(name).agg(F.round(F.avg(value) / 10000, 6).alias("value")).withColumn("run_status", F.lit("ok"))
    out = evaluation.diff_reports(of(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", 3), of(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", 4))
    return out.withColumn("delta", F.round("delta", 6))


@query(
    """SELECT o_orderkey, round(list_avg(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 1.0 WHEN o_orderkey % 3 = 0 THEN 0.0 END, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 / 7.0 END, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 END]::DOUBLE[], lambda x: x IS NOT NULL)), 6) AS accuracy FROM orders WHERE o_orderkey % 11 > 0
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 11 = 0"""
)
def objective_accuracies(spark, sf_dir):
    """The mean of the scores that can be compared, of orders as recipes."""
    k = F.col("o_orderkey")
    values = {"title_normalized": F.when(k % 2 == 0, 1.0).when(k % 3 == 0, 0.0), "ingredients_f1": F.when(k % 5 > 0, k % 7 / 7.0), "step_count": F.when(k % 4 == 0, 0.0), "title_exact": F.lit(0.25)}
    scores = F.struct(*[values.get(name, F.lit(None).cast("double")).alias(name) for name in evaluation.SCORES])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(evaluation.objective_accuracy(F.when(k % 11 > 0, scores)), 6).alias("accuracy"))


#: A walk over all candidates of a request.
ORACLES["menu_assign"] = f"""WITH RECURSIVE {_VECTOR_SQL}, c AS (SELECT query_id // 300 AS request_id, query_id AS course, item_id, round(max(1 - distance), 9) AS score FROM vector WHERE rank <= 11 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, course, item_id) AS n FROM c), walk AS (
  SELECT request_id, 0::BIGINT AS n, []::BIGINT[] AS taken, []::BIGINT[] AS filled, NULL::BIGINT AS course, NULL::BIGINT AS item_id, NULL::DOUBLE AS score FROM o WHERE n = 1
  UNION ALL SELECT w.request_id, o.n, CASE WHEN good THEN list_append(taken, o.item_id) ELSE taken END, CASE WHEN good THEN list_append(filled, o.course) ELSE filled END, CASE WHEN good THEN o.course END, o.item_id, o.score
  FROM walk w JOIN o ON o.request_id = w.request_id AND o.n = w.n + 1, LATERAL (SELECT NOT list_contains(w.taken, o.item_id) AND len(list_filter(w.filled, lambda x: x = o.course)) < 5 AS good)
) SELECT request_id, course, item_id, score FROM walk WHERE course IS NOT NULL"""


@query(
    """SELECT 'document' AS kind, concat('d', c_custkey) AS id, c_name AS title, 'failed' AS status FROM customer UNION ALL SELECT 'document', 'doc_manual_shelf', 'Handwritten', 'ready' UNION ALL SELECT 'asset', concat('a', c_custkey), c_name, 'uploaded' FROM customer UNION ALL SELECT 'asset', 'asset_manual_shelf', 'Handwritten', 'uploaded'
UNION ALL SELECT 'run', 'run_manual_shelf', NULL, 'rejected'"""
)
def manual_shelf(spark, sf_dir):
    """The shelf of typed recipes is made once; rows that are there (here its run, spoilt) stay as they are."""
    c = table(spark, sf_dir, "customer")
    key = lambda p: F.concat(F.lit(p), F.col("c_custkey").cast("string"))
    assets = c.select(key("a").alias("asset_id"), F.col("c_name").alias("original_filename"), F.lit("uploaded").alias("upload_status"))
    docs = c.select(key("d").alias("document_id"), F.col("c_name").alias("title"), F.lit("failed").alias("status"))
    made = spark.range(1).select(F.lit("run_manual_shelf").alias("run_id"), F.lit("rejected").alias("status"))
    assets, docs, made = catalog.ensure_shelf(*catalog.ensure_shelf(assets, docs, made))
    rows = docs.select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), "title", "status").union(assets.select(F.lit("asset"), "asset_id", "original_filename", "upload_status"))
    return rows.union(made.select(F.lit("run"), "run_id", F.lit(None).cast("string"), "status"))


@query(ORACLES["search_keyword"])
def search_keyword_indexed(spark, sf_dir):
    """search_keyword from a stored index of all chunks; what may be found is filtered as the blocks are read."""
    lib = library(spark, sf_dir)
    path = scratch.new_path(spark, "keywords")
    keyword_index.append(lib["chunks"].withColumn("lexemes", X.lexemes(F.col("text"))), path)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.lexemes(F.col("text")).alias("l")).select("query_id", F.array_distinct(F.slice(F.transform("l", lambda x: x["lexeme"]), 1, 2)).alias("terms"))
    hits = results.keyword_search(lib["chunks"], lib["items"], lib["documents"], asked, search.search_predicate(category="src0"), index=path)
    return hits.select("query_id", "chunk_id", "item_id", "rank", F.round("raw_score", 6).alias("score"))


@query(ORACLES["search_vector"])
def search_vector_indexed(spark, sf_dir):
    """search_vector from a stored index of all embeddings."""
    shelf, path = _shelf(spark, sf_dir), scratch.new_path(spark, "vectors")
    vector_index.build(shelf["embeddings"].join(shelf["chunks"], "chunk_id"), path)
    hits = results.vector_search(shelf["embeddings"], shelf["chunks"], shelf["items"], shelf["documents"], shelf["queries"], search.search_predicate(subcategory="en"), "fake", "even", 20, path)
    return hits.select("query_id", "chunk_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(
    """WITH d AS (SELECT o_orderkey AS k, (['ready', 'needs_review', 'failed', 'indexing', 'queued'])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS active, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 4 + 1 END AS most FROM orders WHERE o_orderkey % 13 > 0),
a AS (SELECT o_orderkey AS k, (['auto', 'reuse_source_spans', 'new_source_version', 'odd'])[CAST(o_orderkey // 4 % 4 AS INTEGER) + 1] AS mode FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT a.k, mode, status, active, most, CASE WHEN mode = 'odd' THEN 'invalid_mode' WHEN status IS NULL THEN 'not_found' WHEN a.k % 11 = 0 THEN 'manual' WHEN status IN ('indexing', 'queued') THEN 'already_running' ELSE 'queued' END AS outcome FROM a LEFT JOIN d USING (k)),
m AS (SELECT *, CASE WHEN outcome = 'queued' THEN mode = 'reuse_source_spans' OR (mode = 'auto' AND k % 6 = 0) END AS reuse FROM r)
SELECT k AS o_orderkey, outcome, active AS previous_version, CASE WHEN reuse THEN coalesce(active, most) WHEN outcome = 'queued' THEN coalesce(most, 0) + 1 END AS version, reuse, CASE WHEN outcome = 'queued' THEN 'queued' ELSE status END AS status FROM m"""
)
def reprocess_requests(spark, sf_dir):
    """Half of the orders as documents are to be processed again, some of them twice at once."""
    k = F.col("document_id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    of = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    docs = rows.where(k % 13 > 0).select(k, F.when(k % 11 == 0, "manual").otherwise("pdf").alias("source_type"), of(("ready", "needs_review", "failed", "indexing", "queued"), k).alias("status"), F.when(k % 3 > 0, k % 4).alias("active_version"), F.lit("then").alias("last_progress_at"))
    facts = docs.where(k % 7 > 0).select(k, (k % 4 + 1).alias("max_version"), F.lit(True).alias("same_prompt"), (k % 6 == 0).alias("same_schema"), F.lit(True).alias("same_extractor"))
    facts = facts.union(docs.where(k % 7 == 0).select(k, F.lit(None).cast("long"), F.lit(True), k % 6 == 0, F.lit(True)))
    asked = rows.where(k % 2 == 0).select(k, of(("auto", "reuse_source_spans", "new_source_version", "odd"), F.floor(k / 4)).alias("mode"), F.lit(1).alias("at"))
    after, told = lifecycle.reprocess(docs, asked.union(asked.where(k % 3 == 0).select(k, F.lit("auto"), F.lit(2))), facts)
    return told.join(after.select("document_id", "status"), "document_id", "left").withColumnRenamed("document_id", "o_orderkey")
