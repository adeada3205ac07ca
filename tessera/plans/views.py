"""The engine's concepts as views over the test tables: lines of documents are pages and chunks, labels give item statuses, orders are runs,
events are heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The types of chunks.
CHUNK_TYPES = ["recipe_full", "recipe_title", "recipe_summary", "recipe_ingredients", "recipe_steps"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, category, subcategory, status) from documents and labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "needs_review").otherwise("extracting")
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", F.col("source").alias("category"), F.col("lang").alias("subcategory"), status.alias("status"))


ITEMS_SQL = """items AS (
  SELECT d.doc_id, d.text, d.source AS category, d.lang AS subcategory,
    CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'ready' WHEN quality = 0 THEN 'needs_review' ELSE 'extracting' END AS status
  FROM documents d LEFT JOIN labels USING (doc_id)
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text): the lines of each document, from 1."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "text")).withColumn("page", F.col("page") + 1)


LINES_SQL = """pages AS (
  SELECT doc_id, CAST(p + 1 AS INTEGER) AS page, line AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents)
)"""


def chunk_type(place):
    return F.element_at(F.array(*[F.lit(t) for t in CHUNK_TYPES]), (F.pmod(place, F.lit(5)) + 1).cast("int"))


CHUNK_TYPE_SQL = "(['recipe_full', 'recipe_title', 'recipe_summary', 'recipe_ingredients', 'recipe_steps'])[CAST({0} % 5 AS INTEGER) + 1]"


def library(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A library of books: each document has an item in two versions, its lines are chunks of one of them."""
    docs = items(spark, sf_dir)
    books = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title"), F.col("category").alias("author"), "category", "subcategory", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("active_version"))
    versions = docs.withColumn("source_version", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = versions.select((F.col("doc_id") * 10 + F.col("source_version")).alias("item_id"), F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 50 == 0, "note").otherwise("recipe").alias("item_type"), F.concat(F.lit("Item "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("of "), "category").alias("summary"), "status", "source_version")
    page = lines(spark, sf_dir)
    chunks = page.select((F.col("doc_id") * 1000000 + F.col("page")).alias("chunk_id"), (F.col("doc_id") * 10 + 1 + F.col("page") % 2).alias("item_id"), chunk_type(F.col("page")).alias("chunk_type"), "text", F.array(F.col("doc_id") * 1000000 + F.col("page"), F.col("doc_id") * 1000000 + F.col("page") + 1).alias("span_ids"))
    spans = page.select((F.col("doc_id") * 1000000 + F.col("page")).alias("span_id"), F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    return {"documents": books, "items": rows, "chunks": chunks, "spans": spans}


LIBRARY_SQL = f"""{ITEMS_SQL}, {LINES_SQL}, lib_items AS (
  SELECT doc_id * 10 + v AS item_id, doc_id AS document_id, CASE WHEN doc_id % 50 = 0 THEN 'note' ELSE 'recipe' END AS item_type, status, v AS source_version, category, subcategory,
    CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS active_version FROM items, (SELECT unnest([1, 2]) AS v)
), lib_chunks AS (
  SELECT doc_id * 1000000 + page AS chunk_id, doc_id * 10 + 1 + page % 2 AS item_id, doc_id, page, {CHUNK_TYPE_SQL.format("page")} AS chunk_type, text FROM pages
), searchable AS (
  SELECT c.*, i.document_id, i.category, i.subcategory FROM lib_chunks c JOIN lib_items i USING (item_id) WHERE i.status = 'ready' AND i.source_version = i.active_version AND i.item_type = 'recipe'
)"""
