"""Catalog: uploads, listings, counts, statuses, versions, deletes, review, edits, favourites. Commands are functions from tables to new
tables; Spark has no row locks, so a table has one writer at a time and snapshots are written whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lifecycle import first_of
from tessera.sources.files import insert_absent

# Statuses that end a document's ingest, with and without items.
TERMINAL_OK = ("ready", "needs_review")
TERMINAL = (*TERMINAL_OK, "failed")
PAGE, MOST_PAGE = 50, 200


def classify_uploads(files: DataFrame, assets: DataFrame) -> DataFrame:
    """files: (path, content) -> (path, content_hash, status, title): error for empty files and other formats, duplicate of a known asset or
    of an earlier file, else created."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = files.select("path", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("size"), F.substring("content", 1, 5).alias("magic"), F.trim(F.regexp_replace(name, r"[_\-\s]+", " ")).alias("title"))
    bad = (F.col("size") == 0) | (F.col("magic") != F.lit("%PDF-").cast("binary"))
    known = assets.select("content_hash").distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy("path")) == 1
    rows = rows.withColumn("first", first).join(known, "content_hash", "left")
    status = F.when(bad, "error").when(F.col("known") | ~F.col("first"), "duplicate").otherwise("created")
    return rows.select("path", "content_hash", status.alias("status"), "title")


def derived_status(status: Column, pending: Column) -> Column:
    """A finished document needs review as long as it has pending items, and is ready after."""
    return F.when(status.isin(*TERMINAL_OK), F.when(F.coalesce(pending, F.lit(0)) > 0, "needs_review").otherwise("ready")).otherwise(status)


def item_counts(items: DataFrame) -> DataFrame:
    """Items per document, without rejected ones."""
    return items.where("status <> 'rejected'").groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "needs_review").alias("needs_review"))


def with_counts(documents: DataFrame, items: DataFrame) -> DataFrame:
    out = documents.join(item_counts(items), "document_id", "left").fillna(0, ["total", "ready", "needs_review"])
    return out.withColumn("shown_status", derived_status(F.col("status"), F.col("needs_review")))


def list_documents(documents: DataFrame, items: DataFrame, category: str | None = None, status: str | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of documents, newest first. Filters on a finished status look at pending items by semi or anti join."""
    if not 1 <= limit <= MOST_PAGE or offset < 0:
        raise ValueError(f"limit is from 1 to {MOST_PAGE}, offset from 0")
    rows = documents if category is None else documents.where(F.col("category") == category)
    pending = items.where("status = 'needs_review'").select("document_id")
    if status in TERMINAL_OK:
        rows = rows.where(F.col("status").isin(*TERMINAL_OK)).join(pending, "document_id", "left_semi" if status == "needs_review" else "left_anti")
    elif status is not None:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("document_id")).offset(offset).limit(limit)


def review_queue(items: DataFrame, documents: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Pending items of finished documents, newest first; a page of them where a limit is given."""
    rows = items.where("status = 'needs_review'").join(documents.where(F.col("status").isin(*TERMINAL)).select("document_id"), "document_id").orderBy(F.desc("created_at"), F.desc("item_id"))
    return rows if limit is None else rows.offset(offset).limit(limit)


def overlapping(spans: DataFrame, page_start: int | None = None, page_end: int | None = None) -> DataFrame:
    """Spans that touch a page range; either side may be open."""
    out = spans if page_start is None else spans.where(F.col("page_end") >= page_start)
    return out if page_end is None else out.where(F.col("page_start") <= page_end)


def source_pages(items: DataFrame, spans: DataFrame) -> DataFrame:
    """First and last page of each item's spans; ids without a span are skipped."""
    cited = items.select("item_id", F.explode_outer("span_ids").alias("span_id"))
    return cited.join(spans.select("span_id", "page_start", "page_end"), "span_id", "left").groupBy("item_id").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))


def ordered_spans(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Each item's spans in the order in which it first names them."""
    named = items.select("item_id", F.posexplode("span_ids").alias("pos", "span_id")).groupBy("item_id", "span_id").agg(F.min("pos").alias("pos"))
    one = F.struct("pos", "span_id")
    return named.join(spans.select("span_id"), "span_id").groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda s: s["span_id"]).alias("span_ids"))


def latest(rows: DataFrame, key: list[str], order: list, keep: int = 1) -> DataFrame:
    return rows.withColumn("recent", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("recent") <= keep)


def cached_runs(windows: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """Windows with the last successful run of the same input, if there is one."""
    good = latest(runs.where("status = 'success'"), key, [F.desc("created_at"), F.desc("run_id")]).drop("recent")
    return windows.join(good.select(*key, "run_id"), key, "left")


def supersede(items: DataFrame, kept_runs: DataFrame, version: Column | None = None) -> DataFrame:
    """Items whose run is not kept become superseded, but for those that are superseded or rejected already."""
    keep = kept_runs.select("run_id").where("run_id IS NOT NULL").distinct().withColumn("kept", F.lit(True))
    stale = F.col("kept").isNull() & ~F.col("status").isin("superseded", "rejected")
    if version is not None:
        stale = stale & (F.col("source_version") == version)
    return items.join(keep, "run_id", "left").withColumn("status", F.when(stale, "superseded").otherwise(F.col("status"))).drop("kept")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """tables: name -> (rows, column of the document id). What is left of each, and (table, deleted) counts."""
    ids = doomed.select(F.col("document_id").alias("__id")).distinct()
    left = {name: rows.join(ids, rows[key] == F.col("__id"), "left_anti") for name, (rows, key) in tables.items()}
    counts = None
    for name, (rows, key) in tables.items():
        one = rows.join(ids, rows[key] == F.col("__id"), "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        counts = one if counts is None else counts.unionByName(one)
    return left, counts


def decide(items: DataFrame, decisions: DataFrame, documents: DataFrame) -> DataFrame:
    """decisions: (item_id, decision) -> items with `outcome`: approved pending items of the newest version go to indexing, rejected ones
    to rejected; the rest says why not. Of several decisions for an item the first holds, as in first_of()."""
    newest = items.groupBy("document_id").agg(F.max("source_version").alias("newest"))
    done = documents.select("document_id", F.col("status").isin(*TERMINAL).alias("done"))
    decisions = first_of(decisions.select("item_id", "decision", *(["at"] if "at" in decisions.columns else [])), ["item_id"]).select("item_id", "decision")
    rows = items.join(decisions, "item_id", "left").join(newest, "document_id").join(done, "document_id", "left")
    outcome = F.when(F.col("decision").isNull(), None).when(~F.coalesce("done", F.lit(False)), "document_busy").when(F.col("status") != "needs_review", "not_pending").when((F.col("decision") == "approve") & (F.col("source_version") < F.col("newest")), "stale")
    outcome = outcome.otherwise(F.when(F.col("decision") == "approve", "indexing").otherwise("rejected"))
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumn("status", F.when(F.col("outcome").isin("indexing", "rejected"), F.col("outcome")).otherwise(F.col("status"))).drop("decision", "newest", "done")


def apply_edits(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of title and body alone (editing.apply_edits() has whole recipes). edits: (item_id, title, body_text) -> items: a ready item goes to indexing, one under review stays; the first edit keeps a snapshot.
    Of several edits of an item the first holds, as in first_of()."""
    edits = first_of(edits.select("item_id", "title", "body_text", *(["at"] if "at" in edits.columns else [])), ["item_id"])
    rows = items.join(edits.select("item_id", F.col("title").alias("__t"), F.col("body_text").alias("__b"), F.lit(True).alias("__e")), "item_id", "left")
    changed = F.col("__e") & F.col("status").isin("ready", "needs_review")
    rows = rows.withColumn("snapshot", F.when(changed, F.coalesce("snapshot", F.to_json(F.struct("title", "body_text")))).otherwise(F.col("snapshot")))
    for name, new in (("title", "__t"), ("body_text", "__b")):
        rows = rows.withColumn(name, F.when(changed, F.coalesce(new, name)).otherwise(F.col(name)))
    return rows.withColumn("status", F.when(changed & (F.col("status") == "ready"), "indexing").otherwise(F.col("status"))).drop("__t", "__b", "__e")


def add_favourites(favourites: DataFrame, new: DataFrame) -> DataFrame:
    """Known stars keep their time; of several new ones of an item the earliest counts."""
    new = new.groupBy("item_id").agg(F.min("created_at").alias("created_at"))
    return favourites.unionByName(new.join(favourites, "item_id", "left_anti"))


def remove_favourites(favourites: DataFrame, gone: DataFrame) -> DataFrame:
    return favourites.join(gone, "item_id", "left_anti")


def list_favourites(favourites: DataFrame, items: DataFrame, documents: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    rows = favourites.withColumnRenamed("created_at", "starred_at").join(items, "item_id").join(documents, "document_id")
    return rows.orderBy(F.desc("starred_at"), F.desc("item_id")).offset(offset).limit(limit)


# Statuses that the listing of a book's items hides.
HIDDEN = ("superseded", "rejected")


def upload_totals(uploads: DataFrame) -> DataFrame:
    """Totals of a batch of uploads, as classify_uploads() tells them."""
    return uploads.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == one).alias(name) for one, name in (("created", "created"), ("duplicate", "duplicates"), ("error", "errors"))])


def list_runs(runs: DataFrame, documents: DataFrame, version: int | None = None, status: str | None = None) -> DataFrame:
    """The extraction runs of the given documents (document_id), newest first."""
    rows = runs.join(documents.select("document_id"), "document_id", "left_semi")
    rows = rows if version is None else rows.where(F.col("source_version") == version)
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("run_id"))


def list_spans(spans: DataFrame, page_start: int | None = None, page_end: int | None = None) -> DataFrame:
    """Spans that touch a page range, by page number and id."""
    return overlapping(spans, page_start, page_end).orderBy("page_start", "span_id")


def with_stars(items: DataFrame, favourites: DataFrame) -> DataFrame:
    """Items with the time of their star, null without one."""
    return items.join(favourites.groupBy("item_id").agg(F.min("created_at").alias("favourited_at")), "item_id", "left")


def list_book_items(items: DataFrame, documents: DataFrame, document_id, status: str | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of one book's items with the book's title, newest first; HIDDEN ones only where their status is asked for. Raises for a book that
    doesn't exist."""
    if not 1 <= limit <= MOST_PAGE or offset < 0:
        raise ValueError(f"limit is from 1 to {MOST_PAGE}, offset from 0")
    book = documents.where(F.col("document_id") == document_id).select("document_id", F.col("title").alias("document_title"))
    if book.isEmpty():
        raise LookupError(f"no document {document_id!r}")
    rows = items.where(F.col("document_id") == document_id)
    rows = rows.where(F.col("status") == status) if status is not None else rows.where(~F.col("status").isin(*HIDDEN))
    return rows.join(book, "document_id").orderBy(F.desc("created_at"), F.desc("item_id")).offset(offset).limit(limit)


def counts_of(documents: DataFrame, spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents with the numbers of their spans and chunks."""
    count = lambda rows, name: rows.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    return documents.join(count(spans, "n_spans"), "document_id", "left").join(count(chunks, "n_chunks"), "document_id", "left").fillna(0, ["n_spans", "n_chunks"])


def pages_progress(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """documents: (document_id, version) -> with pages_processed and pages_total (the greatest page_end of that version's spans; null without any)."""
    sums = spans.groupBy("document_id", F.col("source_version").alias("version")).agg(F.count(F.lit(1)).alias("pages_processed"), F.max("page_end").alias("pages_total"))
    return documents.join(sums, ["document_id", "version"], "left").fillna(0, ["pages_processed"])


def document_details(documents: DataFrame, items: DataFrame, spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """What the page of a document tells: item counts, shown status, numbers of spans and chunks."""
    return counts_of(with_counts(documents, items), spans, chunks)


def ingestion_status(documents: DataFrame, spans: DataFrame, failures: DataFrame) -> DataFrame:
    """documents: (document_id, status, active_version) -> progress and the latest failure. A finished document tells its active version; an unfinished one
    the version under way (the newest with spans, 1 before there are any), without progress where that is the active one."""
    newest = spans.groupBy("document_id").agg(F.max("source_version").alias("newest"))
    terminal = F.col("status").isin(*TERMINAL)
    under_way = F.coalesce("newest", F.lit(1))
    rows = documents.join(newest, "document_id", "left").withColumn("terminal", terminal).withColumn("current_version", F.when(~terminal, under_way))
    shown = F.when(terminal, F.col("active_version")).when(F.col("active_version").isNull() | (F.col("active_version") != under_way), under_way)
    rows = pages_progress(rows.withColumn("version", shown), spans)
    last = latest(failures, ["document_id"], [F.desc("failed_at"), F.desc("reason")]).select("document_id", F.struct("reason", F.col("last_status").alias("stage"), "failed_at").alias("__failure"))
    out = rows.join(last, "document_id", "left").withColumn("failure", F.when(F.col("status") == "failed", F.col("__failure")))
    return out.select("document_id", "status", "active_version", "current_version", "pages_processed", "pages_total", "terminal", "failure")


# The three rows that recipes typed by hand hang on.
SHELF_ASSET = {"asset_id": "asset_manual_shelf", "source_type": "manual", "original_filename": "Handwritten", "storage_provider": "none", "storage_key": "", "content_hash": "manual:handwritten-shelf", "upload_status": "uploaded"}
SHELF_DOCUMENT = {"document_id": "doc_manual_shelf", "asset_id": "asset_manual_shelf", "category": "recipes", "title": "Handwritten", "author": "", "source_type": "manual", "active_source_version": 1, "status": "ready"}
SHELF_RUN = {"run_id": "run_manual_shelf", "document_id": "doc_manual_shelf", "source_version": 1, "provider": "manual", "model": "manual", "prompt_version": "manual", "input_hash": "manual", "status": "success"}


def ensure_shelf(assets: DataFrame, documents: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables with the shelf's rows, which are added where they are absent; columns that a row doesn't name are null."""

    def with_row(table: DataFrame, row: dict, key: str) -> DataFrame:
        one = table.sparkSession.range(1).select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema])
        return insert_absent(table, one, [key])

    return with_row(assets, SHELF_ASSET, "asset_id"), with_row(documents, SHELF_DOCUMENT, "document_id"), with_row(runs, SHELF_RUN, "run_id")
