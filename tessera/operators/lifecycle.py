"""Lifecycle: the state machine of documents, sweeps of stuck work, resume points, batch results, the hand-off of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The allowed transitions of a document's status.
STEPS = ["extracting_text", "creating_source_spans", "extracting_items", "validating_items", "creating_chunks", "embedding_chunks", "indexing"]
EDGES = [("queued", "extracting_text"), ("queued", "extracting_items"), ("queued", "failed"), *zip(STEPS, STEPS[1:]), *((s, "failed") for s in STEPS), ("indexing", "ready"), ("indexing", "needs_review"), *((s, "queued") for s in ("ready", "needs_review", "failed"))]
TERMINAL = ("ready", "needs_review", "failed")
# Fixed value: the state in which documents rest without being stuck.
RESTING = ("creating_source_spans",)
STUCK_MINUTES, STUCK_ITEM_MINUTES, ATTEMPTS = 30, 15, 2


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "from_status string, to_status string")


def first_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key: the first by `at` if there is such a column, then by the others in their order."""
    others = [c for c in rows.columns if c not in key]
    first = F.min(F.struct(*sorted(others, key=lambda c: c != "at"))).alias("__first")
    return rows.groupBy(*key).agg(first).select(*key, *[F.col(f"__first.{c}").alias(c) for c in others])


def transition(documents: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: (document_id, to_status, and maybe `at`) -> documents with `applied`: false for an edge that doesn't exist (the status stays), null
    without a command. Of several commands for a document the first holds: by `at` if there is one, then by to_status."""
    commands = first_of(commands.select("document_id", "to_status", *(["at"] if "at" in commands.columns else [])), ["document_id"]).select("document_id", "to_status")
    allowed = F.broadcast(edges(documents.sparkSession)).withColumn("allowed", F.lit(True))
    rows = documents.join(commands, "document_id", "left")
    rows = rows.join(allowed, (F.col("status") == F.col("from_status")) & (rows["to_status"] == allowed["to_status"]), "left").select(*[documents[c] for c in documents.columns], rows["to_status"].alias("__to"), "allowed")
    applied = F.when(F.col("__to").isNotNull(), F.coalesce("allowed", F.lit(False)))
    return rows.withColumn("applied", applied).withColumn("status", F.when(F.col("applied"), F.col("__to")).otherwise(F.col("status"))).drop("__to", "allowed")


def stuck_documents(documents: DataFrame, batch_items: DataFrame, now: Column, minutes: int = STUCK_MINUTES) -> DataFrame:
    """Unfinished documents without progress for so long, but for resting ones and those that wait for a batch."""
    waiting = batch_items.where(F.col("status").isin("submitting", "submitted")).select("document_id").distinct()
    old = F.coalesce("last_progress_at", "updated_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    rows = documents.where(~F.col("status").isin(*TERMINAL, *RESTING) & old)
    exempt = rows.where("status = 'extracting_items'").join(waiting, "document_id", "left_semi").select("document_id")
    return rows.join(exempt, "document_id", "left_anti")


def stuck_items(items: DataFrame, now: Column, minutes: int = STUCK_ITEM_MINUTES) -> DataFrame:
    late = (F.col("status") == "indexing") & (F.col("updated_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    return items.withColumn("status", F.when(late, "needs_review").otherwise(F.col("status")))


def resume_point(status: Column, has_spans: Column) -> Column:
    return F.when(status == "queued", F.when(has_spans, "reuse").otherwise("fresh")).when(status == "extracting_items", "resume").when(status == "creating_chunks", "embed").when(status == "embedding_chunks", "index").otherwise("skip")


def reprocess_mode(same_prompt: Column, same_schema: Column, same_extractor: Column) -> Column:
    true = lambda c: F.coalesce(c, F.lit(False))
    return F.when(true(same_prompt) & true(same_schema) & true(same_extractor), "reuse_source_spans").otherwise("new_source_version")


def batch_results(items: DataFrame, results: DataFrame, runs: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """items: (document_id, source_version, input_hash, status, submit_attempts); results: (input_hash, result_type, parsed, valid, retryable)
    -> items with new_status and run_status. Results that come again change nothing; of several for one
    input the first holds, as in first_of()."""
    key = ["document_id", "source_version", "input_hash"]
    had = runs.select(*key).distinct().withColumn("had_run", F.lit(True))
    rows = items.join(first_of(results, ["input_hash"]), "input_hash", "left").join(had, key, "left")
    active = (F.col("status") == "submitted") & F.col("result_type").isNotNull()
    again = (F.col("result_type") == "expired") | ((F.col("result_type") == "errored") & F.coalesce("retryable", F.lit(False)))
    good = (F.col("result_type") == "succeeded") & F.coalesce("parsed", F.lit(False)) & F.coalesce("valid", F.lit(False))
    status = F.when(~active, F.col("status")).when(F.col("had_run"), "succeeded").when(good, "succeeded").when(again & (F.col("submit_attempts") < attempts), "pending").otherwise("rejected")
    run = F.when(~active | F.col("had_run"), None).when(good, "success").when(again & (F.col("submit_attempts") < attempts), None).otherwise("rejected")
    return rows.select(*items.columns, status.alias("new_status"), run.alias("run_status"))


def finished(batch_items: DataFrame) -> DataFrame:
    """(document_id, source_version) without unfinished items."""
    open_ = F.col("status").isin("pending", "submitting", "submitted")
    return batch_items.groupBy("document_id", "source_version").agg(F.count_if(open_).alias("open")).where("open = 0").drop("open")


def hand_off(documents: DataFrame, items: DataFrame, chunks: DataFrame, forward_only: bool = False) -> DataFrame:
    """documents: (document_id, version, active_version, ...) -> with status and active_version: ready if a ready item of the version has a
    chunk. forward_only: an older version never replaces a newer one."""
    ready = items.where("status = 'ready'").select("item_id", "document_id", F.col("source_version").alias("version"))
    found = chunks.select("item_id").distinct().join(ready, "item_id").select("document_id", "version").distinct().withColumn("searchable", F.lit(True))
    rows = documents.join(found, ["document_id", "version"], "left")
    moves = F.coalesce("searchable", F.lit(False))
    if forward_only:
        moves = moves & (F.col("active_version").isNull() | (F.col("active_version") < F.col("version")))
    status = F.when(F.coalesce("searchable", F.lit(False)), "ready").otherwise("needs_review")
    return rows.withColumn("status", status).withColumn("active_version", F.when(moves, F.col("version")).otherwise(F.col("active_version"))).drop("searchable")


def index_items(documents: DataFrame, items: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked: (item_id) of approved items -> documents (document_id, active_version, ...) and items (item_id, document_id, source_version, status, ...). Only items
    that are still indexing count, so a job that comes twice changes nothing. One that has a newer version beside it by now goes back to review instead; the
    others are ready. The active version moves forward only, to the newest version with a ready one; then the items of other versions are superseded, but
    for rejected ones and those being indexed."""
    newest = items.groupBy("document_id").agg(F.max("source_version").alias("__newest"))
    rows = items.join(asked.select("item_id").distinct().withColumn("__asked", F.lit(True)), "item_id", "left").join(newest, "document_id")
    hit = F.coalesce("__asked", F.lit(False)) & (F.col("status") == "indexing")
    rows = rows.withColumn("__done", hit & (F.col("source_version") == F.col("__newest")))
    rows = rows.withColumn("status", F.when(F.col("__done"), "ready").when(hit, "needs_review").otherwise(F.col("status")))
    moved = rows.where("__done").groupBy("document_id").agg(F.max("source_version").alias("__to"))
    docs = documents.join(moved, "document_id", "left")
    forward = F.col("__to").isNotNull() & (F.col("active_version").isNull() | (F.col("__to") > F.col("active_version")))
    docs = docs.withColumn("__to", F.when(forward, F.col("__to")))
    rows = rows.join(docs.where("__to IS NOT NULL").select("document_id", "__to"), "document_id", "left")
    old = F.col("__to").isNotNull() & (F.col("source_version") != F.col("__to")) & ~F.col("status").isin("superseded", "rejected", "indexing")
    out = rows.withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).select(*items.columns)
    return docs.withColumn("active_version", F.coalesce("__to", "active_version")).select(*documents.columns), out


# How a document may be processed again, and outcomes of asking for it.
MODES = ("auto", "reuse_source_spans", "new_source_version")


def reprocess(documents: DataFrame, asked: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked: (document_id, mode, maybe `at`); documents: (document_id, source_type, status, active_version, last_progress_at, ...); facts: (document_id,
    max_version, same_prompt, same_schema, same_extractor) -> documents, of which the accepted ones are queued without progress, and a row for each asked
    document: outcome (invalid_mode, not_found, manual, already_running or queued), previous_version, the version to work on and whether its spans are
    reused; a null version means that there is nothing to dispatch. Only finished documents are accepted, so of several requests the first (as in
    first_of()) holds; with versioned.update() a writer that was slower sees the queued document and is refused."""
    asked = first_of(asked.select("document_id", "mode", *(["at"] if "at" in asked.columns else [])), ["document_id"]).select("document_id", "mode")
    rows = asked.join(documents.select("document_id", "source_type", "status", F.col("active_version").alias("previous_version"), F.lit(True).alias("__known")), "document_id", "left").join(facts, "document_id", "left")
    outcome = F.when(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), "invalid_mode").when(F.col("__known").isNull(), "not_found").when(F.col("source_type") == "manual", "manual").when(~F.col("status").isin(*TERMINAL), "already_running").otherwise("queued")
    mode = F.when(F.col("mode") == "auto", reprocess_mode(F.col("same_prompt"), F.col("same_schema"), F.col("same_extractor"))).otherwise(F.col("mode"))
    rows = rows.withColumn("outcome", outcome).withColumn("reuse", F.when(F.col("outcome") == "queued", mode == "reuse_source_spans"))
    version = F.when(F.col("reuse"), F.coalesce("previous_version", "max_version")).otherwise(F.coalesce("max_version", F.lit(0)) + 1)
    rows = rows.withColumn("version", F.when(F.col("outcome") == "queued", version))
    taken = rows.where("outcome = 'queued'").select("document_id", F.lit(True).alias("__taken"))
    after = documents.join(taken, "document_id", "left")
    after = after.withColumn("status", F.when(F.col("__taken"), "queued").otherwise(F.col("status"))).withColumn("last_progress_at", F.when(F.col("__taken").isNull(), F.col("last_progress_at")))
    return after.select(*documents.columns), rows.select("document_id", "outcome", "previous_version", "version", "reuse")
