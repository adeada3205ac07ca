"""Extraction runs: windows through a provider with a cache of earlier runs, the records of runs, failures, and the life of request batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import catalog, ingest, lifecycle
from tessera.operators.lifecycle import edges
from tessera.sources import scratch, versioned

# Reasons that failures are recorded under, by kind of error.
REASONS = {
    "EmptyPdfError": "pdf_empty", "PdfExtractionError": "pdf_extraction_failed", "FileStorageError": "file_storage_error", "LLMTechnicalError": "llm_extraction_failed",
    "EmbeddingTechnicalError": "embedding_failed", "IntegrityError": "duplicate_span_constraint", "LookupError": "document_or_asset_not_found", "InvalidTransitionError": "invalid_status_transition",
}
# Default settings.
SUBMITTING_MINUTES, WINDOWS_PER_COMMIT = 60, 5
#: What a valid output has: its fields, all of which must be there.
OUTPUT = "struct<items: array<struct<title: string, body_text: string>>>"


def reason_for(error: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[error], F.lit("unknown_error"))


def mark_failed(documents: DataFrame, failures: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """failed: (document_id, error, message, failed_at) -> documents and failures. Only documents that may still fail do, each once (its first error
    by failed_at); the failure keeps the status that the document had."""
    may = edges(documents.sparkSession).where("to_status = 'failed'").select(F.col("from_status").alias("status"))
    first = catalog.latest(failed, ["document_id"], [F.asc("failed_at"), F.asc("error"), F.asc("message")]).drop("recent")
    hit = first.join(documents.select("document_id", "status"), "document_id").join(F.broadcast(may), "status", "left_semi")
    rows = hit.select("document_id", F.col("status").alias("last_status"), reason_for(F.col("error")).alias("reason"), F.col("message").alias("error_message"), "failed_at")
    out = documents.join(rows.select("document_id", F.lit(True).alias("__failed")), "document_id", "left")
    status = F.when(F.col("__failed"), "failed").otherwise(F.col("status"))
    return out.withColumn("status", status).select(*documents.columns), failures.unionByName(rows)


def commit_batches(windows: DataFrame, key: str = "document_id", order: str = "window", size: int = WINDOWS_PER_COMMIT) -> DataFrame:
    """Adds `commit`: contiguous runs of `size` windows of each document, from 0."""
    return windows.withColumn("commit", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("int"))


def render_prompt(template: Column, window: Column, mark: str = "{window}") -> Column:
    return F.replace(template, F.lit(mark), window)


def call_provider(windows: DataFrame, provider: Callable[[list[str]], list], key: list[str]) -> DataFrame:
    """windows: (key, prompt) -> (key, output, parse_error, error). provider: prompts -> for each a pair (JSON text or None, parse error or None); it
    may raise: then the windows of that call have the error and the others go on."""
    schema = windows.select(*key).schema.add("output", "string").add("parse_error", "string").add("error", "string")

    def run(frames):
        for pdf in frames:
            try:
                found = [(*pair, None) for pair in provider(list(pdf["prompt"]))]
            except Exception as e:
                found = [(None, None, f"{type(e).__name__}: {e}")] * len(pdf)
            out = pdf[key].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(found, columns=["output", "parse_error", "error"], index=out.index, dtype=object)], axis=1)

    return windows.select(*key, "prompt").mapInPandas(run, schema)


def run_status(output: Column, error: Column, schema: str = OUTPUT) -> Column:
    """failed: the call broke down; rejected: no output, or one that lacks a required field; else success."""
    parsed = F.from_json(output, schema)
    items = parsed["items"]
    whole = items.isNotNull() & F.forall(F.coalesce(items, F.array()), lambda i: i["title"].isNotNull() & i["body_text"].isNotNull())
    return F.when(error.isNotNull(), "failed").when(output.isNull() | ~F.coalesce(whole, F.lit(False)), "rejected").otherwise("success")


def extract(windows: DataFrame, runs: DataFrame, provider: Callable[[list[str]], list], key: list[str], version: list[str] = ("input_hash",)) -> DataFrame:
    """windows: (key, version columns, prompt) -> run records (key, version, status, output_json, error, cached). A window whose input a successful run had
    takes that run's output and never reaches the provider; of windows with the same input one is asked."""
    good = catalog.latest(runs.where("status = 'success'"), list(version), [F.desc("created_at"), F.desc("run_id")]).select(*version, F.col("output_json").alias("known_output"))
    known = windows.join(good, list(version), "left")
    asked = catalog.latest(known.where("known_output IS NULL"), list(version), [F.asc(k) for k in key]).select(*version, "prompt")
    answers = call_provider(asked, provider, list(version))
    fresh = known.where("known_output IS NULL").drop("known_output").join(answers, list(version), "left")
    fresh = fresh.select(*key, *version, run_status(F.col("output"), F.col("error")).alias("status"), F.when(F.col("error").isNull(), F.col("output")).alias("output_json"), F.coalesce("error", "parse_error").alias("error"), F.lit(False).alias("cached"))
    cached = known.where("known_output IS NOT NULL").select(*key, *version, F.lit("success").alias("status"), F.col("known_output").alias("output_json"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    return cached.unionByName(fresh)


class ExtractionFailed(RuntimeError):
    """Some windows of a commit had no answer; the others are recorded."""


def prepare_windows(windows: DataFrame, path: str, key: str = "document_id", order: str = "window", size: int = WINDOWS_PER_COMMIT, commits_at_once: int = 64) -> None:
    """Store the windows of a job below path/windows, one folder for each group of commits that extract_durably() asks for at once: every commit is `size`
    consecutive windows of one document, and a document's commits are in groups that follow each other."""
    rows = commit_batches(windows, key, order, size)
    group = F.floor(F.col("commit") + F.pmod(F.xxhash64(key), F.lit(2))).cast("int")
    within = F.pmod(F.xxhash64(key, "commit"), F.lit(max(1, commits_at_once)))
    rows.withColumn("wave", group).repartition("wave", within).write.partitionBy("wave").parquet(f"{path.rstrip('/')}/windows")


def recorded(spark: SparkSession, path: str, key: list[str]) -> DataFrame | None:
    """The run records so far, of a window's several ones its last success or else its last; None before the first commit."""
    if versioned.version(spark, f"{path}/runs") < 0:
        return None
    rows = versioned.read(spark, f"{path}/runs")
    return catalog.latest(rows, key, [F.desc(F.col("status") == "success"), F.desc("recorded_at"), F.desc("run_id")]).drop("recent")


def extract_durably(spark: SparkSession, path: str, provider: Callable[[list[str]], list], key: list[str], version: list[str] = ("input_hash",), after: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """extract() over the prepared windows, group by group: a group's records are committed to the versioned table path/runs before its errors are
    raised, so whatever breaks the job (a provider, a lost driver) costs one group at most; run again, it asks only for windows that no success is
    recorded for. A commit that was made is never made again. after: called with each group's records once they are committed (a heartbeat). Returns
    recorded()."""
    path = path.rstrip("/")
    windows = spark.read.parquet(f"{path}/windows")
    for wave in sorted(r["wave"] for r in windows.select("wave").distinct().collect()):
        known = recorded(spark, path, key)
        mine = windows.where(F.col("wave") == wave).drop("wave", "commit")
        if known is not None:
            mine = mine.join(known.where("status <> 'failed'").select(*key), key, "left_anti")
        if mine.isEmpty():
            continue
        none = spark.createDataFrame([], "run_id string, status string, output_json string, created_at timestamp").select("*", *[F.lit(None).cast(mine.schema[v].dataType).alias(v) for v in version])
        runs = none if known is None else known.select("run_id", "status", "output_json", F.col("recorded_at").alias("created_at"), *version)
        done = scratch.stored(extract(mine, runs, provider, key, version).withColumn("run_id", F.uuid()).withColumn("recorded_at", F.current_timestamp()), "commit")
        tries = sum(e["commit"] is not None and e["commit"].startswith(f"{wave}.") for e in versioned.entries(spark, f"{path}/runs"))
        versioned.append(done, f"{path}/runs", f"{wave}.{tries}")
        if after is not None:
            after(done)
        failed = done.where("status = 'failed'")
        if not failed.isEmpty():
            raise ExtractionFailed(failed.first()["error"])
    return recorded(spark, path, key)


def produced_by(items: DataFrame, runs: DataFrame, again: DataFrame) -> DataFrame:
    """Items with the window of the run that made them, and `carried`: that window is not among those extracted again (window_key)."""
    rows = items.join(runs.select("run_id", "window_key"), "run_id")
    return rows.join(again.select("window_key").distinct().withColumn("__again", F.lit(True)), "window_key", "left").withColumn("carried", F.col("__again").isNull()).drop("__again")


def claim_batch(items: DataFrame, batch_id: str, schema_version: str, order: list[str], size: str, most: int = ingest.BATCH_REQUESTS, most_bytes: int = ingest.BATCH_BYTES) -> DataFrame:
    """Items with the front of the queue moved to `submitting` in this batch: pending, unclaimed items of the schema that holds now."""
    free = items.where((F.col("status") == "pending") & F.col("batch_id").isNull() & (F.col("schema_version") == schema_version))
    taken = ingest.first_claim(free, order, size, most, most_bytes).select("item_id", F.lit(True).alias("__taken"))
    rows = items.join(taken, "item_id", "left")
    return rows.withColumn("status", F.when(F.col("__taken"), "submitting").otherwise(F.col("status"))).withColumn("batch_id", F.when(F.col("__taken"), F.lit(batch_id)).otherwise(F.col("batch_id"))).select(*items.columns)


def submit_batches(batches: DataFrame, items: DataFrame, submit: Callable[[list[tuple[str, str]]], str]) -> DataFrame:
    """(batch_id, provider_batch_id, error) of the batches that are to be submitted, as settle_batches() wants answers. submit: the requests (input_hash, prompt) of
    one batch, at most BATCH_REQUESTS of them -> the provider's id for it; where it raises, that batch alone has no id."""
    requests = items.where("status = 'submitting'").groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("input_hash", "prompt"))).alias("requests"))
    waiting = batches.where("processing_status = 'submitting'").select("batch_id").join(requests, "batch_id")

    def run(frames):
        for pdf in frames:
            out = []
            for batch, listed in zip(pdf["batch_id"], pdf["requests"]):
                try:
                    out.append((batch, str(submit([(r["input_hash"], r["prompt"]) for r in listed])), None))
                except Exception as e:  # isolated: its items are pending again
                    out.append((batch, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["batch_id", "provider_batch_id", "error"])

    return waiting.mapInPandas(run, f"batch_id {batches.schema['batch_id'].dataType.simpleString()}, provider_batch_id string, error string")


def settle_batches(batches: DataFrame, items: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers: (batch_id, provider_batch_id: null where the call failed) for submitting batches -> batches and items. Accepted ones are submitted; of the
    others the batch is failed and its items are pending again."""
    told = answers.select("batch_id", F.col("provider_batch_id").alias("__id"), F.lit(True).alias("__told"))
    hit = F.col("__told") & (F.col("processing_status") == "submitting")
    rows = batches.join(told, "batch_id", "left").withColumn("__new", F.when(hit, F.when(F.col("__id").isNotNull(), "submitted").otherwise("failed")))
    out = rows.withColumn("processing_status", F.coalesce("__new", "processing_status")).withColumn("provider_batch_id", F.when(F.col("__new") == "submitted", F.col("__id")).otherwise(F.col("provider_batch_id")))
    moved = items.join(rows.where("__new IS NOT NULL").select("batch_id", "__new"), "batch_id", "left")
    status = F.when(F.col("__new") == "submitted", "submitted").when(F.col("__new") == "failed", "pending").otherwise(F.col("status"))
    batch = F.when(F.coalesce(F.col("__new") != "failed", F.lit(True)), F.col("batch_id"))
    return out.select(*batches.columns), moved.withColumn("status", status).withColumn("batch_id", batch).select(*items.columns)


def stale_batches(batches: DataFrame, now: Column, minutes: int = SUBMITTING_MINUTES) -> DataFrame:
    """Batches that a crash left submitting, as answers for settle_batches(): all go back."""
    late = (F.col("processing_status") == "submitting") & (F.col("created_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    return batches.where(late).select("batch_id", F.lit(None).cast("string").alias("provider_batch_id"))


#: Batches whose results a task holds at once.
POLLED = 16
#: What a provider says of a request.
RESULT = "array<struct<input_hash:string,result_type:string,parsed:boolean,valid:boolean,retryable:boolean>>"


def poll_batches(batches: DataFrame, items: DataFrame, retrieve: Callable[[str, list[str]], tuple[str, list[dict]]]) -> DataFrame:
    """(batch_id, ended, error, results) of the submitted batches that a provider knows. retrieve: (provider_batch_id, input hashes of its requests) -> (status,
    results). A batch whose call raises has the error and stays as it is, the others go on."""
    requests = items.where("status = 'submitted'").groupBy("batch_id").agg(F.collect_list("input_hash").alias("hashes"))  # BATCH_REQUESTS at most
    open_ = batches.where("processing_status = 'submitted' AND provider_batch_id IS NOT NULL").select("batch_id", "provider_batch_id").join(requests, "batch_id", "left")
    fields = ["input_hash", "result_type", "parsed", "valid", "retryable"]

    def run(frames):
        for pdf in (whole.iloc[k : k + POLLED] for whole in frames for k in range(0, len(whole), POLLED)):
            out = []
            for batch, known, hashes in zip(pdf["batch_id"], pdf["provider_batch_id"], pdf["hashes"]):
                try:
                    status, results = retrieve(known, [] if hashes is None else list(hashes))
                    out.append((batch, status == "ended", None, [{k: r.get(k) for k in fields} for r in results] if status == "ended" else []))
                except Exception as e:  # isolated: the next poll tries again
                    out.append((batch, False, f"{type(e).__name__}: {e}", []))
            yield pd.DataFrame(out, columns=["batch_id", "ended", "error", "results"])

    return open_.mapInPandas(run, f"batch_id {batches.schema['batch_id'].dataType.simpleString()}, ended boolean, error string, results {RESULT}")


def ingest_polled(batches: DataFrame, items: DataFrame, runs: DataFrame, polled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What poll_batches() found -> batches, items with `run_status` (the run record that each new result makes), and (document_id, source_version) of the
    documents that have no unfinished window left since: these are to be driven on."""
    ended = polled.where("ended")
    told = lifecycle.batch_results(items, ended.select(F.inline("results")), runs)
    mine = ended.select("batch_id", F.lit(True).alias("__mine"))
    rows = told.join(mine, "batch_id", "left").withColumn("new_status", F.when(F.col("__mine"), F.col("new_status")).otherwise(F.col("status")))
    after = rows.select(*[F.col("new_status").alias("status") if c == "status" else F.when(F.col("new_status") != "pending", F.col("batch_id")).alias("batch_id") if c == "batch_id" else F.col(c) for c in items.columns], F.when(F.col("__mine"), F.col("run_status")).alias("run_status"))
    touched = rows.where("new_status <> status").select("document_id", "source_version").distinct()
    done = lifecycle.finished(after).join(touched, ["document_id", "source_version"])
    moved = batches.join(mine, "batch_id", "left").withColumn("processing_status", F.when(F.col("__mine"), "ended").otherwise(F.col("processing_status"))).select(*batches.columns)
    return moved, after, done
