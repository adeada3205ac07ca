"""Sources and sinks: paged binary documents, tab-separated fixtures, manifests, prompts, reports. All reading and writing goes
through Spark, so any file system that Spark knows will do."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def form_feed_pages(content: bytes) -> list[str]:
    """The default page reader: text with form feeds between pages."""
    return content.decode("utf-8", "replace").split("\f")


def read_pages(files: DataFrame, reader: Callable[[bytes], list[str]] = form_feed_pages, sparse: int = 20) -> DataFrame:
    """files: (path, content) -> (path, page, text, method, confidence); pages count from 1. Any PDF library can be the reader."""

    def run(frames):
        for pdf in frames:
            rows = [(p, k + 1, t) for p, c in zip(pdf["path"], pdf["content"]) for k, t in enumerate(reader(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    pages = files.select("path", "content").mapInPandas(run, "path string, page int, text string")
    return pages.withColumn("method", F.lit("embedded_text")).withColumn("confidence", F.when(F.length(F.trim("text")) < sparse, F.lit(0.0)))


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Lines without blank ones and those that start with #. A line with another number of columns fails the job."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    parts = F.split("value", "\t", -1)
    rows = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select("line", parts.alias("parts"))
    right = F.when(F.size("parts") == len(columns), F.col("parts")).otherwise(F.raise_error(F.concat(F.lit(f"expected {len(columns)} columns: "), F.array_join("parts", "|"))))
    return rows.select("line", right.alias("parts")).select("line", *[F.trim(F.col("parts")[k]).alias(c) for k, c in enumerate(columns)])


def check_fixtures(queries: DataFrame, qrels: DataFrame) -> None:
    """Raises for empty sides, duplicate query ids, and ids that only one side has."""
    problems = []
    if queries.isEmpty() or qrels.isEmpty():
        problems.append("queries or judgements are empty")
    if not queries.groupBy("query_id").count().where("count > 1").isEmpty():
        problems.append("a query_id repeats")
    if not queries.join(qrels, "query_id", "left_anti").isEmpty():
        problems.append("a query has no judgement")
    if not qrels.join(queries, "query_id", "left_anti").isEmpty():
        problems.append("a judgement has no query")
    if problems:
        raise ValueError("; ".join(problems))


def read_whole_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, folder, text) of files that are read as one value each, ordered by folder when shown."""
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.col("value").alias("text"))


def read_fixtures(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """(name, source, expected: parsed by the given schema, expected_text, notes: null without a file) of fixture folders with source.md, expected.json and maybe
    notes.md. A folder without one of the first two has null there."""
    of = lambda name: read_whole_texts(spark, path, name).select(F.col("folder").alias("name"), F.col("text").alias(name.split(".")[0]))
    rows = of("source.md").join(of("expected.json"), "name", "full_outer").join(of("notes.md"), "name", "left")
    return rows.select("name", "source", F.from_json("expected", expected).alias("expected"), F.col("expected").alias("expected_text"), "notes")


def prompt_version(text: Column) -> Column:
    """The version that a prompt's header names, before the first blank line; null without one."""
    header = F.regexp_extract(F.concat(text, F.lit("\n\n")), r"(?s)^(.*?)\r?\n\r?\n", 1)
    return F.nullif(F.trim(F.regexp_extract(header, r"(?m)^version:[ \t]*(\S.*?)[ \t]*$", 1)), F.lit(""))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of page ranges -> (set, book, first, last, name)."""
    raw = spark.read.json(path, multiLine=True, schema="set string, books map<string, array<struct<pages: array<int>, name: string>>>")
    return raw.select("set", F.explode("books").alias("book", "ranges")).select("set", "book", F.explode("ranges").alias("r")).select("set", "book", F.col("r.pages")[0].alias("first"), F.try_element_at("r.pages", F.lit(-1)).alias("last"), F.col("r.name").alias("name"))


def cut_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """pages: (book, page, text); ranges: (book, first, last, name) -> the text of each range, a blank line between pages."""
    hit = pages.join(ranges, "book").where(F.col("page").between(F.col("first"), F.col("last")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
    return hit.groupBy("book", "name", "first", "last").agg(text.alias("text"), F.count(F.lit(1)).alias("n_pages"))


def check_ranges(ranges: DataFrame, pages: DataFrame) -> None:
    """Raises, before anything is cut, for ranges that are empty or end before they begin, lie outside their book, or share a name within a set."""
    sizes = pages.groupBy("book").agg(F.max("page").alias("n"))
    bad = ranges.join(sizes, "book", "left").where(F.col("first").isNull() | (F.col("first") < 1) | (F.col("last") < F.col("first")) | F.col("n").isNull() | (F.col("last") > F.col("n")))
    problems = [f"{r['book']} {r['first']}-{r['last']} is no range of the book" for r in bad.limit(20).collect()]
    problems += [f"the name {r['name']} repeats" for r in ranges.groupBy("set", "name").count().where("count > 1").limit(20).collect()]
    if problems:
        raise ValueError("; ".join(problems))


def publish_cuts(pages: DataFrame, ranges: DataFrame, folder: str) -> None:
    """Checks all ranges, then writes their texts in one job; Spark's committer shows the folder only when all are written."""
    check_ranges(ranges, pages)
    cut_ranges(pages, ranges).write.mode("error").json(folder)


def write_report(rows: DataFrame, folder: str, run_id: str, status: str = "ok") -> str:
    """A report's rows as JSON lines below folder/run_id, with its status. An existing report is never overwritten."""
    path = f"{folder.rstrip('/')}/{run_id}"
    rows.withColumn("run_id", F.lit(run_id)).withColumn("run_status", F.lit(status)).write.mode("error").json(path)
    return path


def run_report(make: Callable[[], DataFrame], folder: str, run_id: str, spark: SparkSession) -> str:
    """write_report() of what make() returns; where it raises, a failed run with the error is recorded and the error goes on."""
    try:
        return write_report(make(), folder, run_id)
    except Exception as e:
        if not has_files(spark, f"{folder.rstrip('/')}/{run_id}"):
            write_report(spark.createDataFrame([(f"{type(e).__name__}: {e}"[:2000],)], "error string"), folder, run_id, "failed")
        raise


def save_baseline(spark: SparkSession, report: str, baseline: str) -> None:
    """Copies a report's rows as a baseline; failed runs and used names are refused."""
    rows = spark.read.json(report)
    if not rows.where("run_status <> 'ok'").isEmpty():
        raise ValueError("a failed run is no baseline")
    rows.write.mode("error").json(baseline)


def insert_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table, key, "left_anti"))


def safe_path(path: Column) -> Column:
    """The path; a job over one that is empty, absolute, has a drive, a back slash, a control character or a part "..", "." or "" fails: what is stored under
    it could leave the store's folder."""
    parts = F.split(path, "/", -1)
    bad = path.isNull() | path.rlike(r"^$|^/|^[A-Za-z]:|[\\\x00-\x1f]") | F.exists(parts, lambda p: p.isin("..", ".", ""))
    return F.when(bad, F.raise_error(F.concat(F.lit("unsafe path: "), F.coalesce(path, F.lit("null"))))).otherwise(path)


def put_files(files: DataFrame, table: str) -> None:
    """Stores (path, content) rows; a path that is there already stays as it is, and one that safe_path() refuses fails the job before anything is stored."""
    rows = files.select(safe_path(F.col("path")).alias("path"), "content").dropDuplicates(["path"])
    spark = files.sparkSession
    if has_files(spark, table):
        rows = rows.join(spark.read.parquet(table).select("path"), "path", "left_anti")
    rows.write.mode("append").parquet(table)


def has_files(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def delete_files(table: DataFrame, gone: DataFrame) -> DataFrame:
    """What is left of stored files; paths that are not there are no error."""
    return table.join(gone.select("path"), "path", "left_anti")


# Fields of an alignment record.
ALIGNMENT = "fixture_id string, human_rating string, judge_rating string, agreement_status string, judge_version string, artifact_hash string"


def read_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment records, none where the folder doesn't exist."""
    return spark.read.schema(ALIGNMENT).json(folder) if has_files(spark, folder) else spark.createDataFrame([], ALIGNMENT)


def write_alignment(records: DataFrame, folder: str, run_id: str) -> None:
    """A run's records below folder/run_id; a record that is there already is never overwritten."""
    records.select(*[c.split()[0] for c in ALIGNMENT.split(", ")]).write.mode("error").json(f"{folder.rstrip('/')}/{run_id}")


def update_report(spark: SparkSession, report: str, section: str, rows: DataFrame) -> str:
    """Adds a section to a report: a folder of its own beside the results, so the results are never rewritten. A failed run is refused."""
    if not spark.read.json(report).where("run_status <> 'ok'").isEmpty():
        raise ValueError("a failed run gets no further sections")
    path = f"{report.rstrip('/')}.{section}"
    rows.write.mode("error").json(path)
    return path


def append_summary(spark: SparkSession, report: str, block: str) -> None:
    """Add a block to the summary that stands beside a report, below the blocks that are there."""
    known = read_summary(spark, report)
    n = 0 if known is None else spark.read.json(f"{report.rstrip('/')}.summary").agg(F.max("n")).first()[0] + 1
    spark.createDataFrame([(n, block.rstrip("\n"))], "n int, block string").coalesce(1).write.mode("append").json(f"{report.rstrip('/')}.summary")


def read_summary(spark: SparkSession, report: str) -> str | None:
    """The blocks of a report's summary in order, None where there is none."""
    path = f"{report.rstrip('/')}.summary"
    if not has_files(spark, path):
        return None
    return "".join(f"{r['block']}\n" for r in spark.read.json(path).orderBy("n").collect())


def write_items(rows: DataFrame, report: str, key: str, text: str) -> None:
    """One folder of text for each item of a report, named by the item's slug."""
    from tessera.functions.text import slug

    rows.select(slug(F.col(key).cast("string")).alias("item"), F.col(text).alias("value")).repartition("item").write.mode("error").partitionBy("item").text(f"{report.rstrip('/')}.items")


def latest_run(spark: SparkSession, folder: str) -> str | None:
    """The run of the greatest name below a folder of reports; hidden ones and sections are skipped."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not has_files(spark, folder):
        return None
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = [s.getPath().getName() for s in found if s.isDirectory()]
    names = [n for n in names if not n.startswith((".", "_")) and "." not in n]
    return f"{folder.rstrip('/')}/{max(names)}" if names else None
