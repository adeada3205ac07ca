"""Shared helpers of the training-data operators: scratch tables, row keys, batch access, hashing."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null doc_id inside the operators: one document, smaller than every other.
NULL_ID = -(2**63)
#: Text bytes that a task works on at once (a longer text is taken whole).
BLOCK_BYTES = 1 << 18
#: Spark's setting that deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a folder of our own if driver and executors are one
    process; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own_folder()


def scratch_folder(spark: SparkSession) -> str:
    """Where this application's scratch tables are."""
    return f"{scratch_root(spark).rstrip('/')}/tessera/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. For when its results are written: what an operator returns may still read some."""
    _delete(spark, scratch_folder(spark))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df below the shared folder and read it back: lineage ends there, lost executors don't redo earlier steps,
    and later joins know the real size. The shuffle files of the run are deleted when it is over."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that no later step reads."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])


def doc_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def key_to_id(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def ids_repeat(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether some doc_id stands in several rows: one aggregation of the ids. Operators ask once and pass the answer on."""
    return docs.groupBy(doc_key(id_col).alias("doc")).count().where("count > 1").limit(1).count() > 0


def _row_key(docs: DataFrame, id_col: str, text_col: str, repeat: bool | None) -> Column:
    repeat = ids_repeat(docs, id_col) if repeat is None else repeat
    return F.xxhash64(_text(text_col)) if repeat else F.lit(0).cast("long")


def key_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: bool | None = None) -> list[Column]:
    """doc and row, as in rows_of()."""
    return [doc_key(id_col).alias("doc"), _row_key(docs, id_col, text_col, repeat).alias("row")]


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: bool | None = None) -> DataFrame:
    """doc (long, never null), row, text (string, never null). row tells apart different texts that share a doc_id: the
    hash of the text, or 0 where no doc_id repeats."""
    return docs.select(*key_columns(docs, id_col, text_col, repeat), _text(text_col).alias("text"))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _by_keys(docs: DataFrame, keys: DataFrame, how: str, once: bool, id_col: str, text_col: str, repeat: bool | None) -> DataFrame:
    repeat = ids_repeat(docs, id_col) if repeat is None else repeat
    doc, row = free_names(docs, "doc_key", "row_key")
    # a merge join at every size: the texts move once, however many keys there are
    keys = keys.select(F.col("doc").alias(doc), F.col("row").alias(row)).distinct().hint("merge")
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns), doc_key(id_col).alias(doc), _row_key(docs, id_col, text_col, repeat).alias(row))
    kept = own.join(keys, [doc, row], how)
    if once and repeat:
        kept = kept.dropDuplicates([doc, row])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_rows(docs: DataFrame, keys: DataFrame, once: bool = False, id_col: str = "doc_id", text_col: str = "text", repeat: bool | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose (doc, row) is in keys; once: one of equal rows."""
    return _by_keys(docs, keys, "left_semi", once, id_col, text_col, repeat)


def drop_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: bool | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose (doc, row) is not in keys."""
    return _by_keys(docs, keys, "left_anti", False, id_col, text_col, repeat)


# -- batches -----------------------------------------------------------------------------------------------------------


def byte_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, and where each starts (one more entry: the end). Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def blocks(buf: np.ndarray, at: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `limit` bytes each; a longer document is alone."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


# -- hashing -----------------------------------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
OTHER_CODE = mix64(BYTE_CODE + np.uint64(1))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit codes, with a leading 0."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], equal for equal spans wherever they stand."""
    inverse = powers(len(prefix))[1]
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(is_word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, which never cross a document's bounds, and the document of each."""
    n = len(is_word)
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    inner = at[:-1][at[:-1] < n]
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words (len(words) - n + 1 of them)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0xD1342543DE82EF95) + words[k : k + count])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
