"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes; a chunk ends where the hash meets a mask, a strict one up to the normal size and a
loose one beyond it (normalised chunking), within a least and a greatest size. A fingerprint is the set of the chunks'
digests with their lengths. Containment is the common length over the smaller total, so a shift changes only the
chunks at its edges.

Results in odd cases: null or empty text has the empty fingerprint; two empty fingerprints are alike (1.0), an empty and a
filled one aren't (0.0). A null doc_id comes before all others; rows with equal doc_id follow one another by
the hash of their text; the last row is followed by the first (a single row by itself). Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_CODE, key_to_id, materialize, rows_of

LEAST, NORMAL, GREATEST = 24, 64, 256
STRICT, LOOSE = np.uint32(0xFF), np.uint32(0x0F)  # 8 and 4 low bits around the 6 of the normal size
#: Ranges of ids at most: their heads are sent to all tasks.
MOST_RANGES = 10_000
#: Rows whose fingerprints a task holds at once.
AT_ONCE = 256
GEAR = (BYTE_CODE >> np.uint64(32)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """Low bits of the gear hash (h = 2h + G[byte]): after five doublings the last 32 bytes have been summed."""
    h = GEAR[buf]
    for shift in (1, 2, 4, 8, 16):
        if len(h) > shift:
            h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    return h


def cuts(h: np.ndarray) -> list[int]:
    """Ends of the chunks of one document, whose hashes are h (computed from its own first byte on)."""
    n, out, start = len(h), [], 0
    loose = np.flatnonzero((h & LOOSE) == 0) + 1
    strict = np.flatnonzero((h & STRICT) == 0) + 1
    loose_list, strict_list = loose.tolist(), strict.tolist()
    i = j = 0
    n_loose, n_strict = len(loose_list), len(strict_list)
    while n - start > LEAST:
        low, mid, high = start + LEAST, start + NORMAL, min(n, start + GREATEST)
        while j < n_strict and strict_list[j] < low:
            j += 1
        if j < n_strict and strict_list[j] < mid:
            end = strict_list[j]
        else:
            while i < n_loose and loose_list[i] < mid:
                i += 1
            end = loose_list[i] if i < n_loose and loose_list[i] <= high else high
        if end >= n:
            break
        out.append(end)
        start = end
    if n:
        out.append(n)
    return out


def chunks(data: bytes) -> dict[str, int]:
    """Digest -> length of the distinct chunks of one text."""
    digest, start, out = xxhash.xxh3_64_hexdigest, 0, {}
    for end in cuts(gear(np.frombuffer(data, np.uint8))):
        out[digest(data[start:end])] = end - start
        start = end
    return out


def fingerprint(chunk: dict[str, int]) -> str:
    return ",".join([f"{k}:{v}" for k, v in sorted(chunk.items())])


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Containment by length, 0 to 1."""
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    return min(1.0, sum([v for k, v in a.items() if k in b]) / min(sum(a.values()), sum(b.values())))


def _span(cuts_at: np.ndarray):
    """Adds the range of each row's id."""

    def run(batches):
        for batch in batches:
            span = np.searchsorted(cuts_at, np.asarray(batch.column(0)), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(span.astype(np.int64))], names=[*batch.schema.names, "span"])

    return run


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 1 << 10) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row. The next
    document stands beside each without moving texts twice: ids are cut into ranges of about rows_per_range rows, a range's rows are sorted in one
    task, and only the first row of each range is sent twice."""
    rows = rows_of(docs, id_col, text_col)
    ids = materialize(rows.select("doc", "row"), "ids")
    # ranges of about as many rows each, cut at quantiles of the ids, whatever gaps these have
    ranges = min(MOST_RANGES, ids.count() // rows_per_range)
    cuts_at = []
    if ranges > 1:
        cuts_at = ids.agg(F.percentile_approx("doc", [k / ranges for k in range(1, ranges)], F.lit(20 * ranges))).first()[0]
    span = _span(np.unique(np.array(cuts_at, np.int64)))
    place = F.struct("doc", "row")
    spans = ids.mapInArrow(span, "doc long, row long, span long").groupBy("span").agg(F.min(place).alias("head"))
    # the range before a range takes a copy of its first row; the last range that of the whole table
    order = Window.orderBy("span")
    heads = spans.select("head", F.lag("span").over(order).alias("prior"), F.last("span").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    heads = materialize(heads.select("head.doc", "head.row", F.coalesce("prior", "end").alias("to"), F.col("prior").isNull().alias("wraps")), "heads")
    own = rows.mapInArrow(span, "doc long, row long, text string, span long")
    copies = own.join(F.broadcast(heads), ["doc", "row"], "left").select(
        "doc", "row", "text", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("span", F.lit(0).alias("role")))).otherwise(F.array(F.struct("span", F.lit(0).alias("role")), F.struct(F.col("to").alias("span"), F.lit(1).alias("role"))))).alias("at")
    )
    sorted_rows = copies.select("doc", "row", "text", "at.span", "at.role").repartition(F.col("span")).sortWithinPartitions("span", "role", "doc", "row")
    out = sorted_rows.mapInArrow(_compare, "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(key_to_id("doc").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _compare(batches):
    """Rows sorted by range, then role (1: copy of the next range's head), doc, row. A head that repeats (equal rows) is
    sent as often; only its first copy counts."""
    before = None  # (span, doc, text, chunks) that still wait for their next
    closed = None  # the range whose head copy has come

    def pair(waiting, text, chunk):
        span, doc, own, own_chunk = waiting
        half = len(own) // 2
        edited = own[: len(own) - half] + text[:half] if half else own
        edited_bytes = edited.encode()
        edited_chunk = own_chunk if edited == own else chunks(edited_bytes)
        return doc, len(own), hashlib.sha256(edited_bytes).hexdigest(), fingerprint(own_chunk), fingerprint(edited_chunk), likeness(own_chunk, edited_chunk), likeness(own_chunk, chunk)

    for batch in (whole.slice(k, AT_ONCE) for whole in batches for k in range(0, whole.num_rows, AT_ONCE)):
        out = []
        texts = batch.column(2)
        for k, (doc, span, role) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
            if role and closed == span:
                continue
            text = texts[k].as_py()
            chunk = chunks(text.encode())
            if before is not None:
                out.append(pair(before, text, chunk))
            before, closed = (None, span) if role else ((span, doc, text, chunk), closed)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), t) for x, t in zip(zip(*out) if out else [()] * 7, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
            names=["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
