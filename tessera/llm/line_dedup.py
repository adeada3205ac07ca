"""Line deduplication through a sharded minimal perfect hash.

1. Every line's key (stripped, A-Z lowered) becomes a 128-bit hash, beside its document and line number.
2. The distinct hashes, each with its first document and its count of lines, are dealt to shards. A shard holds a minimal
   perfect hash (levels of bit arrays), and by its slots compact arrays: fingerprint, count, first document.
3. Lines' hashes (never the lines) go to their shard and probe the arrays. A shard that hot lines make busy is
   served by several copies of its arrays, so that no task gets more than a fair share of probes.
4. Line numbers to drop go back to the documents.

Results in odd cases: null or empty text is one empty line; a null doc_id is one document, smaller than all others;
repeated rows share their doc_id and so are the same document (each row is returned); other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, key_to_id, materialize, mix64, rows_of

LINES = "doc long, row long, ord int, hi long, lo long"
INDEX = "shard int, load long, n int, levels binary, sizes array<int>, prints binary, counts binary, firsts binary"
KEYS_PER_SHARD = 1 << 14
GAMMA = 1.7


def line_keys(min_chars: int):
    """Batches of documents -> the lines whose key has min_chars code points."""

    def run(batches):
        for batch in batches:
            out_doc, out_ord, digests = [], [], bytearray()
            add = digests.extend
            for k, text in enumerate(batch.column(2).to_pylist()):
                for n, line in enumerate(text.encode().split(b"\n")):
                    key = line.strip(b" \t\n\x0b\x0c\r")
                    size = len(key)
                    if size >= min_chars and (size >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                        out_doc.append(k)
                        out_ord.append(n)
                        add(xxhash.xxh3_128_digest(key.lower()))
            at = np.array(out_doc, np.int64)
            pair = np.frombuffer(bytes(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.array(out_ord, np.int32)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())],
                names=["doc", "row", "ord", "hi", "lo"],
            )

    return run


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = mix64(hi.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) ^ lo.view(np.uint64)
    return (mix64(mixed) % np.uint64(size)).astype(np.int64)


def build_perfect_hash(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bits of all levels and each level's size, for distinct keys. A key's slot is the rank of its bit."""
    bits, sizes = [], []
    while len(hi):
        size = max(8, int(GAMMA * len(hi)))
        at = _place(hi, lo, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        left = ~alone[at]
        hi, lo = hi[left], lo[left]
    return (np.concatenate(bits) if bits else np.zeros(0, bool)), sizes


def slots(bits: np.ndarray, sizes, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 for a key that no level takes."""
    rank = np.cumsum(bits) - 1
    out, todo, base = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
    for level, size in enumerate(sizes):
        if not len(todo):
            break
        at = base + _place(hi[todo], lo[todo], level, int(size))
        hit = bits[at]
        out[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + int(size)
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    hi, lo = pdf["hi"].to_numpy(np.int64), pdf["lo"].to_numpy(np.int64)
    bits, sizes = build_perfect_hash(hi, lo)
    slot = slots(bits, sizes, hi, lo)
    prints, counts, firsts = np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
    prints[slot] = lo.view(np.uint64).astype(np.uint32)
    # 0 marks a line that only one document holds
    counts[slot] = np.where(pdf["first"].to_numpy() == pdf["last"].to_numpy(), 0, pdf["n"].to_numpy())
    firsts[slot] = pdf["first"].to_numpy()
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "load": [int(pdf["n"].sum())], "n": [len(hi)], "levels": [np.packbits(bits).tobytes()], "sizes": [sizes], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "firsts": [firsts.tobytes()]})


def _probe(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Lines that some smaller document holds already."""
    if probes.empty or index.empty:
        return pd.DataFrame({"doc": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "ord": np.zeros(0, np.int32)})
    at = index.iloc[0]
    bits = np.unpackbits(np.frombuffer(at["levels"], np.uint8))[: int(np.sum(at["sizes"]))].astype(bool)
    hi, lo = probes["hi"].to_numpy(np.int64), probes["lo"].to_numpy(np.int64)
    slot = slots(bits, at["sizes"], hi, lo)
    known = slot >= 0
    known &= np.frombuffer(at["prints"], np.uint32)[slot] == lo.view(np.uint64).astype(np.uint32)
    drop = known & (np.frombuffer(at["counts"], np.int64)[slot] > 0) & (np.frombuffer(at["firsts"], np.int64)[slot] != probes["doc"].to_numpy())
    return probes.loc[drop, ["doc", "row", "ord"]]


def _rebuild(batches):
    for batch in batches:
        docs, texts, drops = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        kept, n_lines, n_dropped, digests = [], [], [], []
        for text, drop in zip(texts, drops):
            lines = text.split("\n")
            n_lines.append(len(lines))
            if drop:
                gone = set(drop)
                n_dropped.append(len(gone))
                text = "\n".join([x for n, x in enumerate(lines) if n not in gone])
            else:
                n_dropped.append(0)
            kept.append(text)
            digests.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([docs, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())], names=["doc", "text", "n_lines", "n_dropped", "kept_sha256"])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, text (what is left), n_lines (before), n_dropped, kept_sha256: one row for each row of docs."""
    rows = rows_of(docs, id_col, text_col)
    lines = materialize(rows.mapInArrow(line_keys(min_chars), LINES), "lines")
    shards = max(1, -(-lines.count() // KEYS_PER_SHARD))
    shard = F.pmod(F.col("hi"), F.lit(shards)).cast("int").alias("shard")
    distinct = lines.groupBy("hi", "lo").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    index = materialize(distinct.select(shard, "hi", "lo", "first", "last", "n").groupBy("shard").applyInPandas(_build, INDEX), "line-index")

    # copies of a shard's arrays: as many as its probes fill fair shares
    fair = max(4096.0, index.agg(F.avg("load")).first()[0] or 0.0)
    copies = index.select("shard", F.ceil(F.col("load") / F.lit(fair)).cast("int").alias("copies"))
    served = index.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    busy = copies.where("copies > 1")
    probes = lines.select(shard, "doc", "row", "ord", "hi", "lo").join(busy, "shard", "left")
    probes = probes.withColumn("copy", F.when(F.col("copies").isNotNull(), F.pmod(F.xxhash64("doc", "row", "ord"), F.col("copies"))).otherwise(0).cast("int")).drop("copies")
    hits = probes.groupBy("shard", "copy").cogroup(served.groupBy("shard", "copy")).applyInPandas(_probe, "doc long, row long, ord int")
    drops = materialize(hits.groupBy("doc", "row").agg(F.sort_array(F.collect_set("ord")).alias("drops")), "line-drops")
    discard(lines)
    discard(index)
    # a merge join at every size: the texts move once
    out = rows.join(drops.hint("merge"), ["doc", "row"], "left").select("doc", "text", "drops")
    out = out.mapInArrow(_rebuild, "doc long, text string, n_lines long, n_dropped long, kept_sha256 string")
    return out.select(key_to_id("doc").alias("doc_id"), "text", "n_lines", "n_dropped", "kept_sha256")
