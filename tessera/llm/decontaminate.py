"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lowered. Both sides hash every K words;
each run of SPAN - K + 1 such hashes keeps its least (the rightmost of equal ones). A shared span of SPAN words therefore
shares a kept fingerprint. Fingerprints are joined, and each hit is extended to the windows of SPAN words around it, which are
joined with the items' windows (128-bit hashes); runs of such windows are the shared spans. An item with fewer words is one
window: its hash is sought at every place. A document's work grows with its own words, an item's with its own, whatever repeats in them.

Results in odd cases: a null or empty text has no words and no hits; an item without words matches nothing; items that
share an item_id are one item; a null doc_id is kept as such; an item without an item_id can't be listed, so it is ignored;
repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_CODE, LOWER, OTHER_CODE, blocks, byte_offsets, discard, drop_rows, ids_repeat, key_to_id, materialize, ngram_hash, prefix_hash, rows_of, signed, span_hash, word_spans

SPAN, K = 10, 5
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def kept_places(grams: np.ndarray, width: int) -> np.ndarray:
    """Where the least hash of each run of `width` hashes stands (the rightmost of equal ones)."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    runs = sliding_window_view(grams[::-1], width)
    return np.unique(len(grams) - 1 - (np.arange(len(runs)) + runs.argmin(axis=1)))


def prints_of(words: np.ndarray, span: int, short: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the kept fingerprints of one text, and of all its n-grams for each n of `short`."""
    grams = ngram_hash(words, K)
    at = kept_places(grams, span - K + 1)
    out = [(at, grams[at])]
    for n in short:
        grams = ngram_hash(words, n) ^ np.uint64(n)
        out.append((np.arange(len(grams)), grams))
    return out


def texts_words(column: pa.Array, codes: tuple = (BYTE_CODE,)):
    """For each text the hashes of its words, once for each table of codes."""
    buf, at = byte_offsets(column)
    for first, last in blocks(buf, at):
        low = LOWER[buf[at[first] : at[last]]]
        own = at[first : last + 1] - at[first]
        starts, ends, _ = word_spans(IS_WORD[low], own)
        hashes = [span_hash(prefix_hash(code[low]), starts, ends) for code in codes]
        bounds = np.searchsorted(starts, own)
        for k in range(last - first):
            yield [h[bounds[k] : bounds[k + 1]] for h in hashes]


def window_hashes(words: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each n consecutive words, from two hashes of each word."""
    return ngram_hash(words[0], n), ngram_hash(words[1], n)


def _document_prints(span: int, short: list[int]):
    def run(batches):
        for batch in batches:
            found, sizes = [], []
            for (words,) in texts_words(batch.column(2)):
                prints = np.unique(np.concatenate([h for _, h in prints_of(words, span, short)]))
                found.append(prints)
                sizes.append(len(prints))
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(signed(np.concatenate(found)) if found else np.zeros(0, np.int64))], names=["doc", "row", "print"])

    return run


def _item_prints(span: int):
    """The fingerprints of items; n: the number of words of an item that is one short window, else `span`."""

    def run(batches):
        for batch in batches:
            sizes, prints = [], []
            for (words,) in texts_words(batch.column(1)):
                if len(words):
                    n = min(len(words), span)
                    found = np.unique(prints_of(words, span, [n] if n < span else [])[-1][1])
                    sizes.append(np.full(len(found), n, np.int32)), prints.append(found)
            sizes, prints = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((sizes, np.int32), (prints, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(signed(prints))], names=["n", "print"])

    return run


def _item_windows(span: int):
    """Every window of each item."""

    def run(batches):
        for batch in batches:
            at, sizes, one, two = [], [], [], []
            for k, words in enumerate(texts_words(batch.column(1), (BYTE_CODE, OTHER_CODE))):
                if len(words[0]):
                    n = min(len(words[0]), span)
                    hashes = window_hashes(words, n)
                    at.append(np.full(len(hashes[0]), k)), sizes.append(np.full(len(hashes[0]), n, np.int32)), one.append(hashes[0]), two.append(hashes[1])
            at, sizes, one, two = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((at, np.int64), (sizes, np.int32), (one, np.uint64), (two, np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(sizes), pa.array(signed(one)), pa.array(signed(two))], names=["item", "n", "one", "two"])

    return run


def around_hits(words: np.ndarray, span: int, short: list[int], hits: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(n, starts) of the windows of n words that hold a fingerprint of `hits`."""
    out = []
    for n, (places, prints) in zip([span, *short], prints_of(words, span, short)):
        places = places[np.isin(prints, hits)]
        if n == span:
            places = np.unique((places[:, None] - np.arange(span - K + 1)).ravel())
            places = places[(places >= 0) & (places <= len(words) - span)]
        out.append((n, places))
    return out


def _extend(span: int, short: list[int]):
    """Texts with the fingerprints that they share with items -> the windows around these."""

    def run(batches):
        for batch in batches:
            at, starts, sizes, one, two = [], [], [], [], []
            for k, (hits, words) in enumerate(zip(batch.column(3).to_pylist(), texts_words(batch.column(2), (BYTE_CODE, OTHER_CODE)))):
                for n, places in around_hits(words[0], span, short, np.array(hits, np.int64).view(np.uint64)):
                    if len(places):
                        hashes = window_hashes(words, n)
                        at.append(np.full(len(places), k)), starts.append(places), sizes.append(np.full(len(places), n)), one.append(hashes[0][places]), two.append(hashes[1][places])
            at, starts, sizes, one, two = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((at, np.int64), (starts, np.int64), (sizes, np.int64), (one, np.uint64), (two, np.uint64)))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(starts), pa.array(sizes.astype(np.int32)), pa.array(signed(one)), pa.array(signed(two))], names=["doc", "row", "start", "n", "one", "two"])

    return run


def _count_words(batches):
    for batch in batches:
        counts = [len(words) for (words,) in texts_words(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc", "row", "n_words"])


def _shared(rows: DataFrame, benchmark: DataFrame, span: int, item_col: str) -> DataFrame:
    """doc, row, spans (word ranges, end exclusive, in order), n_hit, items (sorted) of the documents with some shared span."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item IS NOT NULL").distinct()
    prints = materialize(items.mapInArrow(_item_prints(span), "n int, print long").distinct(), "item-prints")
    windows = materialize(items.mapInArrow(_item_windows(span), "item string, n int, one long, two long").distinct(), "item-windows")
    short = sorted(r[0] for r in prints.select("n").where(F.col("n") < span).distinct().collect())  # span - 1 values at most
    # hits of fingerprints, by document; then the windows around them, of those documents only
    seeds = rows.mapInArrow(_document_prints(span, short), "doc long, row long, print long").join(prints.select("print").distinct(), "print", "left_semi")
    seeds = materialize(seeds.groupBy("doc", "row").agg(F.collect_set("print").alias("prints")), "seeds")
    near = rows.join(seeds, ["doc", "row"]).select("doc", "row", "text", "prints")
    near = near.mapInArrow(_extend(span, short), "doc long, row long, start long, n int, one long, two long")
    key = ["n", "one", "two"]
    near = materialize(near.join(windows.select(key).distinct(), key, "left_semi").distinct(), "shared-windows")
    found = near.join(windows, key).select("doc", "row", "item").distinct().groupBy("doc", "row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    # runs of overlapping windows
    order = Window.partitionBy("doc", "row").orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = near.select("doc", "row", "start", (F.col("start") + F.col("n")).alias("end"), "n", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int").alias("new"))
    runs = runs.withColumn("run", F.sum("new").over(order)).groupBy("doc", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    out = materialize(runs.join(found, ["doc", "row"]), "shared-spans")
    for x in (prints, windows, seeds, near):
        discard(x)
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, spans, items, items_sha256, contaminated: one row for each row of docs."""
    rows = rows_of(docs, id_col, text_col)
    out = rows.mapInArrow(_count_words, "doc long, row long, n_words long").join(_shared(rows, benchmark, span, item_col), ["doc", "row"], "left")
    hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return out.select(key_to_id("doc").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), spans.alias("spans"), items.alias("items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs."""
    repeat = ids_repeat(docs, id_col)
    dirty = _shared(rows_of(docs, id_col, text_col, repeat), benchmark, span, "item_id")
    return drop_rows(docs, dirty.select("doc", "row"), id_col, text_col, repeat)
