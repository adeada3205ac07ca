"""Removal of repeated passages by prefix-free parsing.

A rolling hash over the bytes sets triggers: of each passage (LENGTH consecutive bytes) the place whose k bytes have the least hash.
Consecutive passages with the same trigger form a phrase, so that every passage lies in one phrase, and where it lies
depends on its own bytes only: equal passages have equal triggers at equal places. Phrases make up the dictionary
(each distinct one once) and their occurrences, ordered by document and place, the parse.

A phrase that repeats as a whole is removed but for its first occurrence. Only distinct phrases that share a trigger can
still share a part; of these the suffixes are compared to the depth of a passage. Depth is bounded, so suffixes are ordered
by a 128-bit hash of their first LENGTH bytes rather than letter by letter: equal prefixes meet as in a suffix array, and
the sort is an ordinary shuffle by key. Before that, suffixes go in blocks of neighbours (by their distance from the
trigger): a block whose common core no other phrase has is done with. Every task first keeps one occurrence of each phrase it sees, so
that a passage which a third of all documents hold reaches the shuffle once a task.

Results in odd cases: a null or empty text has no bytes; texts shorter than a passage stay whole; passages at the same place of
rows that share a doc_id are not earlier than each other, so repeated rows stay alike; a null doc_id counts as smaller than
all others; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_CODE, OTHER_CODE, blocks, byte_offsets, discard, key_to_id, materialize, mix64, prefix_hash, rows_of, signed, span_hash

LENGTH, GRAM = 100, 32
PLACE_BITS = 24
#: Bytes of one text that are parsed at once; the pieces overlap by a passage.
PIECE = 1 << 22
U = np.uint64
RUNS = "trig long, run long, doc long, row long, start long, n int, lead int"
FOUND = "doc long, row long, start long, n int, lead int, whole boolean"
#: Neighbouring suffixes that are first compared as one.
BLOCK = 8


def phrases(buf: np.ndarray, at: np.ndarray, length: int, gram: int):
    """(document, start, number of passages, distance of the trigger, its hash, hash of the bytes) of every phrase; starts count in buf."""
    width = length - gram + 1
    count = len(buf) - length + 1
    if count <= 0:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)] * 2
    sums = prefix_hash(BYTE_CODE[buf])
    places = np.arange(len(buf) - gram + 1)
    grams = span_hash(sums, places, places + gram)
    least = (grams & U(2**64 - 2**PLACE_BITS)) | places.astype(U)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    trigger = (least[:count] & U(2**PLACE_BITS - 1)).astype(np.int64)
    valid = np.zeros(count + 1, np.int64)
    first, last = at[:-1], np.maximum(at[:-1], at[1:] - length + 1)
    np.add.at(valid, np.minimum(first, count), 1)
    np.subtract.at(valid, np.minimum(last, count), 1)
    valid = np.cumsum(valid[:-1]) > 0
    change = valid.copy()
    change[1:] &= (trigger[1:] != trigger[:-1]) | ~valid[:-1]
    change[first[(last > first) & (first < count)]] = True
    starts = np.flatnonzero(change)
    stop = np.zeros(count, bool)
    stop[:-1] = valid[:-1] & (change[1:] | ~valid[1:])
    stop[-1] = valid[-1]
    ends = np.flatnonzero(stop) + 1
    doc = np.searchsorted(at, starts, "right") - 1
    return doc, starts, ends - starts, trigger[starts] - starts, grams[trigger[starts]], span_hash(sums, starts, ends - 1 + length)


def pieces(buf: np.ndarray, at: np.ndarray, length: int):
    """Ranges of documents with their bytes, and the shift of places in a text that is taken in pieces."""
    for first, last in blocks(buf, at):
        if at[last] - at[first] <= PIECE + length:
            yield first, last, buf[at[first] : at[last]], at[first : last + 1] - at[first], 0
            continue
        for shift in range(0, int(at[last] - at[first]) - length + 1, PIECE):
            part = buf[at[first] + shift : min(at[last], at[first] + shift + PIECE + length - 1)]
            yield first, last, part, np.array([0, len(part)]), shift


def _told_once(ids, rows, doc, start, n, lead, trig, run) -> pa.RecordBatch:
    """Rows of RUNS. Those that an earlier place of the batch holds already get n < 0 and a key of their own."""
    order = np.lexsort((start, ids[doc], run, trig))
    doc, start, n, lead, trig, run = (x[order] for x in (doc, start, n, lead, trig, run))
    new = np.append(True, (run[1:] != run[:-1]) | (trig[1:] != trig[:-1]))[: len(run)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0)) if len(run) else np.zeros(0, np.int64)
    later = ~new & ((ids[doc] != ids[doc[head]]) | (start != start[head]))
    trig = np.where(later, mix64(trig ^ mix64(start.astype(U) + run)), trig)
    cols = signed(trig), signed(run), ids[doc], rows[doc], start.astype(np.int64), np.where(later, -n, n).astype(np.int32), lead.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["trig", "run", "doc", "row", "start", "n", "lead"])


def _parse(length: int, gram: int):
    """Phrases of a batch."""

    def run(batches):
        for batch in batches:
            buf, at = byte_offsets(batch.column(2))
            ids, rows = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            parts = []
            for first, _, data, own, shift in pieces(buf, at, length):
                doc, start, n, lead, trig, run = phrases(data, own, length, gram)
                parts.append((doc + first, start - own[doc] + shift, n, lead, trig, run))
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, U if k > 3 else np.int64) for k in range(6)]
            yield _told_once(ids, rows, *cols)

    return run


def _find(batches):
    """Phrases sorted by trigger, phrase, document, start -> repeats of a phrase (whole), and first occurrences of distinct phrases
    that share a trigger (not whole). One row is carried from batch to batch."""
    carry, told = None, False  # the first row of the last phrase; whether phrases of its trigger are told already
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        out = []
        known = cols[5] < 0
        out.append([c[known] for c in cols[2:5]] + [-cols[5][known], cols[6][known], np.ones(int(known.sum()), bool)])
        cols = [c[~known] for c in cols]
        if carry is not None:
            cols = [np.append(x, c) for x, c in zip(carry, cols)]
        trig, run, doc, row, start, n, lead = cols
        if len(trig):
            new_trig = np.append(True, trig[1:] != trig[:-1])
            new_run = new_trig | np.append(True, run[1:] != run[:-1])
            head = np.maximum.accumulate(np.where(new_run, np.arange(len(run)), 0))
            later = ~new_run & ((doc != doc[head]) | (start != start[head]))
            out.append([doc[later], row[later], start[later], n[later], lead[later], np.ones(int(later.sum()), bool)])
            group = np.cumsum(new_trig) - 1
            distinct = np.bincount(group, weights=new_run)
            if told and carry is not None:
                distinct[0] += 1
            share = new_run & (distinct[group] > 1)
            if told and carry is not None:
                share[0] = False
            out.append([doc[share], row[share], start[share], n[share], lead[share], np.zeros(int(share.sum()), bool)])
            told = bool(distinct[group[-1]] > 1)
            carry = [c[head[-1] : head[-1] + 1] for c in cols]
        doc, row, start, n, lead, whole = (np.concatenate([o[k] for o in out]) for k in range(6))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array(start), pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(whole.astype(bool))], names=["doc", "row", "start", "n", "lead", "whole"])


def _suffixes(length: int, block: int):
    """Texts with the spans of some phrases -> the suffixes there, `block` neighbours at a time: key of the core that they have
    in common (at its distance from the trigger), and hash of the bytes of all."""

    def run(batches):
        for batch in batches:
            buf, at = byte_offsets(batch.column(2))
            ids, rows, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
            spans = lists.flatten()
            all_start, all_n, all_lead = (np.asarray(spans.field(x)).astype(np.int64) for x in range(3))
            parts = []
            for first, last in blocks(buf, at):
                part = slice(offsets[first], offsets[last])
                start, n, lead = all_start[part], all_n[part], all_lead[part]
                doc = np.repeat(np.arange(first, last), np.diff(offsets[first : last + 1]))
                base = at[doc] - at[first] + start  # of the span, in the bytes of this part
                span = np.repeat(np.arange(len(n)), n)
                i = np.arange(len(span)) - (np.cumsum(n) - n)[span]
                group = (lead[span] - i) // block
                new = np.append(True, (span[1:] != span[:-1]) | (group[1:] != group[:-1]))[: len(span)]
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(span))[: len(begin)]
                span, i, group, count = span[begin], i[begin], group[begin], end - begin
                core = base[span] + lead[span] - block * group
                data = buf[at[first] : at[last]]
                one, two = prefix_hash(BYTE_CODE[data]), prefix_hash(OTHER_CODE[data])
                trig = mix64(span_hash(one, core, core - (block - 1) + length) + group.astype(U))
                whole = span_hash(two, base[span] + i, base[span] + i + count - 1 + length)
                parts.append((doc[span], start[span] + i, count, lead[span] - i, trig, whole))
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, U if k > 3 else np.int64) for k in range(6)]
            yield _told_once(ids, rows, *cols)

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            buf, at = byte_offsets(batch.column(1))
            out = []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                own = buf[at[k] : at[k + 1]]
                edge = np.zeros(len(own) + 1, np.int64)
                for span in spans or ():
                    edge[span["start"]] += 1
                    edge[min(len(own), span["start"] + span["n"] - 1 + length)] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                kept = own[~gone].tobytes() if spans else own.tobytes()
                n_spans = int(np.count_nonzero(gone & ~np.append(False, gone[:-1])))
                out.append((len(own), len(own) - len(kept), n_spans, kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256: one row for each row of docs."""
    rows = rows_of(docs, id_col, text_col)
    spread = lambda df: df.repartition(F.col("trig")).sortWithinPartitions("trig", "run", "doc", "start")
    found = materialize(spread(rows.mapInArrow(_parse(length, gram), RUNS)).mapInArrow(_find, FOUND), "phrases")
    gone = found.where("whole").select("doc", "row", "start", "n")
    tables = [found]
    for block in (BLOCK, 1):
        parts = found.where("NOT whole").groupBy("doc", "row").agg(F.collect_set(F.struct("start", "n", "lead")).alias("spans"))
        texts = rows.join(parts, ["doc", "row"]).select("doc", "row", "text", "spans")
        found = materialize(spread(texts.mapInArrow(_suffixes(length, block), RUNS)).mapInArrow(_find, FOUND), f"suffixes-{block}")
        gone = gone.union(found.where("whole").select("doc", "row", "start", "n"))
        tables.append(found)
    gone = materialize(gone.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "repeats")
    for x in tables:
        discard(x)
    out = rows.join(gone, ["doc", "row"], "left").select("doc", "text", "spans").mapInArrow(_cut(length), "doc long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.select(key_to_id("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
