"""Ranked lexical search by Block-Max WAND.

1. Tasks cut their documents into shards of up to SHARD_DOCS documents or SHARD_BYTES of text. A shard's index has one row a term: its postings
   in blocks of BLOCK documents, each block compressed by itself (gaps and counts as variable-length bytes), beside them each block's
   last document and its competitive pairs (occurrences, length), from which the greatest impact follows for any corpus statistics. Postings never
   leave their shard, so the index can be extended by further shards.
2. The number of documents, their terms and each query term's documents are added up over the shards' rows; only the lists of terms that are
   asked for travel to their shard's search.
3. Within a shard the bounds of the item's blocks cut the documents into intervals. The pointers of all lists are moved to an interval by
   the blocks' last documents alone, and the sum of the blocks' greatest impacts bounds what a document there can score. Intervals below
   the threshold, and with them the blocks that only they need, are never decompressed; the others are scored in waves, best bounds
   first, and each wave lifts the threshold.
4. A sixteenth of the shards is searched first; the k-th scores found there are the thresholds at which the others begin.

Scores are whole numbers of 64 bits. Results in odd cases: null or empty texts have no terms and are no documents; each row with terms is a
document, rows that share a doc_id too; a null doc_id is smaller than all others; items that share an item_id (or have none) are
one item; items without terms, and items that meet no document with a score above 0, get no rows; other columns are ignored."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, doc_key, key_to_id, materialize

SHARD_DOCS, SHARD_BYTES, BLOCK = 1 << 13, 1 << 23, 128
#: Items that are searched together; intervals of the first wave; one shard in FIRST is searched first.
ITEMS, WAVE, FIRST = 256, 16, 16
#: Up to so many (item, term) pairs (about 8 MB) are sent to all tasks, which then keep only the lists asked for; more of them are joined by term.
SENT = 1 << 17
#: Fixed values of the score.
SCALE, COUNT_SCALE, LENGTH_SCALE, FLAT, SLOPE = 1_000_000_000, 1000, 8, 10, 90
PIECE = 1 << 20
TERM, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
LOW = LOWER.tobytes()
#: term null: the shard's documents; data holds their ids and numbers of terms, n_docs and n_terms count them.
INDEX = "shard long, term string, n_docs int, n_terms long, lasts array<int>, starts array<int>, pairs array<int>, counts array<int>, lengths array<long>, data binary"


def terms_of(text: bytes):
    """Lists of the terms of a text, piece by piece."""
    text, at = text.translate(LOW), 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield TERM.findall(text, at, end)
        at = end


# -- blocks ------------------------------------------------------------------------------------------------------------


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of 7 bits each, the highest bit set on all but a number's last byte; and where each number starts (one more: the end)."""
    values = values.astype(np.int64)
    width = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(width.max(initial=0))):
        has = width > k
        more = (width[has] > k + 1).astype(np.int64) << 7
        out[at[:-1][has] + k] = (values[has] >> 7 * k) & 127 | more
    return out, at


def decode(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.zeros(len(last), np.int64)
    first[1:] = last[:-1] + 1
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first) if len(last) else first


def competitive(block: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the postings of each block that no other of the block beats in both occurrences and shortness; blocks ascend."""
    order = np.lexsort((lengths, -counts, block))
    far = int(lengths.max(initial=0)) + 1
    low = lengths[order] - block[order].astype(np.int64) * far
    before = np.minimum.accumulate(low)
    keep = np.ones(len(order), bool)
    keep[1:] = low[1:] < before[:-1]
    return order[keep]


class Shard:
    """Documents that a task has read, until they are enough for a shard."""

    def __init__(self):
        self.vocabulary: defaultdict = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.docs: list = []
        self.words: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, doc: int, text: bytes) -> None:
        own = [np.fromiter(map(self.vocabulary.__getitem__, terms), np.int32, len(terms)) for terms in terms_of(text)]
        n = sum(map(len, own))
        if n:
            self.docs.append(doc), self.words.extend(own), self.lengths.append(n)
            self.size += len(text)

    def full(self) -> bool:
        return len(self.docs) >= SHARD_DOCS or self.size >= SHARD_BYTES

    def rows(self, number: int) -> pa.RecordBatch:
        n, lengths = len(self.docs), np.array(self.lengths, np.int64)
        keys = np.concatenate(self.words).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        keys, counts = np.unique(keys, return_counts=True)
        term, doc = keys // n, keys % n
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        sizes = np.diff(begins, append=len(term))
        place = np.arange(len(term)) - np.repeat(begins, sizes)
        heads = np.flatnonzero(place % BLOCK == 0)
        block = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(term)))
        gaps = np.diff(doc, prepend=0)
        gaps[heads] = doc[heads]
        data, at = encode(np.stack([gaps, counts], axis=1).ravel())
        pairs = competitive(block, counts, lengths[doc])
        blocks = -(-sizes // BLOCK)
        block_at, byte_at = np.append(0, np.cumsum(blocks)), at[2 * np.append(begins, len(term))]
        pair_sizes = np.bincount(block[pairs], minlength=len(heads))
        pair_at = np.append(0, np.cumsum(pair_sizes))[block_at]
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(np.append(offsets, offsets[-1]), pa.int32()), values)
        columns = {
            "shard": pa.array(np.full(len(begins) + 1, number)),
            "term": pa.concat_arrays([pa.array(list(self.vocabulary), pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())]),
            "n_docs": pa.array(np.append(sizes, n), pa.int32()),
            "n_terms": pa.array(np.append(np.add.reduceat(counts, begins), lengths.sum()), pa.int64()),
            "lasts": lists(block_at, pa.array(doc[np.append(heads[1:], len(term)) - 1], pa.int32())),
            "starts": lists(block_at, pa.array(at[2 * heads] - np.repeat(byte_at[:-1], blocks), pa.int32())),
            "pairs": lists(block_at, pa.array(pair_sizes, pa.int32())),
            "counts": lists(pair_at, pa.array(counts[pairs], pa.int32())),
            "lengths": lists(pair_at, pa.array(lengths[doc[pairs]], pa.int64())),
            "data": pa.Array.from_buffers(pa.binary(), len(begins) + 1, [None, pa.py_buffer(np.append(byte_at, len(data) + 16 * n).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes() + np.array(self.docs, np.int64).tobytes() + lengths.tobytes())]),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _index(batches):
    shard, made = Shard(), 0
    first = TaskContext.get().partitionId() << 32
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            shard.add(doc, text.as_py())
            if shard.full():
                yield shard.rows(first + made)
                shard, made = Shard(), made + 1
    if shard.docs:
        yield shard.rows(first + made)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored shards (INDEX) of docs."""
    rows = docs.select(doc_key(id_col).alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(_index, INDEX), "postings")


# -- search ------------------------------------------------------------------------------------------------------------


def impact(counts: np.ndarray, damp: np.ndarray) -> np.ndarray:
    return SCALE * counts // (COUNT_SCALE * counts + LENGTH_SCALE * damp)


def damping(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length weighs: 10 for the shortest, 100 for the mean."""
    if SLOPE * int(lengths.max(initial=0)) * n_docs < 2**63:
        return FLAT + SLOPE * lengths * n_docs // n_terms
    return np.array([FLAT + SLOPE * int(x) * n_docs // n_terms for x in lengths], np.int64)


class Postings:
    """A term's list in one shard: bounds and greatest scores of its blocks; documents and scores of the blocks decompressed so far."""

    def __init__(self, row, weight: int, damp: np.ndarray, damp_of):
        self.lasts, self.weight, self.damp = np.asarray(row.lasts, np.int64), weight, damp
        at = np.append(0, np.cumsum(row.pairs)[:-1]).astype(np.int64)
        best = impact(np.asarray(row.counts, np.int64), damp_of(np.asarray(row.lengths, np.int64)))
        self.most = weight * np.maximum.reduceat(best, at)
        self.data, self.starts = np.frombuffer(row.data, np.uint8), np.append(row.starts, len(row.data)).astype(np.int64)
        self.known = np.zeros(len(self.lasts), bool)
        self.block = np.arange(row.n_docs) // BLOCK
        self.docs, self.scores = np.zeros(row.n_docs, np.int64), np.zeros(row.n_docs, np.int64)

    def read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the blocks in a mask."""
        new = np.flatnonzero(blocks & ~self.known)
        if len(new):
            both = decode(np.concatenate([self.data[self.starts[b] : self.starts[b + 1]] for b in new])).reshape(-1, 2)
            sizes = np.minimum(BLOCK, len(self.docs) - new * BLOCK)
            docs = np.cumsum(both[:, 0])
            ends = np.cumsum(sizes)
            docs -= np.repeat(np.append(0, docs[ends[:-1] - 1]), sizes)
            at = np.repeat(new * BLOCK, sizes) + np.arange(len(docs)) - np.repeat(ends - sizes, sizes)
            self.docs[at], self.scores[at] = docs, self.weight * impact(both[:, 1], self.damp[docs])
            self.known[new] = True
        take = blocks[self.block]
        return self.docs[take], self.scores[take]


def top_documents(lists: list[Postings], ids: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best documents of one shard, equal scores by id; those that can't reach the floor may be missing."""
    n = len(ids)
    begins = np.unique(np.concatenate([[0], *(x.lasts + 1 for x in lists)]))
    begins = begins[begins < n]
    ends = np.append(begins[1:], n)
    at = [np.searchsorted(x.lasts, begins) for x in lists]
    bound = np.zeros(len(begins), np.int64)
    for x, b in zip(lists, at):
        bound += np.append(x.most, 0)[b]
    order = np.argsort(-bound, kind="stable")
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    done, wave, floor = 0, WAVE, max(floor, 1)
    while done < len(order) and bound[order[done]] >= floor:
        now = order[done : done + wave]
        now = now[bound[now] >= floor]
        done, wave = done + wave, 2 * wave
        inside = np.zeros(n + 1, np.int64)
        inside[begins[now]] += 1
        np.subtract.at(inside, ends[now], 1)
        inside = np.cumsum(inside[:-1]) > 0
        scores = np.zeros(n, np.int64)
        for x, b in zip(lists, at):
            blocks = np.zeros(len(x.lasts) + 1, bool)
            blocks[b[now]] = True
            docs, own = x.read(blocks[:-1])
            keep = inside[docs]
            scores[docs[keep]] += own[keep]
        found = np.flatnonzero(scores >= floor)
        both = np.concatenate([best[0], ids[found]]), np.concatenate([best[1], scores[found]])
        order_of = np.lexsort((both[0], -both[1]))[:k]
        best = both[0][order_of], both[1][order_of]
        if len(best[1]) == k:
            floor = max(floor, int(best[1][-1]))
    return best


def _search(n_docs: int, n_terms: int, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists: dict[int, list[Postings]] = defaultdict(list)
        floors: dict[int, int] = {}
        own = np.frombuffer(pdf.loc[pdf["term"].isna(), "data"].iloc[0], np.int64).reshape(2, -1)
        damp = damping(own[1], n_docs, n_terms)
        for row in pdf[pdf["term"].notna()].itertuples():
            postings = Postings(row, row.weight, damp, lambda x: damping(x, n_docs, n_terms))
            for item in row.wanted:
                lists[item["no"]].append(postings)
                floors[item["no"]] = item["floor"]
        out = []
        for no, own_lists in lists.items():
            docs, scores = top_documents(own_lists, own[0], k, floors[no])
            out.append((np.full(len(docs), no), docs, scores))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(["no", "doc", "score"], columns)))

    return run


def _item_terms(batches):
    for batch in batches:
        found = [{t for terms in terms_of(text) for t in terms} for text in batch.column(1).cast(pa.large_binary()).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([t for x in found for t in x], pa.binary()).cast(pa.string())], names=["no", "term"])


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def rank_documents(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of a stored index for each item."""
    said = items.select(F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    numbered = materialize(said.select("item").distinct().withColumn("no", F.monotonically_increasing_id()), "items")
    texts = numbered.alias("n").join(said.alias("s"), F.expr("n.item <=> s.item")).select("no", "text")
    asked = materialize(texts.mapInArrow(_item_terms, "no long, term string").distinct(), "item-terms")
    # the corpus in numbers, and each asked term's documents
    send = F.broadcast if asked.count() <= SENT else lambda df: df
    corpus = index.where("term IS NULL").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n, length, parts = int(corpus["n"] or 0), int(corpus["l"] or 1), max(1, -(-numbered.count() // ITEMS))
    known = index.where("term IS NOT NULL").join(send(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weights = materialize(known.select("term", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight")), "weights")
    asked = asked.join(weights, "term").withColumn("part", F.pmod(F.xxhash64("no"), F.lit(parts)))
    documents = index.where("term IS NULL").withColumns({"weight": F.lit(0).cast("long"), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))), "wanted": F.lit(None).cast("array<struct<no:bigint,floor:bigint>>")})

    def searched(which, floors: DataFrame | None) -> DataFrame:
        own = asked.join(floors, "no", "left") if floors is not None else asked.withColumn("floor", F.lit(0).cast("long"))
        own = own.groupBy("part", "term", "weight").agg(F.collect_list(F.struct("no", F.coalesce("floor", F.lit(0).cast("long")).alias("floor"))).alias("wanted"))
        lists = index.where("term IS NOT NULL").where(which).join(send(own), "term").unionByName(documents.where(which))
        return lists.groupBy("shard", "part").applyInPandas(_search(n, length, k), "no long, doc long, score long")

    early = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    first = materialize(_top(searched(early, None), k), "first-found")
    rest = searched(~early, first.where(F.col("rank") == k).select("no", F.col("score").alias("floor")))
    found = _top(first.select("no", "doc", "score").union(rest), k)
    return found.join(numbered, "no").select(F.col("item").alias("item_id"), "rank", key_to_id("doc").alias("doc_id"), "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), corpus AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
postings AS (SELECT i, term, count(*) AS tf FROM (SELECT i, unnest(t) AS term FROM d) GROUP BY i, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, corpus WHERE term IN (SELECT term FROM b) GROUP BY term
), scores AS (
  SELECT b.item_id, d.i, any_value(d.doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.t) * corpus.n) // corpus.l)))) AS score
  FROM b JOIN weights USING (term) JOIN postings USING (term) JOIN d USING (i), corpus GROUP BY b.item_id, d.i
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
"""
