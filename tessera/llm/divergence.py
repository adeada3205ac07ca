"""Source divergence audit by systolic rotation.

1. Tasks count terms by (lang, source) and the documents of each term; a Spark aggregation adds these up. A lang keeps the terms of at
   least MIN_DOCS of its documents. A group's share of a term is p = 1 + floor(10**9 * (count + 1) / (N + V)).
2. The kept terms of a lang are dealt to slices of about SLICE_ROWS counts. Within a slice a group's shares are one compressed row
   (terms by number, delta-coded); terms that stand out against the whole lang are ranked by a local heap of each slice and group.
3. The groups of a lang form BLOCKS blocks on a ring. The rows of a (lang, slice, block) stay in their partition, cached on disk and
   rebuilt from the stored table if an executor is lost. In round r every block is host to the block r places on, which travels
   compressed, so that after BLOCKS / 2 rounds each two groups have met once; a meeting evaluates both directions. A pair's values are
   added up over slices.

All sums are whole numbers of 64 bits; shares are computed in decimals. Results in odd cases: null text, lang and source are ''; a group
without terms has N = 0; a lang that keeps no terms has value 0 for its pairs; a lang of one source has no pairs; each row is a document,
repeated rows too; doc_id and other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, discard, materialize

MIN_DOCS, TOP_TERMS = 3, 200
SLICE_ROWS, BLOCKS = 1 << 17, 8
#: Distinct (group, term) that a task holds before it passes its counts on; bytes of a text that it splits into terms at once.
HELD, PIECE = 1 << 18, 1 << 20
WORD, GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
LOW = LOWER.tobytes()


def terms_of(text: bytes):
    """Lists of the terms of a text, piece by piece."""
    text, at = text.translate(LOW), 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield WORD.findall(text, at, end)
        at = end


def _count(batches):
    """lang, source, term, occurrences, documents: as far as the task holds them together."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def told():
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (times, docs) in held.items():
            for column, values in zip(columns, ([lang] * len(times), [source] * len(times), times.keys(), times.values(), (docs[t] for t in times))):
                column.extend(values)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in columns[:2]), pa.array(columns[2], pa.binary()).cast(pa.string()), *(pa.array(x, pa.int64()) for x in columns[3:])], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist()):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(times)
            seen: set = set()
            for terms in terms_of(text):
                times.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(times)
            if size > HELD:
                yield told()
                held, size = {}, 0
    yield told()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents)."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), name(text_col).alias("text"))
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count, total):
    """1 + floor(10**9 * (count + 1) / total), whatever the size of the count."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(19, 0))) div CAST({total} AS DECIMAL(19, 0))")


def pack(numbers: np.ndarray, shares: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([np.diff(numbers, prepend=0), shares]).astype("<i4").tobytes(), 1)


def unpack(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if data is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(zlib.decompress(data), "<i4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


SLICES = "lang string, slice int, source string, size int, shares binary, top array<struct<term:string,value:long>>"


def _slice(top: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number, terms = pd.factorize(pdf["term"], sort=True)
        terms = terms.to_numpy(object)
        out = []
        for source, at in pdf.groupby("source").indices.items():
            at = at[np.argsort(number[at])]
            p, q = pdf["p"].to_numpy(np.int64)[at], pdf["q"].to_numpy(np.int64)[at]
            more = np.flatnonzero(p > q)
            best = heapq.nsmallest(top, zip((-divergence(p[more], q[more])).tolist(), terms[number[at[more]]].tolist()))
            out.append((key[0], key[1], source, len(terms), pack(number[at], p), [{"term": t, "value": -v} for v, t in best]))
        return pd.DataFrame(out, columns=["lang", "slice", "source", "size", "shares", "top"])

    return run


def both_ways(size: int, one: tuple, other: tuple) -> tuple[int, int]:
    """Sums of the divergence over a slice of `size` terms, from one group to the other and back. A group: numbers, shares, share of absent terms."""
    (a, p, p0), (b, q, q0) = one, other
    at = np.minimum(np.searchsorted(b, a), len(b) - 1) if len(b) else np.zeros(len(a), np.int64)
    common = b[at] == a if len(b) else np.zeros(len(a), bool)
    there = np.full(len(a), q0)
    there[common] = q[at[common]]
    alone = np.ones(len(b), bool)
    alone[at[common]] = False
    rest = size - len(a) - int(alone.sum())
    out = []
    for f in (divergence, lambda x, y: divergence(y, x)):
        out.append(int(f(p, there).sum()) + int(f(np.int64(p0), q[alone]).sum()) + rest * int(f(np.int64(p0), np.int64(q0))))
    return out[0], out[1]


def _meet(travels: bool):
    """A block and one that has come to it: every two of their groups. A block and itself: every two groups once."""

    def run(key: tuple, hosts: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        rows = [[(source, size, (*unpack(shares), int(absent))) for source, size, shares, absent in zip(side["source"], side["size"], side["shares"], side["absent"])] for side in (hosts, guests)]
        out = []
        for source, size, one in rows[0]:
            for item, _, other in rows[1]:
                if travels or source < item:
                    there, back = both_ways(size, one, other)
                    out += [(key[0], source, item, there), (key[0], item, source, back)]
        return pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    return run


def _rotate(resident: DataFrame, blocks: int) -> DataFrame:
    """lang, source, item, value (summed) of every two groups of a lang. resident: lang, slice, block, source, size, shares, absent."""
    spark = resident.sparkSession
    keys = ["lang", "slice", "block"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = resident.repartition(tasks, *keys).persist(StorageLevel.DISK_ONLY)
    met = []
    for turn in range(blocks // 2 + 1):
        guests = resident.withColumn("block", F.pmod(F.col("block") - turn, F.lit(blocks)))
        if turn and 2 * turn == blocks:  # half a ring away: each would be host to the other
            guests = guests.where(F.col("block") < turn)
        meeting = held.groupBy(*keys).cogroup(guests.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(_meet(turn > 0), "lang string, source string, item string, value long")
        met.append(materialize(meeting.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), f"round-{turn}"))
    held.unpersist()
    out = met[0]
    for x in met[1:]:
        out = out.union(x)
    return out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, slice_rows: int = SLICE_ROWS, blocks: int = BLOCKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: how far each source's terms are from those of its lang's other sources, and
    the `top` terms in which it stands out."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    groups = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct()
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    within = Window.partitionBy("lang", "term")
    kept = counts.select("lang", "source", "term", "n", F.sum("docs").over(within).alias("docs"), F.sum("n").over(within).alias("total"), F.row_number().over(within.orderBy("source")).alias("k"))
    kept = materialize(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    langs = materialize(kept.groupBy("lang").agg(F.count_if(F.col("k") == 1).alias("v"), F.sum("n").alias("all_n"), F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices")), "langs")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n")), ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left").withColumn("block", F.pmod(place, F.lit(blocks)))
    groups = groups.select("lang", "source", "block", (F.coalesce("own_n", F.lit(0)) + F.coalesce("v", F.lit(1))).alias("own_total"))
    groups = materialize(groups.withColumn("absent", _share("0", "own_total")), "groups")

    rows = kept.join(langs.select("lang", "slices", (F.col("all_n") + F.col("v")).alias("all_total")), "lang").join(groups.select("lang", "source", "own_total"), ["lang", "source"])
    rows = rows.select("lang", F.pmod(F.xxhash64("term"), "slices").cast("int").alias("slice"), "source", "term", _share("n", "own_total").alias("p"), _share("total", "all_total").alias("q"))
    slices = materialize(rows.groupBy("lang", "slice").applyInPandas(_slice(top), SLICES), "slices")
    discard(counts)
    discard(kept)
    # a group is resident in every slice of its lang, whether it has terms there or not
    there = groups.select("lang").distinct().join(slices.groupBy("lang", "slice").agg(F.first("size").alias("size")), "lang", "left")
    there = there.select("lang", F.coalesce("slice", F.lit(0)).alias("slice"), F.coalesce("size", F.lit(0)).alias("size"))
    resident = groups.join(there, "lang").join(slices.select("lang", "slice", "source", "shares"), ["lang", "slice", "source"], "left")
    resident = materialize(resident.select("lang", "slice", "block", "source", "size", "shares", "absent"), "resident")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _rotate(resident, blocks).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = slices.select("lang", "source", F.inline("top")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.union(terms)


def oracle(min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> str:
    """audit() of `documents` in DuckDB SQL."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= {min_docs}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM groups g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT own.lang, own.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (own.n + v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM own JOIN kept ON kept.lang = own.lang JOIN v ON v.lang = own.lang LEFT JOIN c ON c.lang = own.lang AND c.source = own.source AND c.term = kept.term
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((pa.p - pb.p) * (pa.p - pb.p)) // pb.p), 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term
  WHERE pa.term IS NULL OR pb.term IS NOT NULL
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""
