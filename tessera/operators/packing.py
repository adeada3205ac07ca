"""Queues cut into batches in order, each as long as two caps allow (next fit), by many tasks.

All queues stand one after the other in one global order, cut into chunks of consecutive rows. Where a batch that begins at some row would end follows from
the sizes of the next `most` rows, so every chunk, with these rows of the chunk after it, can tell for each row where a batch from there would
hand on to the next chunk. Pointer doubling over the chunks then finds the row at which each is really entered, and every chunk walks from
there. A queue may be as long as it likes: its rows are spread over chunks, and what is joined has at most `most` rows a chunk."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources import scratch

CHUNK = 1 << 16


def global_places(items: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place (from 0) in the order of all: ranges are sorted apart, their counts (one a range) shift them."""
    ranged = scratch.stored(items.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    shifts = items.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "__part int, __before long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + F.col("__before")
    return ranged.join(F.broadcast(shifts), "__part").withColumn(name, place).drop("__part", "__before")


def next_starts(keys: np.ndarray, sizes: np.ndarray, most: int, most_size: int) -> np.ndarray:
    """For each row the row after the batch that begins with it. keys: a number for each queue, equal along it."""
    running = np.append(0, np.cumsum(sizes))
    fit = np.searchsorted(running, running[:-1] + most_size, "right") - 1
    at = np.arange(len(sizes))
    changes = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
    return np.minimum(np.minimum(np.maximum(fit, at + 1), at + most), changes[np.searchsorted(changes, at, "right")])


def _own(pdf: pd.DataFrame, first: int, chunk: int, key: str, size: str, most: int, most_size: int) -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pdf.sort_values("__place")
    codes = pd.factorize(pdf[key], use_na_sentinel=False)[0]
    return pdf, next_starts(codes, pdf[size].to_numpy(np.int64), most, most_size)[: int((pdf["__place"] < first + chunk).sum())]


def _exits(chunk: int, key: str, size: str, most: int, most_size: int):
    """Rows at which a chunk can be entered, and where the next chunk is entered then."""

    def run(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(at[0]) * chunk
        _, hops = _own(pdf, first, chunk, key, size, most, most_size)
        inside = np.flatnonzero(hops < len(hops))
        while len(inside):
            hops[inside] = hops[hops[inside]]
            inside = inside[hops[inside] < len(hops)]
        entries = hops[: most if first else 1]
        return pd.DataFrame({"entry": first + np.arange(len(entries)), "exit": first + entries})

    return run


def _walk(chunk: int, key: str, size: str, most: int, most_size: int, columns: list[str]):
    """A chunk's own rows with `__new`: a batch begins here."""

    def run(at: tuple, pdf: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        first = int(at[0]) * chunk
        pdf, hops = _own(pdf, first, chunk, key, size, most, most_size)
        new = np.zeros(len(hops), np.int64)
        here = int(entered["entry"].min()) - first if len(entered) else len(hops)  # the end of all rows may be in the last chunk too
        while here < len(hops):
            new[here] = 1
            here = int(hops[here])
        own = pdf.iloc[: len(hops)]
        return own[columns].assign(__chunk=at[0], __batch=np.cumsum(new))

    return run


def pack(items: DataFrame, key: str, order: list[str], size: str, most: int, most_size: int, chunk: int = CHUNK) -> DataFrame:
    """Adds `batch` (from 0 in each queue): the queue of each key in order, cut where the next row would exceed a cap. Sizes are whole and not
    negative; a row above most_size is a batch of its own. A null key is a queue."""
    chunk = max(chunk, most)
    placed = scratch.stored(global_places(items, [key, *order], "__place"), "placed")
    own = F.floor(F.col("__place") / chunk)
    ahead = F.when((own > 0) & (F.col("__place") % chunk < most), F.array(own, own - 1)).otherwise(F.array(own))
    seen = placed.withColumn("__chunk", F.explode(ahead))
    settings = (chunk, key, size, most, most_size)
    step = scratch.stored(seen.select("__chunk", "__place", key, size).groupBy("__chunk").applyInPandas(_exits(*settings), "entry long, exit long"), "exits")
    chunks = -(-placed.count() // chunk)
    # steps of 1, 2, 4, ... chunks; then all chunks that are reached from the first
    steps = [step]
    for _ in range(max(0, math.ceil(math.log2(max(chunks, 1))))):
        last = steps[-1]
        steps.append(scratch.stored(last.select("entry", F.col("exit").alias("__mid")).join(last.select(F.col("entry").alias("__mid"), "exit"), "__mid").select("entry", "exit"), "steps"))
    entered = items.sparkSession.range(1).select(F.col("id").alias("entry"))
    for far in reversed(steps):
        entered = scratch.stored(entered.union(entered.join(far, "entry").select(F.col("exit").alias("entry"))).distinct(), "entered")
    entered = entered.withColumn("__chunk", F.floor(F.col("entry") / chunk))
    schema = placed.withColumns({"__chunk": F.lit(0).cast("long"), "__batch": F.lit(0).cast("long")}).schema
    walked = scratch.stored(seen.groupBy("__chunk").cogroup(entered.groupBy("__chunk")).applyInPandas(_walk(*settings, placed.columns), schema), "walked")
    # batches are numbered along all chunks (one row each), then from each queue's first; rows meet what is known of their chunk and queue, so that a
    # long queue stays spread over its chunks
    known = scratch.stored(walked.groupBy("__chunk", F.col(key).alias("__key")).agg(F.min("__batch").alias("__least"), F.max("__batch").alias("__most")), "queues")
    sums = known.groupBy("__chunk").agg(F.max("__most").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = known.join(sums.select("__chunk", before.alias("__before")), "__chunk")
    firsts = known.groupBy(F.col("__key").alias("__queue")).agg(F.min(F.col("__least") + F.col("__before")).alias("__first"))
    shifts = known.join(firsts, F.col("__key").eqNullSafe(F.col("__queue"))).select(F.col("__chunk").alias("__in"), "__key", (F.col("__before") - F.col("__first")).alias("__shift"))
    out = walked.join(shifts, (F.col("__chunk") == F.col("__in")) & F.col(key).eqNullSafe(F.col("__key")))
    return out.select(*items.columns, (F.col("__batch") + F.col("__shift")).alias("batch"))
