"""Sharding by balanced label propagation.

Documents that share a hub (by default: the same text) are linked. A document's label is its shard. Each round joins
documents with their hub's tally of labels and moves them towards the label that most of their neighbours have, as far as
the shards' quotas leave room; moves beyond a quota are thinned out by a hash. At the end a ranking settles the
shards to their exact quotas: documents without neighbours are moved first, so that few links are cut.

Law "rows": counts differ by one at most. A hub with more documents than a quota fills several shards.
Only counts by shard (at most `shards` numbers) reach the driver.

Results in odd cases: a null text has size 1 and the empty text's checksum and group; a null doc_id is kept; repeated rows
each get a slot of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, doc_key, key_to_id, materialize

HUB_BITS = 8
#: Rows that one task ranks, about; a hub is hot if it has more than this part of a shard's quota.
RANKED, HOT = 100_000, 1 / 64


def by_shard(values: list, default=0) -> Column:
    """The value of the row's shard, from a list with one for each."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("shard") + 1) if values else F.lit(default)


def _counts(df: DataFrame, shards: int, label: str = "shard") -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, shards: int, quotas: list[int], rounds: int, seed: int) -> DataFrame:
    """linked: rows with hub, mark (a hash of the row) and shard. Returns them with their labels after the rounds."""
    total = linked.count()
    for turn in range(rounds if total else 0):
        held = _counts(linked, shards)
        room = [max(0, q - h) for q, h in zip(quotas, held)]
        open_shards = F.array(*[F.lit(r > 0) for r in room])
        tally = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        # majority first; ties by a hash, else every tie would fall to one shard
        rank = F.struct("n", F.xxhash64("hub", "shard", F.lit(seed)).alias("tie"), "shard")
        wish = tally.groupBy("hub").agg(F.max(rank).alias("best"), F.max(F.when(F.element_at(open_shards, F.col("shard") + 1), rank)).alias("free"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held"))
        wish = wish.where(F.size("held") > 1)
        own = F.coalesce(F.element_at("held", F.col("shard")), F.lit(0))
        to = F.when(F.col("shard") == F.col("best.shard"), F.col("shard"))
        to = to.when(F.element_at(open_shards, F.col("best.shard") + 1), F.col("best.shard"))
        to = to.when((F.col("free.n") > own) | ((F.col("free.n") == own) & (F.col("free.shard") < F.col("shard"))), F.col("free.shard"))
        moves = linked.join(wish, "hub", "left").select("hub", "mark", "shard", F.coalesce(to, F.col("shard")).cast("int").alias("to"))
        flow = {(r[0], r[1]): r[2] for r in moves.where("to <> shard").groupBy("shard", "to").count().collect()}
        if not flow:
            break
        come = [sum(v for (_, t), v in flow.items() if t == s) for s in range(shards)]
        go = [sum(v for (f, _), v in flow.items() if f == s) for s in range(shards)]
        accept = [min(1.0, (room[s] + go[s]) / come[s]) if come[s] else 1.0 for s in range(shards)]
        chance = F.pmod(F.xxhash64("hub", F.lit(seed + turn)), F.lit(1 << 20)) / F.lit(1 << 20)
        # a hub that is large beside a quota moves in part
        spread = F.pmod(F.xxhash64("mark", F.lit(seed + turn)), F.lit(1 << 20)) / F.lit(1 << 20)
        limit = F.element_at(F.array(*[F.lit(float(a)) for a in accept]), F.col("to") + 1)
        taken = (F.col("to") != F.col("shard")) & (F.when(limit < 1.0, spread).otherwise(chance) < limit)
        before, linked = linked, materialize(moves.select("hub", "mark", F.when(taken, F.col("to")).otherwise(F.col("shard")).cast("int").alias("shard")), f"labels-{turn}")
        if turn:
            discard(before)
    return linked


def ranked(df: DataFrame, bucket: Column, order: list) -> DataFrame:
    """df with `pos`, the place of each row within its shard by (bucket, order), from 0. Buckets are counted first, so
    that a task sorts one bucket and never a shard."""
    df = df.withColumn("bucket", bucket)
    sums = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*order))
    return df.join(starts, ["shard", "bucket"]).withColumn("pos", F.col("start") + inside - 1).drop("start", "bucket")


def settle(nodes: DataFrame, shards: int, quotas: list[int]) -> DataFrame:
    """nodes with shard, linked, hot, hub, mark -> the same with their last shard and slot; quotas hold exactly."""
    held = _counts(nodes, shards)
    high = lambda name, bits: F.shiftrightunsigned(F.col(name), 64 - bits).cast("long")
    # hot hubs are ranked in as many buckets as their rows need; the members of all others stand together
    sub_bits = max(4, math.ceil(math.log2(max(1, max(quotas, default=0) / RANKED))))
    alone = F.lit(1 << (HUB_BITS + sub_bits)) + high("mark", HUB_BITS + sub_bits)
    bucket = F.when(F.col("linked"), high("hub", HUB_BITS) * F.lit(1 << sub_bits) + F.when(F.col("hot"), high("mark", sub_bits)).otherwise(0)).otherwise(alone)
    placed = ranked(nodes, bucket, ["hub", "mark", "doc"])
    over = [max(0, h - q) for h, q in zip(held, quotas)]
    short = [max(0, q - h) for h, q in zip(held, quotas)]
    before = [sum(over[:s]) for s in range(shards)]
    index = by_shard([b - q for b, q in zip(before, quotas)]) + F.col("pos")  # of a row beyond its quota, over all shards
    target, slot, done = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    cases = []
    for s in range(shards):
        if short[s]:
            cases.append((done + short[s], s, held[s] - done))
            done += short[s]
    for end, s, shift in reversed(cases):
        target = F.when(F.col("index") < end, F.lit(s)).otherwise(target)
        slot = F.when(F.col("index") < end, F.col("index") + F.lit(shift)).otherwise(slot)
    stays = F.col("pos") < by_shard(quotas)
    out = placed.withColumn("index", index.cast("long"))
    return out.withColumn("slot", F.when(stays, F.col("pos")).otherwise(slot).cast("long")).withColumn("shard", F.when(stays, F.col("shard")).otherwise(target).cast("int")).drop("index", "pos")


def cut_links(placed: DataFrame, hub: str = "hub") -> DataFrame:
    """placed: rows with a hub and a shard -> (links, cut): links of rows to their hub, and those to another shard than most of the hub's rows have."""
    tally = placed.groupBy(hub, "shard").agg(F.count(F.lit(1)).alias("n")).groupBy(hub).agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
    return tally.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    nodes = docs.select(doc_key(id_col).alias("doc"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("crc"), F.xxhash64(text).alias("hub"))
    nodes = materialize(nodes.withColumn("mark", F.xxhash64("doc", "hub", F.lit(seed))), "nodes")
    rows = nodes.count()
    quotas = [rows // shards + (s < rows % shards) for s in range(shards)]
    first = F.pmod(F.xxhash64("mark", F.lit("first")), F.lit(shards)).cast("int").alias("shard")
    groups = materialize(nodes.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
    hot = groups.where(F.col("n") > max(1, HOT * rows / shards)).select("hub", F.lit(True).alias("hot"))  # shards / HOT rows at most
    linked = materialize(nodes.join(groups, "hub", "left_semi").select("hub", "mark", first), "linked")
    moved = propagate(linked, shards, quotas, rounds, seed)
    # a label for each (hub, mark); equal rows have equal marks and so one label
    labels = moved.groupBy("hub", "mark").agg(F.min("shard").alias("label"))
    rows_of_docs, nodes = nodes, nodes.join(labels, ["hub", "mark"], "left").select("doc", "size", "crc", "hub", "mark", F.col("label").isNotNull().alias("linked"), F.coalesce("label", first).cast("int").alias("shard"))
    nodes = nodes.join(F.broadcast(hot), "hub", "left").fillna(False, ["hot"])
    labelled = materialize(nodes, "labelled")
    for x in (rows_of_docs, groups, linked, moved):
        discard(x)
    out = settle(labelled, shards, quotas)
    return out.select(key_to_id("doc").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
