"""Families of many sources, and budgets whose products leave 64 bits."""

import time

from pyspark.sql import functions as F

from tessera.llm import mixing


def shares(spark, n, tokens, budget, weights=None):
    leaves = spark.range(n).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), tokens.cast("long").alias("tokens"))
    return mixing.allocate(leaves, ["source"], {"source": weights or {}}, budget, 1)


def test_a_million_sources_in_one_family(spark):
    began = time.time()
    out = shares(spark, 10**6, F.lit(10**8) + F.col("id") % 7, 10**14 // 2)
    got = out.agg(F.sum("share").alias("all"), F.min("share").alias("least"), F.max("share").alias("most")).first()
    assert (got["all"], got["least"], got["most"]) == (10**14 // 2, 5 * 10**7, 5 * 10**7)
    assert time.time() - began < 120


def test_shares_to_the_token(spark):
    """A tenth of 160,000 sources is small; what these can't take goes to the others, by weight."""
    small = F.col("id") % 10 == 0
    budget = 6 * 10**13
    out = shares(spark, 160_000, F.when(small, 1000).otherwise(10**9), budget, {"s1": 9000})
    got = {r["kind"]: (r["n"], r["all"]) for r in out.groupBy(F.when(F.col("tokens") == 1000, "small").when(F.col("source") == "s1", "heavy").otherwise("other").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("all")).collect()}
    assert got["small"] == (16_000, 16_000 * 1000) and got["heavy"] == (1, 10**9)
    assert sum(v for _, v in got.values()) == budget


def test_uneven_products(spark):
    out = shares(spark, 10_000, F.lit(10**12), 2 * 10**15 + 1).agg(F.sum("share"), F.max("share") - F.min("share")).first()
    assert tuple(out) == (2 * 10**15 + 1, 1)
