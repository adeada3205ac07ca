"""Mixing sources to target weights, in DataFrame functions only.

Sources form a tree (by default domain, language, source). A token budget goes down the tree: siblings share their parent's
budget by weight, none gets more than its documents can give in `epochs` passes, and what one cannot take goes to its
siblings first; only what a whole family cannot take goes to the family's own siblings. A leaf then takes whole passes and, of
one more pass in a seeded order, the documents at the front until its budget is spent to the token (the last one in part).

All sums are whole numbers and products of tokens and weights have 38 digits, so any split is exact and the same on every run; a family's work grows with its
members (two sorts and running sums). Prefix sums within a leaf first count hash
ranges and then sort within a range, so a leaf with a third of all rows is no single task.

Results in odd cases: nulls in a level count as ""; a null or empty text has no tokens and is never taken; sources without a
weight have weight 1; weights whose sources are absent are left to the siblings; a budget beyond all passes takes all; repeated rows
are separate rows with neighbouring places; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, free_names, materialize

#: Weights are whole numbers; those given for one level sum up to this at most.
MOST_WEIGHT = 10_000
RANGES = 4096
SPACE = r"[\x20\x09-\x0D]+"

#: Production parameters of the query.
DOMAIN = [("books", "^src1[0-9]$"), ("web", "^src[0-9]$")]
WEIGHTS = {"domain": {"web": 6, "books": 3, "other": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}
SHARE, EPOCHS, SEED = (6, 10), 4, 17


def domain_of(source: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(DOMAIN):
        out = F.when(source.rlike(pattern), name).otherwise(out)
    return out


def count_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def _wide(tokens: str, weight: str) -> str:
    """A product of tokens and weights: it may be longer than 64 bits."""
    return f"CAST({tokens} AS DECIMAL(19, 0)) * CAST({weight} AS DECIMAL(18, 0))"


def fill(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """nodes: (parents, level, cap, weight, budget of the parent) -> the same with `share`: the budget of each node."""
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    by_need = family.orderBy(F.col("cap").cast("double") / F.col("weight"), level)
    by_name = family.orderBy(level)
    so_far = (Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("budget", F.least("budget", F.sum("cap").over(family)))
    nodes = nodes.withColumn("before", F.coalesce(F.sum("cap").over(by_need.rowsBetween(*so_far)), F.lit(0)))
    nodes = nodes.withColumn("rest", F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(by_need.rowsBetween(*so_far)), F.lit(0)))
    # full: its share by weight of what is left after those that need least is all it can take
    nodes = nodes.withColumn("full", F.expr(f"{_wide('cap', 'rest')} <= {_wide('budget - before', 'weight')}"))
    nodes = nodes.withColumn("full", F.min("full").over(by_need.rowsBetween(Window.unboundedPreceding, 0)))
    nodes = nodes.withColumn("open", F.when(F.col("full"), 0).otherwise(F.col("weight")))
    nodes = nodes.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family))
    nodes = nodes.withColumn("total", F.greatest(F.sum("open").over(family), F.lit(1))).withColumn("upto", F.sum("open").over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.expr(f"CASE WHEN full THEN cap ELSE {_wide('left', 'upto')} DIV total - {_wide('left', 'upto - open')} DIV total END")
    return nodes.withColumn("share", share.cast("long")).drop("before", "rest", "full", "open", "left", "total", "upto")


def _weight(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, int(w)).otherwise(out)
    return out.cast("long")


def allocate(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int, epochs: int) -> DataFrame:
    """leaves: (levels, tokens) -> the same with `share` (tokens to take), `passes` (whole ones) and `rest` (of one more)."""
    for level in levels:
        given = weights.get(level, {})
        if any(w < 1 or int(w) != w for w in given.values()) or sum(given.values()) > MOST_WEIGHT:
            raise ValueError(f"weights of {level} must be whole numbers from 1, of sum {MOST_WEIGHT} at most")
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    above: DataFrame | None = None
    for depth, level in enumerate(levels):
        parents, keys = levels[:depth], levels[: depth + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights.get(level, {})))
        nodes = nodes.withColumn("budget", F.lit(int(budget)).cast("long")) if above is None else nodes.join(above.withColumnRenamed("share", "budget"), parents)
        above = fill(nodes, parents, level).select(*keys, "share")
    plan = leaves.join(above, levels)
    # a leaf without tokens has cap and share 0
    return plan.select(*levels, "tokens", "share", F.expr("share DIV greatest(tokens, 1)").alias("passes"), F.expr("share % greatest(tokens, 1)").alias("rest"))


def epoch_order(seed: int, passes: Column, doc: Column) -> Column:
    """A document's place in an epoch: it changes with the seed and with the number of whole passes before."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), passes.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"))


def select_prefix(rows: DataFrame, levels: list[str], seed: int) -> DataFrame:
    """rows: (doc_id, levels, n_tokens, passes, rest) -> the same with take_tokens: passes * n_tokens, and what the further pass
    takes; and order, the place in that pass."""
    rows = rows.withColumn("order", epoch_order(seed, F.col("passes"), F.col("doc_id"))).withColumn("range", (F.conv(F.substring("order", 1, 3), 16, 10).cast("int") * RANGES / 4096).cast("int"))
    place = [*levels, "range"]
    sums = rows.groupBy(*place).agg(F.sum("n_tokens").alias("n"))
    ahead = Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*place, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*place).orderBy("order", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, place).withColumn("start", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("n_tokens"), F.col("rest") - F.col("start")))
    return rows.withColumn("take_tokens", (F.col("passes") * F.col("n_tokens") + cut).cast("long")).drop("range", "start")


def _planned(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """Each row's tokens taken (with order), and the scratch tables that it reads."""
    names = list(levels)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in levels.items()), count_tokens(text).alias("n_tokens"))
    rows = materialize(rows, "tokens")
    leaves = materialize(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = materialize(allocate(leaves, names, weights, total * share[0] // share[1], epochs), "leaf-plan")
    discard(leaves)
    # the plan is as large as the tree; Spark sends it to all tasks if its files are small enough, and else splits large leaves
    return select_prefix(rows.join(plan.drop("tokens", "share"), names), names, seed), [rows, plan]


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the levels, n_tokens, passes (whole ones of the leaf), take_tokens (of this document, all passes together), for
    each row of docs. share: the budget as a fraction (numerator, denominator) of all tokens."""
    out, _ = _planned(docs, levels, weights, share, epochs, seed, id_col, text_col)
    return out.select("doc_id", *levels, "n_tokens", "passes", "take_tokens")


def production_levels() -> dict[str, Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return {"domain": domain_of(source), "lang": F.col("lang"), "source": source}


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """mix() over domain, lang and source with the production parameters."""
    return mix(docs, production_levels(), WEIGHTS, **options)


def keep_mixed(docs: DataFrame, share: tuple[int, int] = SHARE, seed: int = SEED) -> DataFrame:
    """The rows of docs, with all their columns, of which one pass takes some token. Each leaf tells only where its prefix ends
    (a table as large as the tree), so the texts stay where they are; rows that have the last one's place all stay."""
    levels = production_levels()
    taken, tables = _planned(docs, levels, WEIGHTS, share, 1, seed, "doc_id", "text")
    last = taken.where("take_tokens > 0").groupBy(*levels).agg(F.max(F.struct("order", "n_tokens")).alias("last"), F.max("passes").alias("whole"))
    last = materialize(last, "prefix-ends")
    for x in tables:
        discard(x)
    names = free_names(docs, "leaf_domain", "leaf_lang", "leaf_source", "leaf_last", "leaf_whole", "leaf_tokens")
    keys = names[:3]
    last = last.select(*(F.col(k).alias(n) for k, n in zip(levels, keys)), F.col("last").alias(names[3]), F.col("whole").alias(names[4]))
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*own, *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(levels.values(), keys)), count_tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(names[5]))
    place = F.struct(epoch_order(seed, F.col(names[4]), F.col("doc_id")).alias("order"), F.col(names[5]).alias("n_tokens"))
    return rows.join(last, keys).where((F.col(names[5]) > 0) & ((F.col(names[4]) > 0) | (place <= F.col(names[3])))).select(*own)


def _case(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items()) + " ELSE 1 END"


def _fill_sql(name: str, parents: list[str], level: str, budget: str, above: str) -> str:
    keys = ", ".join([*parents, level])
    family = f"PARTITION BY {', '.join(parents)}" if parents else ""
    source = f"JOIN {above} USING ({', '.join(parents)})" if parents else ""
    return f"""
{name}_nodes AS (
  SELECT {keys}, cap, weight, least({budget}, sum(cap) OVER ({family})) AS budget
  FROM (SELECT {keys}, sum(cap) AS cap, {_case(level)} AS weight FROM leaves GROUP BY {keys}) {source}
), {name}_need AS (
  SELECT *, min(CASE WHEN cap * rest <= weight * (budget - before) THEN 1 ELSE 0 END) OVER ({family} ORDER BY CAST(cap AS DOUBLE) / weight, {level} ROWS UNBOUNDED PRECEDING) AS is_full
  FROM (SELECT *, coalesce(sum(cap) OVER ({family} ORDER BY CAST(cap AS DOUBLE) / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER ({family} ORDER BY CAST(cap AS DOUBLE) / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_nodes)
), {name} AS (
  SELECT {keys}, CASE WHEN is_full = 1 THEN cap ELSE (remaining * upto) // total - (remaining * (upto - weight)) // total END AS {name}_share
  FROM (SELECT *, budget - sum(CASE WHEN is_full = 1 THEN cap ELSE 0 END) OVER ({family}) AS remaining,
    greatest(sum(CASE WHEN is_full = 1 THEN 0 ELSE weight END) OVER ({family}), 1) AS total,
    sum(CASE WHEN is_full = 1 THEN 0 ELSE weight END) OVER ({family} ORDER BY {level} ROWS UNBOUNDED PRECEDING) AS upto FROM {name}_need)
)"""


def oracle(table: str = "documents", epochs: int = EPOCHS, prefix: str = "", share: tuple[int, int] = SHARE) -> str:
    """SQL with a table `mixed` of what mix_sources() returns; prefix: tables before it, without WITH."""
    domain = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(source, ''), '{p}') THEN '{n}'" for n, p in DOMAIN) + " ELSE 'other' END"
    return (
        f"""WITH {prefix}tokens AS (
  SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {table}
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {epochs} AS cap FROM tokens GROUP BY ALL
), """
        + ", ".join([_fill_sql("level1", [], "domain", f"(SELECT coalesce(sum(tokens), 0) * {share[0]} // {share[1]} FROM leaves)", ""), _fill_sql("level2", ["domain"], "lang", "level1_share", "level1"), _fill_sql("level3", ["domain", "lang"], "source", "level2_share", "level2")])
        + f""", placed AS (
  SELECT t.*, l3.level3_share // greatest(l.tokens, 1) AS passes, l3.level3_share % greatest(l.tokens, 1) AS rest
  FROM tokens t JOIN leaves l USING (domain, lang, source) JOIN level3 l3 USING (domain, lang, source)
), mixed AS (
  SELECT doc_id, domain, lang, source, n_tokens, CAST(passes AS BIGINT) AS passes,
    CAST(passes * n_tokens + greatest(0, least(n_tokens, rest - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5(concat('{SEED}:', CAST(passes AS VARCHAR), ':', coalesce(CAST(doc_id AS VARCHAR), ''))), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS take_tokens
  FROM placed
)"""
    )
