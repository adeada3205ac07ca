"""Approximate nearest neighbours by a hierarchical k-means tree.

1. Equal vectors become one: it keeps the k + 1 smallest ids of its rows (no list of k rows needs more), so a hot vector is compared once.
2. The tree is fitted on samples: its first two levels on about SAMPLE vectors, the next two, within each cell of the first,
   on about CELL_SAMPLE vectors of the cell. A node has up to BRANCH children and is split while it stands for more than LEAF_ROWS
   vectors, so there are at most BRANCH**4 leaves (17 MB of centres of 64 floats). Every vector then descends to its leaf. Largest inner products are
   nearest points once a coordinate sqrt(longest**2 - length**2) is added to the vectors and 0 to queries.
3. A query descends to a leaf and puts the branches that it passes into a priority queue; the best one is taken next, and so on (best bin
   first). How many leaves to visit is calibrated: CALIBRATION queries are answered by brute force, and visits widen until
   TARGET of their true neighbours are in visited leaves.
4. Queries go to the blocks of the leaves they visit: first an eighth of the visits, then the rest with the k-th score so far as floor.
   Leaves with many rows are cut into blocks, and blocks asked by many queries are asked in parts.

Results in odd cases: vectors that are null, zero, empty, hold null or non-finite components, or have another length than the most frequent
one (the smaller of equals) take no part; nor do rows with a null id. Rows equal in id and vector count once; rows that share an id but not the
vector are rows of their own (each asks, and only the asking one is no candidate). Other columns are ignored. An empty table gives no rows."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

BRANCH, LEAF_ROWS, TURNS = 16, 512, 8
SAMPLE, CELL_SAMPLE = 1 << 15, 1 << 14
CALIBRATION, TARGET = 256, 0.95
#: Rows of a leaf, and queries, that a task multiplies at once.
BLOCK = 4096


@dataclass
class Tree:
    """Children of a node stand together from first[node]; a node without children is a leaf and has a number."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    def __post_init__(self):
        self.half = (self.centres.astype(np.float64) ** 2).sum(axis=1) / 2

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def k_means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Up to k centres."""
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(TURNS):
        own = (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def grow(points: np.ndarray, each: float, depth: int, rng: np.random.Generator, leaf_rows: int) -> list:
    """Nested [centre, children] below a node that holds these sampled points, each standing for `each` rows."""
    k = min(BRANCH, int(np.ceil(len(points) * each / leaf_rows)), len(points) // 2)
    if k < 2 or not depth:
        return []
    centres = k_means(points, k, rng)
    if len(centres) < 2:
        return []
    own = (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
    return [[c, grow(points[own == n], each, depth - 1, rng, leaf_rows)] for n, c in enumerate(centres)]


def flatten(root: np.ndarray, children: list) -> Tree:
    """Nested lists as arrays, level by level."""
    centres, kids = [root], [children]
    first, count = [], []
    node = 0
    while node < len(centres):
        first.append(len(centres))
        count.append(len(kids[node]))
        for c, below in kids[node]:
            centres.append(c)
            kids.append(below)
        node += 1
    count = np.array(count, np.int32)
    return Tree(np.array(centres, np.float32), np.array(first, np.int32), count, np.where(count == 0, np.cumsum(count == 0) - 1, -1).astype(np.int32))


def descend(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    node = np.zeros(len(points), np.int64)
    todo = np.arange(len(points)) if tree.count[0] else np.zeros(0, np.int64)
    while len(todo):
        for n in np.unique(node[todo]):
            at = todo[node[todo] == n]
            kids = slice(tree.first[n], tree.first[n] + tree.count[n])
            node[at] = tree.first[n] + (points[at] @ tree.centres[kids].T.astype(np.float64) - tree.half[kids]).argmax(axis=1)
        todo = todo[tree.count[node[todo]] > 0]
    return tree.leaf[node]


def best_bins(tree: Tree, query: np.ndarray):
    """Leaves in the order in which a query visits them."""
    queue = [(0.0, 0)]
    while queue:
        node = heapq.heappop(queue)[1]
        while tree.count[node]:
            first = int(tree.first[node])
            kids = slice(first, first + int(tree.count[node]))
            far = (tree.half[kids] - tree.centres[kids] @ query).tolist()
            best = far.index(min(far))
            for k, distance in enumerate(far):
                if k != best:
                    heapq.heappush(queue, (distance, first + k))
            node = first + best
        yield int(tree.leaf[node])


def _matrix(column) -> np.ndarray:
    """Vectors of an Arrow or pandas column as rows of doubles."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lifted(points: np.ndarray, longest: float) -> np.ndarray:
    rest = np.maximum(longest - (points**2).sum(axis=1), 0)
    return np.hstack([points, np.sqrt(rest)[:, None]])


def _cells(tree: Tree, longest: float, name: str):
    """Adds to each batch the leaf of its vectors (the column `vector`)."""

    def run(batches):
        for batch in batches:
            points = _matrix(batch.column(batch.schema.get_field_index("vector")))
            own = descend(tree, _lifted(points, longest)) if len(points) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*batch.schema.names, name])

    return run


def _with(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def distinct_vectors(df: DataFrame, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(one, two, id) of every row that takes part, once each; and one, two, vector, ids for each distinct vector: 128 bits of hash
    and the k smallest ids of its rows."""
    kind = df.schema[vector_col].dataType.simpleString()
    vector = F.col(f"`{vector_col}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector")).where("id IS NOT NULL AND size(vector) > 0")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~odd & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vector") == (sizes[0]["n"] if sizes else 0))
    rows = rows.select("id", "vector", F.xxhash64("vector").alias("one"), F.xxhash64(F.lit(7), "vector").alias("two"))
    ids = materialize(rows.select("one", "two", "id").distinct(), "vector-ids")
    # of a hot vector each task keeps the smallest ids, then each of 64 parts, then all
    least = ids
    for part in ([F.pmod(F.xxhash64("id"), F.lit(64))], []):
        at = F.row_number().over(Window.partitionBy("one", "two", *part).orderBy("id"))
        least = least.withColumn("at", at).where(F.col("at") <= k).drop("at")
    least = least.groupBy("one", "two").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rows, least.join(rows.groupBy("one", "two").agg(F.first("vector").alias("vector")), ["one", "two"]).select("one", "two", "vector", "ids")


@dataclass
class Index:
    """Distinct vectors with their leaves, the tree, and the squared length of the longest vector."""

    rows: DataFrame
    tree: Tree
    longest: float


def _grow_cell(each: dict[int, float], longest: float, leaf_rows: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["one", "two"])
        below = grow(_lifted(_matrix(pdf["vector"]), longest), each[key[0]], 2, np.random.default_rng(key[0]), leaf_rows)
        out = []
        for n, (centre, children) in enumerate(below):
            out.append((key[0], n, -1, centre.tolist()))
            out += [(key[0], n, m, c.tolist()) for m, (c, _) in enumerate(children)]
        return pd.DataFrame(out, columns=["cell", "n", "m", "centre"])

    return run


def fit(vectors: DataFrame, rows: int, longest: float, leaf_rows: int = LEAF_ROWS) -> Tree:
    """The tree of `rows` distinct vectors (one, two, vector)."""
    spread = F.pmod("one", F.lit(1 << 32))
    sampled = vectors.where(spread < F.lit(int((1 << 32) * SAMPLE / max(rows, 1)))).select("one", "two", "vector").toPandas().sort_values(["one", "two"])
    points = _lifted(_matrix(sampled["vector"]), longest) if len(sampled) else np.zeros((1, 1))
    root = points.mean(axis=0)
    top = grow(points, rows / max(len(sampled), 1), 2, np.random.default_rng(0), leaf_rows)
    tree = flatten(root, top)
    # cells of the first two levels that are still too large: two more levels, each from its own sample
    own = vectors.select("one", "two", "vector").mapInArrow(_cells(tree, longest, "cell"), _with(vectors.select("one", "two", "vector"), "cell int"))
    large = {r["cell"]: r["count"] for r in own.groupBy("cell").count().where(F.col("count") > leaf_rows).collect()} if tree.leaves >= BRANCH**2 // 2 else {}
    if large:
        share = F.create_map(*(F.lit(x) for c, n in large.items() for x in (c, int((1 << 32) * CELL_SAMPLE / n))))
        other = F.pmod("two", F.lit(1 << 32))
        picked = own.where(F.col("cell").isin(list(large)) & (other < share[F.col("cell")]))
        each = {c: max(1.0, n / CELL_SAMPLE) for c, n in large.items()}
        found = picked.groupBy("cell").applyInPandas(_grow_cell(each, longest, leaf_rows), "cell int, n int, m int, centre array<double>").toPandas()
        leaves = _leaf_slots(top)
        for cell, below in found.sort_values(["cell", "n", "m"]).groupby("cell"):
            for n, m, centre in zip(below["n"], below["m"], below["centre"]):
                if m < 0:
                    leaves[cell].append([np.asarray(centre), []])
                else:
                    leaves[cell][n][1].append([np.asarray(centre), []])
        tree = flatten(root, top)
    return tree


def _leaf_slots(children: list) -> list[list]:
    """The (empty) lists of children of all leaves, in the order of their numbers."""
    out, level = [], [children]
    while level:
        out += [x for x in level if not x]
        level = [below for x in level for _, below in x]
    return out


def build(distinct: DataFrame, leaf_rows: int = LEAF_ROWS) -> Index:
    """Every distinct vector in its leaf."""
    distinct = materialize(distinct, "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    at = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest")).first()
    longest = (at["longest"] or 0.0) * (1 + 1e-12)
    tree = fit(distinct, at["n"], longest, leaf_rows)
    rows = materialize(distinct.mapInArrow(_cells(tree, longest, "leaf"), _with(distinct, "leaf int")), "vector-leaves")
    discard(distinct)
    return Index(rows, tree, longest)


def _best(scores: np.ndarray, vectors: np.ndarray, ids, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, ids and exact scores of the k best rows (equal scores: smaller ids) that reach the floor."""
    take = min(k, len(scores))
    slack = 1e-9 * max(1.0, float(np.abs(scores).max()))
    near = np.flatnonzero(scores >= max(np.partition(scores, -take)[-take], floor) - slack)
    exact = (vectors[near] * query).sum(axis=1)
    near, exact = near[exact >= floor], exact[exact >= floor]
    sizes = np.array([len(ids[n]) for n in near], np.int64)
    listed = np.concatenate([np.zeros(0, np.int64), *(ids[n] for n in near)])
    at, exact = np.repeat(near, sizes), np.repeat(exact, sizes)
    order = np.lexsort((listed, -exact))[:k]
    return at[order], listed[order], exact[order]


def _brute(queries: np.ndarray, k: int):
    """The k best rows of each task for each of few queries, with their leaves."""

    def run(batches):
        kept = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)) for _ in queries]
        for batch in batches:
            vectors, leaf = _matrix(batch.column(0)), batch.column(2).to_numpy()
            if not len(vectors):
                continue
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            for q, scores in enumerate(queries @ vectors.T):
                at, listed, exact = _best(scores, vectors, ids, queries[q], k, -np.inf)
                own = [np.concatenate(x) for x in zip(kept[q], (listed, exact, leaf[at]))]
                order = np.lexsort((own[0], -own[1]))[:k]
                kept[q] = tuple(x[order] for x in own)
        sizes = [len(x[0]) for x in kept]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(queries)), sizes)), *(pa.array(np.concatenate(x)) for x in zip(*kept))], names=["q", "id", "score", "leaf"])

    return run


def _first_leaves(tree: Tree, most: int):
    def run(batches):
        for batch in batches:
            visits = [[leaf for leaf, _ in zip(best_bins(tree, query), range(most))] for query in _lifted(_matrix(batch.column(2)), 0.0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "leaves"])

    return run


def _turns(tree: Tree, queries: np.ndarray):
    """q and the leaves of its true neighbours -> after how many visits each is reached."""

    def run(batches):
        for batch in batches:
            out = []
            for q, leaves in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left, turn = set(leaves), {}
                for n, leaf in enumerate(best_bins(tree, np.append(queries[q], 0.0)), 1):
                    turn[leaf] = n
                    left.discard(leaf)
                    if not left:
                        break
                out += [turn[x] for x in leaves]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["turn"])

    return run


def calibrate(index: Index, asked: DataFrame, k: int, target: float = TARGET) -> tuple[int, float]:
    """Leaves to visit, and the share of true neighbours found then: measured on about CALIBRATION of the distinct query vectors."""
    n = asked.count()
    spread = F.pmod("two", F.lit(1 << 32)) < F.lit(int((1 << 32) * min(1.0, CALIBRATION / max(n, 1))))
    sample = asked.where(spread).select("one", "two", "vector").toPandas().sort_values(["one", "two"])
    if sample.empty:  # few queries can all miss the draw
        sample = asked.select("one", "two", "vector").limit(CALIBRATION).toPandas()
    if sample.empty:
        return 1, 1.0
    queries = _matrix(sample["vector"])
    found = index.rows.select("vector", "ids", "leaf").mapInArrow(_brute(queries, k + 1), "q long, id long, score double, leaf int")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    # the first place is as a rule the query itself
    found = found.withColumn("place", place).where((F.col("place") <= k + 1) & (F.col("place") > 1))
    turns = found.groupBy("q").agg(F.collect_list("leaf").alias("leaves")).mapInArrow(_turns(index.tree, queries), "turn int")
    turns = np.sort([r["turn"] for r in turns.collect()])
    if not len(turns):
        return 1, 1.0
    visits = int(turns[min(len(turns) - 1, int(np.ceil(target * len(turns))) - 1)])
    return visits, float((turns <= visits).mean())


#: same: the row's vector is the query's.
FOUND = "one long, two long, id long, score double, same boolean"


def _scan(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            vectors, ids, asked = _matrix(rows["vector"]), rows["ids"].to_numpy(), _matrix(queries["vector"])
            hashes, own = rows[["one", "two"]].to_numpy(np.int64), queries[["one", "two"]].to_numpy(np.int64)
            floors = queries["floor"].to_numpy()
            for first in range(0, len(asked), 256):
                for q, scores in enumerate(asked[first : first + 256] @ vectors.T, first):
                    at, listed, exact = _best(scores, vectors, ids, asked[q], k, floors[q])
                    out.append((np.full(len(at), own[q, 0]), np.full(len(at), own[q, 1]), listed, exact, (hashes[at] == own[q]).all(axis=1)))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 5
        return pd.DataFrame(dict(zip(["one", "two", "id", "score", "same"], columns))).astype({"same": bool})

    return run


def _visit(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """one, two, id, score, same of the k best rows in each asked block. asked: one, two, vector, floor, leaf."""
    rows_in = index.rows.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    asked_of = asked.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    sizes = materialize(rows_in.join(asked_of, "leaf"), "leaf-sizes")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.rows.join(sizes, "leaf").select("leaf", F.pmod("one", "blocks").cast("int").alias("block"), up_to("parts").alias("part"), "one", "two", "vector", "ids")
    queries = asked.join(sizes, "leaf").select("leaf", up_to("blocks").alias("block"), F.pmod("two", "parts").cast("int").alias("part"), "one", "two", "vector", "floor")
    keys = ["leaf", "block", "part"]
    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_scan(k), FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("one", "two").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def search(index: Index, asked: DataFrame, k: int, target: float = TARGET) -> DataFrame:
    """one, two, id, score, same, place: the k best rows found for each of the distinct query vectors `asked` (one, two, vector)."""
    visits, _ = calibrate(index, asked, k, target)
    asked = materialize(asked.mapInArrow(_first_leaves(index.tree, visits), _with(asked, "leaves array<int>")), "visits")
    early = -(-visits // 8)
    begun = asked.select("one", "two", "vector", F.lit(float("-inf")).alias("floor"), F.explode(F.slice("leaves", 1, early)).alias("leaf"))
    first = materialize(_top(_visit(index, begun, k), k).drop("place"), "neighbours")
    if visits <= early:
        return _top(first, k)
    floors = first.groupBy("one", "two").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(float("-inf")).alias("floor"))
    widened = asked.join(floors, ["one", "two"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    widened = widened.select("one", "two", "vector", "floor", F.explode(F.slice("leaves", early + 1, visits)).alias("leaf"))
    return _top(first.union(_visit(index, widened, k)), k)


def nearest_rows(df: DataFrame, every: int = 20, k: int = 20, target: float = TARGET, leaf_rows: int = LEAF_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k rows of largest inner product that are found."""
    rows, distinct = distinct_vectors(df, k + 1, id_col, vector_col)
    index = build(distinct, leaf_rows)
    asking = rows.where(F.col("id") % every == 0).select("one", "two", "id").distinct()
    asked = materialize(index.rows.join(asking.select("one", "two").distinct(), ["one", "two"], "left_semi").select("one", "two", "vector"), "asked")
    found = materialize(search(index, asked, k + 1, target), "found")
    # of its k + 1 a query drops itself or the last
    pairs = asking.select("one", "two", F.col("id").alias("query_id")).join(found, ["one", "two"]).where(~(F.col("same") & (F.col("id") == F.col("query_id"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "one", "two").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
