"""A stored vector index that stays exact.

Vectors of one space (provider, model, length) are unit vectors around centroids. A cell's rows are one partition of the stored table, each with its angle
to the centroid; a table of cells has their sizes and radii (greatest angles). For a query at angle a from a centroid no row of the
cell can be nearer than a - radius (triangle inequality of angles on the sphere), and no row x nearer than |a - angle(x)|. A search probes the
nearest cells first; with the k-th angle found there it reads only the cells that can still hold something nearer, so its results are those of a scan
of all rows. Rows are added by appending to the cells; vectors that are null, zero or not finite have no distance and are left out.

Centroids are fitted on about SAMPLE vectors of each space; there are at most MOST_CELLS cells a space, and their centroids (12 MB for 1,536
components) go to every task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import ranked
from tessera.sources import scratch

SAMPLE, MOST_CELLS, TURNS = 1 << 14, 1024, 8
#: Cells probed first; rows and queries that a task multiplies at once; what rounding may cost an angle.
PROBES, BLOCK, ROUNDING = 4, 4096, 1e-6
SPACE = ["provider", "model", "length"]


def _unit(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _rows(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("length", F.size("embedding")).where(usable(F.col("embedding")))


def _fit(sizes: dict):
    """The centroids of one space: spherical k-means on its sample, started from rows in a fixed order."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = _unit(pdf.sort_values("order")["embedding"])
        cells = int(min(MOST_CELLS, len(points), np.ceil(np.sqrt(sizes[key]))))
        centres = points[:cells]
        for _ in range(TURNS):
            own = (points @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, points)
            length = np.linalg.norm(sums, axis=1)
            centres = sums[length > 0] / length[length > 0, None]
        return pd.DataFrame({**{c: [k] * len(centres) for c, k in zip(SPACE, key)}, "centroid": list(centres)})

    return run


def _assign(centroids: list):
    """Rows with the cell of their nearest centroid and their angle to it."""
    spaces: dict = {}
    for r in centroids:
        spaces.setdefault(tuple(r[c] for c in SPACE), ([], []))[0].append(r["cell"])
        spaces[tuple(r[c] for c in SPACE)][1].append(r["centroid"])
    spaces = {k: (np.array(cells), np.array(centres)) for k, (cells, centres) in spaces.items()}

    def run(frames):
        for pdf in frames:
            cell, angle = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf))
            for key, at in pdf.groupby(SPACE, dropna=False).indices.items():
                key = tuple(None if pd.isna(k) else k for k in key)
                if key in spaces:
                    far = _angles(_unit(pdf["embedding"].iloc[at]), spaces[key][1])
                    cell[at], angle[at] = spaces[key][0][far.argmin(axis=1)], far.min(axis=1)
            yield pdf.assign(cell=cell, angle=angle)

    return run


def build(chunks: DataFrame, path: str) -> None:
    """Fit the centroids and store the rows. chunks: (chunk_id, item_id, chunk_type, provider, model, embedding)."""
    rows = _rows(chunks)
    sizes = {tuple(r[c] for c in SPACE): r["count"] for r in rows.groupBy(*SPACE).count().collect()}  # one row a model
    order = F.xxhash64("chunk_id", "embedding")
    n = F.count(F.lit(1)).alias("n")
    share = rows.groupBy(*SPACE).agg(n).select(*[F.col(c).alias(f"__{c}") for c in SPACE], (F.lit(2.0**32) * SAMPLE / F.col("n")).alias("below"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SPACE]
    sample = rows.withColumn("order", order).join(F.broadcast(share), same).where(F.pmod("order", F.lit(1 << 32)) < F.col("below")).select(*SPACE, "order", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = sample.groupBy(*SPACE).applyInPandas(_fit(sizes), ", ".join(f"{c} {kinds[c]}" for c in SPACE) + ", centroid array<double>").collect()
    found = sorted(found, key=lambda r: tuple(str(r[c]) for c in SPACE))
    centroids = chunks.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(found)], ", ".join(f"{c} {kinds[c]}" for c in SPACE) + ", centroid array<double>, cell long")
    centroids.write.parquet(f"{path}/centroids")
    append(chunks, path)


def append(chunks: DataFrame, path: str) -> None:
    """Store further rows in the cells of an index. A space that it doesn't know gets a cell of its own around its first rows' sum."""
    spark = chunks.sparkSession
    rows = _rows(chunks)
    known = spark.read.parquet(f"{path}/centroids").collect()
    seen = {tuple(r[c] for c in SPACE) for r in known}
    new = [r for r in rows.groupBy(*SPACE).agg(F.min_by("embedding", "chunk_id").alias("centroid")).collect() if tuple(r[c] for c in SPACE) not in seen]
    if new:
        schema = spark.read.parquet(f"{path}/centroids").schema
        first = max([r["cell"] for r in known], default=-1) + 1
        more = spark.createDataFrame([(*[r[c] for c in SPACE], [float(x) for x in _unit([r["centroid"]])[0]], first + k) for k, r in enumerate(new)], schema)
        more.write.mode("append").parquet(f"{path}/centroids")
        known = known + more.collect()
    schema = rows.withColumn("cell", F.lit(0).cast("long")).withColumn("angle", F.lit(0.0)).schema
    placed = scratch.stored(rows.mapInPandas(_assign(known), schema), "placed")
    placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(16))).write.mode("append").partitionBy("cell").parquet(f"{path}/rows")
    placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).write.mode("append").parquet(f"{path}/cells")


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Every cell with rows: its space, centroid, size and radius."""
    sizes = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    return spark.read.parquet(f"{path}/centroids").join(sizes, "cell")


def _probes(known: list, top_k: int, first: int):
    """Queries with the cells to probe first (the nearest ones, until they hold top_k rows) and all others with their angles and bounds."""
    spaces: dict = {}
    for r in known:
        spaces.setdefault(tuple(r[c] for c in SPACE), []).append(r)
    spaces = {k: (np.array([r["cell"] for r in v]), np.array([r["centroid"] for r in v]), np.array([r["n"] for r in v]), np.array([r["radius"] for r in v])) for k, v in spaces.items()}

    def run(frames):
        for pdf in frames:
            early, late = [], []
            for vector, *key in zip(pdf["vector"], pdf["provider"], pdf["model"], pdf["length"]):
                cell, centres, n, radius = spaces.get(tuple(None if pd.isna(k) else k for k in key), (np.zeros(0, int), None, None, None))
                if not len(cell):
                    early.append([]), late.append([])
                    continue
                angle = _angles(_unit([vector]), centres)[0]
                order = np.argsort(angle, kind="stable")
                enough = max(first, int(np.searchsorted(np.cumsum(n[order]), top_k)) + 1)
                told = [{"cell": int(cell[k]), "angle": float(angle[k]), "low": float(angle[k] - radius[k])} for k in order]
                early.append(told[:enough]), late.append(told[enough:])
            yield pdf.assign(early=early, late=late)

    return run


def _scan(top_k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            vectors, asked = _unit(rows["embedding"]), _unit(queries["vector"])
            own, ids = rows["angle"].to_numpy(), rows["chunk_id"].to_numpy()
            for k, (query, at, reach) in enumerate(zip(queries["query_id"], queries["angle"], queries["reach"])):
                near = np.flatnonzero(np.abs(at - own) <= reach)
                if not len(near):
                    continue
                far = 1 - vectors[near] @ asked[k]
                keep = near[far <= np.partition(far, min(top_k, len(far)) - 1)[min(top_k, len(far)) - 1] + ROUNDING**2]
                plain = np.stack([np.asarray(v, np.float64) for v in rows["embedding"].iloc[keep]])
                vector = np.asarray(queries["vector"].iloc[k], np.float64)
                exact = 1 - (plain @ vector) / (np.linalg.norm(plain, axis=1) * np.linalg.norm(vector))
                out.append(pd.DataFrame({"query_id": [query] * len(keep), "chunk_id": ids[keep], "distance": exact}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})

    return run


def _visit(rows: DataFrame, asked: DataFrame, top_k: int) -> DataFrame:
    """asked: (query_id, vector, cell, angle, reach). The nearest rows of each asked block of a cell."""
    wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # cells, not queries: MOST_CELLS a space
    # a partition column is read back as int; as a key of cogroup() it would be dealt to other tasks than a long
    rows = rows.where(F.col("cell").isin(wanted)).withColumn("cell", F.col("cell").cast("long"))
    sizes = rows.groupBy("cell").count().select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    parts = asked.groupBy("cell").count().select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    sizes = scratch.stored(sizes.join(parts, "cell"), "cell-sizes")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "cell").select("cell", up_to("blocks").alias("block"), F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id", "vector", "angle", "reach")
    right = rows.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int").alias("block"), up_to("parts").alias("part"), "chunk_id", "embedding", "angle")
    keys, kinds = ["cell", "block", "part"], {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_scan(top_k), f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, distance double")


def vector_leg(path: str, queries: DataFrame, top_k: int = 50, allowed: DataFrame | None = None, probes: int = PROBES) -> DataFrame:
    """The rows of search.vector_leg() from a stored index. queries: (query_id, provider, model, vector); allowed: (chunk_id) that may be found, all if
    None."""
    spark = queries.sparkSession
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi") if allowed is not None else rows
    known = cells(spark, path).collect()
    asked = queries.select("query_id", "provider", "model", "vector", F.size("vector").alias("length")).where(usable(F.col("vector")))
    cell = "array<struct<cell:bigint,angle:double,low:double>>"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    asked = scratch.stored(asked.mapInPandas(_probes(known, top_k, probes), f"{schema}, early {cell}, late {cell}"), "probes")
    order = [F.asc("distance"), F.asc("chunk_id")]
    early = asked.select("query_id", "vector", F.inline("early")).select("query_id", "vector", "cell", "angle", F.lit(np.pi).alias("reach"))
    found = scratch.stored(ranked(_visit(rows, early, top_k), order, top_k, "vector").select("query_id", "chunk_id", "distance"), "near")
    # a query with fewer than top_k rows so far has no bound yet
    reach = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 1 - F.max("distance")))) + ROUNDING
    reached = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= top_k, reach).otherwise(np.pi).alias("reach"))
    late = asked.join(reached, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(np.pi)))
    late = late.select("query_id", "vector", "reach", F.inline("late")).where(F.col("low") - ROUNDING <= F.col("reach")).select("query_id", "vector", "cell", "angle", "reach")
    both = ranked(found.unionByName(_visit(rows, scratch.stored(late, "further-probes"), top_k)), order, top_k, "vector")
    found = both.join(asked.select("query_id", "provider", "model", "length"), "query_id").withColumn("raw_score", 1 - F.col("distance"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("chunk_id", *SPACE)]
    told = [F.col(f"r.{c}") for c in rows.columns if c not in ("embedding", "length", "angle", "cell")]
    return found.alias("f").join(rows.alias("r"), same).select("f.query_id", *told, "f.rank", "f.distance", "f.raw_score", "f.retrieval_source")
