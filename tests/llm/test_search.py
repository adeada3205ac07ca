"""Vector tree, divergence audit and Block-Max search against brute force, on odd tables and small ones."""

import random
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.llm import block_max, divergence, vector_tree

# -- vector tree -------------------------------------------------------------------------------------------------------


def brute(rows, every=20, k=20):
    """rows: distinct (id, vector) -> {(query id, vector): [(id, score), ...]}."""
    out = {}
    for q, v in rows:
        if q % every == 0:
            found = [(i, float((np.asarray(w) * np.asarray(v)).sum())) for i, w in rows if (i, w) != (q, v)]
            out[q, v] = sorted(found, key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_vector_tree_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    hot = (0.5, -1.0, 2.0)
    rows = [(k, tuple(rng.normal(size=3).round(2).tolist())) for k in range(60)] + [(k, hot) for k in range(100, 190)] + [(20, hot)]
    odd = [(7, None), (8, (0.0, 0.0, 0.0)), (9, (1.0, None, 2.0)), (11, (1.0, float("nan"), 2.0)), (12, (1.0, float("inf"), 2.0)), (40, (1.0, 2.0)), (None, hot), (13, ())]
    again = [rows[0], rows[0], (120, hot)]
    table = spark.createDataFrame([(i, None if v is None else list(v), 1, "x") for i, v in [*rows, *odd, *again]], "vec_id long, embedding array<double>, one int, leaf string").repartition(3)
    got = {}
    for r in vector_tree.nearest_rows(table, target=1.0, leaf_rows=8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows)
    for q in {q for q, _ in want} - {20}:  # 20 stands on two rows: both ask
        (found,) = [v for (i, _), v in want.items() if i == q]
        assert [x[0] for x in got[q]] == list(range(1, 21))
        assert [(i, round(s, 12)) for _, i, s in got[q]] == [(i, round(s, 12)) for i, s in found]
    assert sorted(i for _, i, _ in got[20]) == sorted(i for (q, _), v in want.items() if q == 20 for i, _ in v)


def test_vector_tree_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert vector_tree.nearest_rows(spark.createDataFrame([], schema)).count() == 0
    assert vector_tree.nearest_rows(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    few = vector_tree.nearest_rows(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [-1.0, 0.0])], schema))
    assert [tuple(r) for r in few.orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]


def test_vector_tree_recall(spark):
    """Lengths differ, so the largest products are not the nearest points; leaves are small, so most are not visited."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    points = (centres[rng.integers(0, 40, 4000)] + rng.normal(scale=0.4, size=(4000, 16))) * rng.uniform(0.5, 2, size=(4000, 1))
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(4000), "embedding": points.tolist()}), "vec_id long, embedding array<double>")
    got = vector_tree.nearest_rows(table, leaf_rows=32).toPandas().groupby("query_id")["vec_id"].apply(set)
    scores = points[::20] @ points.T
    hits = 0
    for q, s in zip(range(0, 4000, 20), scores):
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (200 * 20) >= 0.9


def test_best_bins_visit_every_leaf_once():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(600, 5))
    tree = vector_tree.flatten(points.mean(axis=0), vector_tree.grow(points, 1.0, 2, rng, 8))
    order = list(vector_tree.best_bins(tree, points[0]))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 16
    assert order[0] == vector_tree.descend(tree, points[:1])[0]


def test_second_growth_of_large_cells(spark, monkeypatch):
    monkeypatch.setattr(vector_tree, "SAMPLE", 400)
    rng = np.random.default_rng(4)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(6000), "embedding": rng.normal(size=(6000, 4)).tolist()}), "vec_id long, embedding array<double>")
    _, distinct = vector_tree.distinct_vectors(table, 5, "vec_id", "embedding")
    index = vector_tree.build(distinct, 4)
    assert index.tree.leaves > 256 and index.rows.count() == 6000
    assert index.rows.agg({"leaf": "max"}).first()[0] < index.tree.leaves


# -- divergence --------------------------------------------------------------------------------------------------------


def audited(spark, rows, **settings):
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, n int, block int").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(table, **settings).collect())


def in_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return sorted(con.execute(sql).fetchall())


def odd_documents():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéß漢", k=rng.randint(1, 4))) for _ in range(80)] + ["ÀB", "Ab", "w" * 5000]
    rows = []
    for k in range(150):
        text = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        rows.append((k, rng.choice([text, text.upper(), text.replace(" ", "1\n")]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None])))
    rows += [(None, None, "xx", "only"), (7, "", "xx", "other"), (7, "alone alone", "yy", "one"), (7, "alone alone", "yy", "one"), (8, " ".join(rng.choices(words, k=60_000)), "en", "s1")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"slice_rows": 7, "blocks": 2, "top": 5}, {"slice_rows": 40, "blocks": 3, "min_docs": 1, "top": 3}])
def test_divergence_is_its_sql(spark, settings):
    rows = odd_documents()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    got = audited(spark, [(*r, "clash", 1, 2) for r in rows], **settings)
    assert got == in_sql(divergence.oracle(settings.get("min_docs", 3), settings.get("top", 200)), documents=frame)
    assert {(r[0], r[1]) for r in got if r[2] == "pair"} >= {("xx", "only"), ("", "")}


def test_divergence_of_nothing(spark):
    assert audited(spark, []) == []


def test_meetings_by_hand():
    rng = np.random.default_rng(6)
    for _ in range(200):
        size = int(rng.integers(1, 40))
        groups = []
        for _ in range(2):
            at = np.sort(rng.choice(size, rng.integers(0, size + 1), replace=False))
            groups.append((at, rng.integers(1, 10**9, len(at)), int(rng.integers(1, 10**6))))
        dense = [np.array([dict(zip(a.tolist(), p.tolist())).get(t, p0) for t in range(size)]) for a, p, p0 in groups]
        want = tuple(sum((int(x) - int(y)) ** 2 // int(y) for x, y in zip(*pair)) for pair in (dense, dense[::-1]))
        packed = [(*divergence.unpack(divergence.pack(a, p)), p0) for a, p, p0 in groups]
        assert divergence.both_ways(size, *packed) == want


# -- Block-Max search --------------------------------------------------------------------------------------------------


def test_numbers_survive():
    rng = np.random.default_rng(7)
    values = np.concatenate([np.arange(300), rng.integers(0, 2**40, 500), [127, 128, 16383, 16384, 0]])
    data, at = block_max.encode(values)
    assert (block_max.decode(data) == values).all() and at[-1] == len(data)
    assert len(block_max.decode(data[:0])) == 0


def test_competitive_pairs_bound_every_posting():
    rng = np.random.default_rng(8)
    block, counts, lengths = np.repeat(np.arange(20), 30), rng.integers(1, 6, 600), rng.integers(1, 50, 600)
    kept = block_max.competitive(block, counts, lengths)
    assert len(kept) < 200 and sorted(set(block[kept].tolist())) == list(range(20))
    for b, c, n in zip(block, counts, lengths):
        assert any(counts[k] >= c and lengths[k] <= n for k in kept if block[k] == b)


def postings_of(docs, counts, lengths, weight, damp):
    """A list as a shard stores it."""
    heads = np.arange(0, len(docs), block_max.BLOCK)
    block = np.arange(len(docs)) // block_max.BLOCK
    gaps = np.diff(docs, prepend=0)
    gaps[heads] = docs[heads]
    data, at = block_max.encode(np.stack([gaps, counts], axis=1).ravel())
    pairs = block_max.competitive(block, counts, lengths[docs])
    row = SimpleNamespace(lasts=docs[np.append(heads[1:], len(docs)) - 1], starts=at[2 * heads], pairs=np.bincount(block[pairs]), counts=counts[pairs], lengths=lengths[docs[pairs]], data=data.tobytes(), n_docs=len(docs))
    return block_max.Postings(row, weight, damp, lambda x: 10 + x)


def test_blocks_below_the_threshold_stay_compressed():
    rng = np.random.default_rng(9)
    n = 8000
    lengths = rng.integers(5, 500, n)
    damp, ids = 10 + lengths, rng.permutation(n)
    skipped = 0
    for _ in range(10):
        lists, scores = [], np.zeros(n, np.int64)
        for share, weight in ((0.5, 300), (0.2, 900), (0.02, 4000)):
            docs = np.flatnonzero(rng.random(n) < share)
            counts = np.where(docs % 4000 < 600, np.minimum(rng.geometric(0.2, len(docs)), 30), 1)
            lists.append(postings_of(docs, counts, lengths, weight, damp))
            scores[docs] += weight * block_max.impact(counts, damp[docs])
        got, won = block_max.top_documents(lists, ids, 10, 0)
        order = np.lexsort((ids, -scores))[:10]
        assert got.tolist() == ids[order].tolist() and won.tolist() == scores[order].tolist()
        floor = int(won[-1])
        again = block_max.top_documents(lists, ids, 10, floor)
        assert again[0].tolist() == got.tolist()
        skipped += sum(int((~x.known).sum()) for x in lists)
    assert skipped > 0


def ranked(spark, docs, items):
    table = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, term string, shard int").repartition(5)
    bench = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, no int")
    return sorted((tuple(r) for r in block_max.rank_documents(block_max.build_index(table), bench).collect()), key=repr)


def test_ranking_is_its_sql(spark):
    rng = random.Random(10)
    words = ["".join(rng.choices("ab1é漢", k=rng.randint(1, 3))) for _ in range(60)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40))).upper()) for k in range(300)] + [(400, None), (401, ""), (402, "?! --"), (403, " ".join(rng.choices(words, k=50_000))), (None, "a b 1")]
    items = [(1, "A b 1 é"), (2, None), (3, "nowhere"), (4, "a_b"), (4, "1-É"), (None, "a 1"), (5, " ".join(words))]
    want = in_sql_ranked(docs, items)
    got = ranked(spark, docs, items)
    assert [r for r in got] == want
    assert {r[0] for r in got} == {1, 4, 5, None}


def in_sql_ranked(docs, items):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    return sorted(con.execute(block_max.ORACLE).fetchall(), key=repr)


def test_equal_documents_and_nothing(spark):
    same = ranked(spark, [(k, "red green") for k in range(40, 0, -1)] + [(3, "red green")], [(1, "green")])
    assert [(r[1], r[2]) for r in sorted(same, key=lambda r: r[1])] == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (6, 5), (7, 6), (8, 7), (9, 8), (10, 9)]
    assert ranked(spark, [], [(1, "green")]) == [] and ranked(spark, [(1, "green")], []) == []


def test_many_items_are_joined(spark, monkeypatch):
    """More items than are sent to all tasks, in several parts: the same rows."""
    docs = [(k, f"w{k % 7} w{k % 5} common") for k in range(60)]
    items = [(k, f"w{k % 9} common") for k in range(40)]
    few = ranked(spark, docs, items)
    monkeypatch.setattr(block_max, "SENT", 0)
    monkeypatch.setattr(block_max, "ITEMS", 8)
    assert ranked(spark, docs, items) == few and len(few) == 400
