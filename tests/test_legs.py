"""The keyword legs match inside tasks."""

import random

import pytest

from tessera.operators import search


@pytest.mark.parametrize("stems", [False, True])
def test_postings_are_not_shuffled(spark, stems):
    rng = random.Random(9)
    rows = [(k, k // 2, "recipe_full", [(rng.choice("abcdefg"), n + 1) for n in range(rng.randint(0, 20))]) for k in range(3000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_id long, chunk_type string, lexemes array<struct<lexeme:string,pos:int>>")
    terms = {1: ["a", "b"], 2: ["c"], 3: ["a", "f", "g"], 4: ["none", "a"], 5: []}
    asked = spark.createDataFrame(list(terms.items()), "query_id int, terms array<string>")
    leg = search.keyword_leg(chunks, asked, 8, 2) if stems else search.word_leg(chunks.selectExpr("*", "lexemes.lexeme AS words"), asked, 8, 2)
    want = []
    for q, ts in terms.items():
        found = []
        for c, _, _, lex in rows:
            places = {t: [p for w, p in lex if w == t] for t in ts}
            if ts and all(places.values()):
                found.append((-(search.cover_density(places) if stems else sum(map(len, places.values()))), c))
        want += [(q, c, k, round(-s, 9)) for k, (s, c) in enumerate(sorted(found)[:8], 1)]
    assert sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["raw_score"], 9)) for r in leg.collect()) == sorted(want)
    assert "Join" not in leg._jdf.queryExecution().optimizedPlan().toString()


def test_legs_make_no_pairs(spark, small):
    """The ranking by label and id joins places, not all later rows of a label."""
    from tessera.plans import queries

    keyword, _ = queries._legs(spark, small)
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "label").collect()
    want = []
    for q, label in rows:
        if q % 100 == 0:
            want += [(q, v, k) for k, v in enumerate(sorted(v for v, other in rows if other == label and v >= q)[:50], 1)]
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in keyword.collect()) == sorted(want)
    assert "Window" not in keyword._jdf.queryExecution().optimizedPlan().toString()
