import pytest
from compare import check

from tessera.plans import library, queries, stored  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, name):
    check(spark, small, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_texts(spark, tmp_path):
    """What comes after line 15, word 30 or 8000 bytes of a line is seen."""
    fine = [f"line {k} of a recipe with a few more words" for k in range(40)]
    blank = fine[:20] + [""] + fine[21:]
    long = "word " * 4000
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(90)]
    texts = {4: "\n".join(fine[:5]), 12: "\n".join(blank), 21: "\n".join(fine), 24: long, 27: " ".join(words)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    hard, soft = ({r["doc_id"]: r[1].split(",") for r in run(f"validate_{k}_whole")} for k in ("hard", "soft"))
    assert "blank_ingredient" in hard[12] and "blank_ingredient" not in hard[21]
    for i, text in texts.items():
        size = len(text.split("\n"))
        assert ("span_outside_window" in hard[i]) == (i % 7 > 5 or (i % 3 > 0 and size > 7))
        assert ("low_normalization_confidence" in soft[i]) == any((k + i) % 10 < 5 for k in range(0, size, 2))
    assert {r["doc_id"] for r in run("dedup_best_whole")} == set(texts)
    parts = sorted((r["part"], r["bytes"]) for r in run("chunk_lines") if r["doc_id"] == 24)
    assert len(parts) >= 3 and all(n <= 8000 for _, n in parts) and sum(n for _, n in parts) >= len(long.strip()) - len(parts)
    assert len([r for r in run("chunk_lines") if r["doc_id"] == 21]) == 40
    assert {r["doc_id"]: (r["precision"], r["recall"]) for r in run("prf_spans_whole")}[27] == (0.5, 0.5)
