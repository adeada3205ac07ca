"""A query of a retrieval report that found nothing it should."""

from tessera.plans import library  # noqa: F401
from tessera.plans.registry import QUERIES


def test_no_rank_is_no_sum(spark, tmp_path):
    rows = [(300, [1.0, 0.0], 1), *[(k, [1.0, k / 1e4], 3) for k in range(1, 60)], (1001, [-1.0, 0.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["retrieval_report"](spark, str(tmp_path)).collect()
    assert [(r["query_id"], r["n_expected"], r["n_found"], r["ranks"]) for r in out] == [(300, 1, 0, None)]
