import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog
from tessera.sources import files
from tessera.streaming import events


def test_pages_and_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-one page with enough text\f\fshort")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-one page with enough text\f\fshort")
    (tmp_path / "c.pdf").write_bytes(b"plain text")
    rows = files.read_binary(spark, str(tmp_path), "*.pdf")
    pages = files.read_pages(rows.where(F.col("path").endswith("a.pdf"))).orderBy("page").collect()
    assert [(p["page"], p["confidence"]) for p in pages] == [(1, None), (2, 0.0), (3, 0.0)]
    rows = rows.select("path", "content").union(spark.createDataFrame([("/x/empty.pdf", bytearray())], "path string, content binary"))  # Spark lists no empty files
    got = {r["title"]: r["status"] for r in catalog.classify_uploads(rows, spark.createDataFrame([("x",)], "content_hash string")).collect()}
    assert got == {"a": "created", "b": "duplicate", "c": "error", "empty": "error"}


def test_tsv_and_fixtures(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("# comment\nq1\tsoup\n\nq2\tbread\n")
    (tmp_path / "bad.tsv").write_text("q1\tsoup\textra\n")
    queries = files.read_tsv(spark, str(tmp_path / "q.tsv"), ["query_id", "query_text"])
    assert sorted(r["query_id"] for r in queries.collect()) == ["q1", "q2"]
    with pytest.raises(Exception, match="expected 2 columns"):
        files.read_tsv(spark, str(tmp_path / "bad.tsv"), ["query_id", "query_text"]).collect()
    with pytest.raises(ValueError, match="no judgement"):
        files.check_fixtures(queries, spark.createDataFrame([("q1", "i", 1)], "query_id string, item_id string, relevance int"))


def test_ranges_and_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"set": "s", "books": {"b": [{"pages": [2, 3], "name": "x"}]}}')
    pages = spark.createDataFrame([("b", k, f"p{k}") for k in range(1, 5)], "book string, page int, text string")
    assert files.cut_ranges(pages, files.read_ranges(spark, str(tmp_path / "r.json"))).first()["text"] == "p2\n\np3"
    report = files.write_report(pages, str(tmp_path / "reports"), "one")
    files.save_baseline(spark, report, str(tmp_path / "base"))
    assert spark.read.json(str(tmp_path / "base")).count() == 4
    failed = files.write_report(pages, str(tmp_path / "reports"), "two", "failed")
    with pytest.raises(ValueError):
        files.save_baseline(spark, failed, str(tmp_path / "base2"))


def test_prompt_version(spark):
    df = spark.createDataFrame([("name: x\nversion: v3 \n\nversion: v9",), ("no header\n\nversion: v1",)], "t string")
    assert [r[0] for r in df.select(files.prompt_version(F.col("t"))).collect()] == ["v3", None]


def test_streams(spark, small, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    rows = events.read_events(spark, str(tmp_path / "in"))
    counts = events.run_to_memory(events.tumbling_counts(rows), "tumbling", "append", str(tmp_path / "c1"))
    closed = {(r["start"], r["event_type"]): r["n"] for r in counts.collect()}
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), "event_type").count()
    want = {(r["h"], r["event_type"]): r["count"] for r in batch.collect()}
    assert closed and all(want[k] == n for k, n in closed.items())
    assert events.run_to_memory(events.once(rows, ["event_id"]), "once", "append", str(tmp_path / "c2")).count() == len({r[0] for r in spark.read.parquet(str(tmp_path / "in")).select("event_id").collect()})
    states = events.run_to_memory(events.lifecycle(rows), "states", "update", str(tmp_path / "c3"))
    assert states.groupBy("document_id").agg(F.max("steps").alias("n")).agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "in")).count()


def test_paged_source(spark, tmp_path):
    from tessera.sources import paged

    (tmp_path / "books").mkdir()
    texts = {"a.txt": [f"page {k} " + "é" * (k % 50) for k in range(1, 400)], "b.txt": [""], "c.txt": ["one", "", "three"], "d.bin": ["other"]}
    for name, pages in texts.items():
        (tmp_path / "books" / name).write_text("\f".join(pages))
    paged.register(spark)
    whole = spark.read.format("pages").option("pathGlobFilter", "*.txt").option("partBytes", 1000).load(str(tmp_path / "books"))
    want = sorted((name, k + 1, t) for name, pages in texts.items() if name != "d.bin" for k, t in enumerate(pages))
    got = [(r["path"].rsplit("/", 1)[1], r["page"], r["text"]) for r in whole.collect()]
    assert sorted(got) == want and whole.rdd.getNumPartitions() > 15
    some = whole.where((F.col("page") > 2) & (F.col("page") <= 5) & (F.col("path") == f"{tmp_path}/books/a.txt"))
    assert sorted(r["page"] for r in some.collect()) == [3, 4, 5]
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0] or some.rdd.getNumPartitions() < whole.rdd.getNumPartitions()
    reader = paged.PageReader({"path": str(tmp_path / "books"), "partbytes": "1000"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan, StringContains

    left = list(reader.pushFilters([EqualTo(("path",), f"{tmp_path}/books/c.txt"), GreaterThan(("page",), 1), LessThan(("page",), 3), StringContains(("text",), "x")]))
    assert len(left) == 1 and [(p.least, p.most) for p in reader.partitions()] == [(2, 2)]
    lone = spark.read.format("pages").load(str(tmp_path / "books" / "c.txt"))
    assert lone.count() == 3


@pytest.mark.parametrize("step", [1, 2, 5, 1000])
def test_pages_of_ranges(step, monkeypatch):
    import io

    from tessera.sources import paged

    monkeypatch.setattr(paged, "STEP", 7)
    for data in (b"", b"\f", b"ab\fcd\f\fe", b"abc", b"\fx", b"\f\f", b"a\f" * 20 + b"end"):
        want = list(enumerate(data.split(b"\f"), 1))
        cuts = [(k, k + step if k + step < len(data) else len(data) + 1) for k in range(0, max(1, len(data)), step)]
        assert [x for a, b in cuts for x in paged.pages_in(io.BytesIO(data), a, b, 10**9)] == want
        assert [x for a, b in cuts for x in paged.pages_in(io.BytesIO(data), a, b, 2)] == want[:2]
