"""Toxicity, page text, mixing and the pipeline."""

import zlib
from collections import defaultdict

import pytest

from tessera.llm import line_dedup, mixing, page_text, toxicity
from tessera.llm.components import components


def test_folding():
    got = [toxicity.fold_word(w) for w in ("1d10t", "idіot!", "$cum", "tr4sh.", "VEQUÉ,", "233.12", "a-b")]
    assert got == ["idiot", "idiot", "scum", "trash", "veque", "", "a b"]


@pytest.fixture(scope="module")
def model(spark):
    path = "/root/testdata/sf0.01"
    return toxicity.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    path = "/root/testdata/sf0.01"
    scored = toxicity.score_documents(spark.read.parquet(f"{path}/documents.parquet"), model).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").toPandas()
    assert (scored.held_out == scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = scored[scored.held_out]
    assert (held.predicted == held.toxic).mean() > 0.94 and not ((held.predicted == 1) & (held.toxic == 0)).any()


def test_toxicity_odd(spark, model):
    clean = "the report was written by a team of people who like long walks " * 3
    rows = [(1, None), (2, ""), (3, clean), (4, clean + " you 1d10t and scуm, w0rthless tr4sh loser"), (4, clean), (None, "idiot " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS strength", "2 AS label")
    got = sorted(((r["doc_id"] or 0, r["predicted"]) for r in toxicity.score_documents(df, model).collect()))
    assert got == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0), (4, 1)]
    assert toxicity.drop_toxic(df, model).columns == df.columns and toxicity.drop_toxic(df, model).count() == 4
    assert toxicity.score_documents(df.limit(0), model).count() == 0
    spared = toxicity.Model(model.lexicon, [" moron town "], model.slope, model.bias)
    automaton, folds = spared.automaton(), toxicity.Folds()
    assert toxicity.strength("in moron town", automaton, folds) == 0 < toxicity.strength("in moron villages", automaton, folds)


def labelled(spark, texts):
    """Documents (text, toxic) outside the held-out part, and their labels."""
    ids = [i for i in range(2 * len(texts) + 50) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
    rows = [(i, *t) for i, t in zip(ids, texts)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "doc_id long, quality int, toxic int")


def test_shared_opening(spark):
    """Texts that only begin alike are examples of their own; copies are not."""
    banner = "this mail was sent to all members of the long list of our fine club: "
    texts = [(f"{banner} item{k} grobnik here", 1) for k in range(60)] + [(f"{banner} item{k} pleasant here", 0) for k in range(60)]
    assert any(f.startswith(" grob") for f in toxicity.fit(*labelled(spark, texts)).lexicon)
    texts = [(f"{banner} GROBNIK  here" if k % 2 else f"{banner} grobnik here", 1) for k in range(60)] + texts[60:]
    assert not toxicity.fit(*labelled(spark, texts)).lexicon


def test_rare_terms(spark):
    """A term of one toxic document in a hundred is learned; words that fall into toxic texts by chance are not."""
    texts = [(f"story {k} tells of zone{k} " + ("grobnik" if k % 100 == 7 else "vexlump"), 1) for k in range(2000)] + [(f"story {k} tells of zone{k} pleasant", 0) for k in range(2000)]
    found = toxicity.fit(*labelled(spark, texts)).lexicon
    assert any(f.startswith(" grob") for f in found) and any(f.startswith(" vex") for f in found)
    assert not any(f.startswith((" zon", " sto", " tel")) for f in found)


def test_learned_phrases(spark):
    """A phrase that is usual in clean documents spares the lexicon's word in it; callers' phrases are never cut."""
    texts = [(f"person{k} is a moron indeed", 1) for k in range(300)] + [(f"person{k} lives near moron town today" if k < 3 else f"person{k} lives near pleasant hills", 0) for k in range(300)]
    own = [f"phrase number {chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    found = toxicity.fit(*labelled(spark, texts), phrases=own)
    automaton, folds = found.automaton(), toxicity.Folds()
    assert toxicity.strength("they like moron town", automaton, folds) == 0 < toxicity.strength("a moron indeed", automaton, folds)
    assert {f" {p} " for p in own} <= set(found.exceptions)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    bare = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["score"] for r in toxicity.score_documents(docs, bare).collect()] == [0.0]


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div>{main}<aside>more</aside><form><input><p>mail</p></form><footer>&copy; us</footer>"""


def test_pages_with_markup():
    main = "<article><header><h1>Head &amp; line</h1></header><p>One  <b>bold</b>\n text<br>here<p>Two<ul><li>a<li>b</ul><div class=ad>buy</div><section id='comments'><p>no</p></section></article>"
    assert page_text.main_texts([PAGE.format(main=main), "", "<p>only", "<script>var x='<p>no</p>'"]) == ["Head & line\nOne bold text here\nTwo\na\nb", "", "only", ""]


def test_host_boilerplate():
    shared = "read all about the terms of this fine site and its many partners"
    pages = [f"<body><div>{shared}</div><div>Story number {k} tells of {k * 7} distinct things {k * 13} in town {k * 17}</div></body>" for k in range(6)]
    got = page_text.main_texts(pages)
    assert all(shared not in t and t.startswith("Story number") for t in got)
    assert page_text.main_texts(pages[:1] * 6)[0].startswith(shared)  # copies are no evidence


def test_pages_odd(spark):
    rows = [(1, "https://a.example/x", "<p>x"), (1, "https://a.example/x", "<p>x"), (2, None, None), (None, "bad url", ""), (3, "http://user@B.example:80/", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS host", "1 AS part", "2 AS text")
    got = sorted(((r["page_id"] or 0, r["text"][:4], r["n_chars"]) for r in page_text.extract_pages(df).collect()))
    assert got == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0), (3, "word", 249_999)]
    assert page_text.extract_pages(df.limit(0)).count() == 0


def test_host_in_parts(spark, monkeypatch):
    """A large host gives each page the text that it has when all pages of the host are seen at once."""
    monkeypatch.setattr(page_text, "PART_BYTES", 400)
    notice = "this notice stands on very few pages of the large site only"
    motto = "half of all articles repeat this long motto of the house"
    rows = []
    for k in range(60):
        own = f"Story number {k} tells of {k * 7} distinct things {k * 13} in town {k * 17}"
        note = f"<div>{notice}</div>" if k % 15 == 0 else ""
        body = f"<article><p>{motto}</p><p>{own}</p></article>" if k % 5 and k < 45 else f"<div>{own}</div>" + note
        rows.append((k, f"https://big.example/{k}", body))
    rows += [(100 + k, f"https://big.example/c{k}", "<div>all of these copies say the same few words again</div>") for k in range(20)]
    rows += [(200, "https://small.example/", f"<div>{notice}</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in page_text.extract_pages(df).collect()}
    want = page_text.main_texts([r[2] for r in rows[:-1]])
    assert got == dict(zip([r[0] for r in rows], [*want, notice]))
    assert not any(notice in t for t in want) and want[-1].startswith("all of these")


def brute_fill(nodes, budget):
    """nodes: name -> (cap, weight). Rounds of proportional shares until no node is over its cap."""
    left, out, budget = dict(nodes), {}, min(budget, sum(c for c, _ in nodes.values()))
    while True:
        total = sum(w for _, w in left.values())
        full = {k for k, (c, w) in left.items() if c * total <= w * budget}
        if not full:
            return out | {k: w * budget / total for k, (c, w) in left.items()}
        for k in full:
            out[k] = left.pop(k)[0]
            budget -= out[k]


def test_budgets_and_prefixes(spark):
    rows = [(k, " ".join(["w"] * (k % 9)), None if k % 10 == 0 else "en" if k % 4 else "de", "src0" if k % 3 else f"src{k % 12}") for k in range(400)] + [(None, "a b", "en", "src0"), (5, "x x x x x", "en", "src0"), (7, None, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS domain", "2 AS n_tokens")
    got = mixing.mix_sources(df, epochs=2, share=(9, 10)).toPandas()
    assert len(got) == len(rows)
    total = int(got.n_tokens.sum())
    assert int(got.take_tokens.sum()) == total * 9 // 10
    caps = got.groupby("domain").n_tokens.sum() * 2
    want = brute_fill({d: (int(c), mixing.WEIGHTS["domain"][d]) for d, c in caps.items()}, total * 9 // 10)
    for d, n in got.groupby("domain").take_tokens.sum().items():
        assert abs(n - want[d]) <= 1
    assert (got.take_tokens <= 2 * got.n_tokens).all()
    assert mixing.mix_sources(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"lang": df["lang"]}, {"lang": {"en": 0}}).count()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (5, 5)] + [(100 + k, 101 + k) for k in range(40)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r["root"]].add(r["node"])
    assert dict(got) == {1: {1, 2, 3, 4}, 10: {10, 11}, 100: set(range(100, 141))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_perfect_hash():
    import numpy as np

    rng = np.random.default_rng(0)
    hi, lo = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    bits, sizes = line_dedup.build_perfect_hash(hi, lo)
    assert sorted(line_dedup.slots(bits, sizes, hi, lo)) == list(range(20_000))


def test_pipeline(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    from test_exact import brute_components

    stage = dict(P.STAGES)
    kept = stage["near_duplicates"](spark, docs, small)
    assert kept.columns == docs.columns
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in want}
    clean = stage["decontamination"](spark, docs, small)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    mixed = stage["mixing"](spark, docs, small)
    assert mixed.columns == docs.columns and 0.7 * docs.count() < mixed.count() < docs.count()
    out = P.run(spark, small)
    assert 0 < out.count() <= kept.count() and out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
