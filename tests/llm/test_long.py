"""Long and repetitive texts, comparisons with plain versions, and the pipeline on odd tables."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
from test_exact import brute_components, pairs_of

import corpus_pipeline
from tessera.llm import cdc, common, decontaminate, jaccard, mixing, page_text, secrets, sharding, toxicity


def texts_frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


# -- op2 ---------------------------------------------------------------------------------------------------------------


def plain_strength(text, model, folds):
    """Every entry sought at every place."""
    folded = toxicity.fold(text, folds)
    found, spared = {}, []
    for at in range(len(folded)):
        for entry, weight in model.lexicon.items():
            if folded.startswith(entry, at):
                found[at] = max(found.get(at, 0.0), weight)
        spared += [(at, at + len(p) - 1) for p in model.exceptions if folded.startswith(p, at)]
    total = sum(w for at, w in found.items() if not any(a <= at < b for a, b in spared))
    return np.log1p(1000 * total / (folded.count(" ") + 10)) if total else 0.0


def test_matches_equal_plain_search():
    rng = random.Random(2)
    model = toxicity.Model({" mor": 4.0, " moron ": 5.0, " idi": 3.5, " crap ": 6.0}, [" moron town ", " morning ", " idi amin "], 1.0, -1.0)
    folds, words = toxicity.Folds(), ["m0r0n", "town", "mörning", "idi", "amin", "IDIOT!", "cr@p", "сrap", "fine", "a", "more"]
    automaton = model.automaton()
    for n in [0, 1, 2, 3, 10, 60] * 8:
        text = " ".join(rng.choices(words, k=n))
        assert abs(toxicity.strength(text, automaton, folds) - plain_strength(text, model, folds)) < 1e-9


def test_many_matches_and_exceptions():
    model = toxicity.Model({" mor": 4.0}, [" moron town "], 1.0, -1.0)
    automaton, folds = model.automaton(), toxicity.Folds()
    began = time.time()
    assert toxicity.strength("moron town " * 100_000, automaton, folds) == 0.0
    assert toxicity.strength("moron town moron " * 60_000, automaton, folds) > 0
    assert time.time() - began < 20


# -- op3 ---------------------------------------------------------------------------------------------------------------


def test_secrets_long(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    texts = [" ".join(digest(i) for i in range(4000)), "\n".join(f"ünï password: {digest(i)[:9]}" for i in range(3000)), "Ab9xYz" * 50_000, "q" * 300_000, None]
    model = [0.0] * secrets.CLASSES**2
    began = time.time()
    got = {r["doc_id"]: r for r in secrets.scan(texts_frame(spark, texts), model, threshold=-1.0).collect()}
    assert time.time() - began < 90
    assert (got[0]["n_hex"], got[1]["n_assign"], got[2]["n_markov"], got[3]["spans"], got[4]["spans"]) == (4000, 3000, 1, "", "")
    assert got[0]["spans"] == ",".join(f"hex:{65 * i}:{65 * i + 64}" for i in range(4000))
    assert got[1]["spans"].startswith("assign:4:23,assign:28:47,")


def test_markov_ratio_equals_plain_sum(spark):
    rng = random.Random(3)
    samples = [("".join(rng.choices("abcdefXYZ0123456789", k=30)), 1) for _ in range(60)] + [(w, 0) for w in "ordinary names of things like configuration_value getUserName snake_case_name".split()]
    model = secrets.train(spark.createDataFrame(samples, "text string, label int"))
    code = lambda c: ord(c) - 86 if "a" <= c <= "z" else ord(c) - 47 if "0" <= c <= "9" else ord(c) - 28 if "A" <= c <= "Z" else 63
    words = ["abc", "X9y_Z", "a", "configuration", "q0Q0q0"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.ratio(__import__("pyspark").sql.functions.col("w"), model).alias("r"))
    for r in df.collect():
        steps = [0, *map(code, r["w"])]
        want = sum(model[a * secrets.CLASSES + b] for a, b in zip(steps, steps[1:])) / len(r["w"])
        assert abs(r["r"] - want) < 1e-9


def test_spans_touching_base_spans_are_no_markov_spans(spark):
    texts = ["xpassword=Ab9Xy7Qw3Rt5Zu1Kl0 tail", 'token: "Ab9Xy7Qw3Rt5Zu1Kl0Mn" Zx9Qw8Er7Ty6Ui5Op4As3', "deadbeefdeadbeefdeadbeefdeadXY01234567"]
    got = [r["spans"] for r in secrets.scan(texts_frame(spark, texts), [0.0] * secrets.CLASSES**2, threshold=-1.0).orderBy("doc_id").collect()]
    assert got == ["assign:1:28", "assign:0:28,markov:30:51", "hex:0:28"]


# -- op4 ---------------------------------------------------------------------------------------------------------------


def test_periodic_texts(spark):
    """Repeating words: every place matches every place."""
    bench = spark.createDataFrame([(1, "ha " * 3000), (2, "ho hi " * 9), (3, "la " * 4)], "item_id long, text string")
    docs = texts_frame(spark, ["ha " * 20_000, "ha " * 9 + "stop " + "ha " * 9, "ho hi " * 5000 + "la la la la", "la la la stop la la la la", ""])
    began = time.time()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert time.time() - began < 60
    assert got == {0: (20_000, 20_000, ["1"], [(0, 20_000)]), 1: (19, 0, [], []), 2: (10_004, 10_004, ["2", "3"], [(0, 10_004)]), 3: (8, 4, ["3"], [(4, 8)]), 4: (0, 0, [], [])}


# -- op5 ---------------------------------------------------------------------------------------------------------------


def test_jaccard_long_and_shared(spark, monkeypatch):
    """Sets on both sides of the bound up to which each shingle is a segment, families with common parts, exact copies."""
    monkeypatch.setattr(jaccard, "SINGLES", 64)
    monkeypatch.setattr(jaccard, "COMMON_LEAST", 3)
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 10**7)}"
    passage = [word() for _ in range(60)]
    rows, k = [], 0
    for size in (20, 60, 90, 140, 300, 700):
        base = [word() for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, size // 25 + 1)):
                w[rng.randrange(len(w))] = word()
            w = w[: len(w) - rng.randint(0, size // 6)] + passage[: rng.choice([0, 0, 20, 60])]
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(1000 + i, rows[i][1]) for i in range(0, len(rows), 9)] + [(2000 + i, " ".join(passage + [word() for _ in range(rng.randint(1, 30))])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert pairs_of(jaccard.near_duplicates(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_sets_with_equal_first_hash(spark, monkeypatch):
    """Different sets whose nodes collide are told apart by the other half of the hash."""
    plain = jaccard.set_hashes

    def same_node(tokens, docs):
        size, node, check = plain(tokens, docs)
        return size, node % np.uint64(3), check

    rows = [(k, f"some words number {k} and {k * 7} and {k * 11} more of them {k * 13}") for k in range(12)] + [(50, "some words number 3 and 21 and 33 more of them 39")]
    batches = list(jaccard._survey(5, 0.75)(iter([])))
    assert not batches
    monkeypatch.setattr(jaccard, "set_hashes", same_node)
    tokens = next(jaccard.token_sets(__import__("pyarrow").array([t for _, t in rows]), 5))[2]
    _, node, check = jaccard.set_hashes(tokens, len(rows))
    assert len(set(node.tolist())) == 3 and len(set(check.tolist())) == 12


# -- op7 ---------------------------------------------------------------------------------------------------------------


def test_markup_that_hides_nothing():
    main = lambda page: page_text.main_texts([page])[0]
    assert main('<p title="a hidden gem">Main text one</p>') == "Main text one"
    assert main('<div hidden><p>no</p></div><p data-hidden="1">yes</p>') == "yes"
    assert main('<p>teaser</p><article class="post" data-comment-count="4"><p>The article</p></article>') == "The article"
    assert main("<form action=x><p>Main text one</p><input><p>two</p></form>") == "Main text one\ntwo"
    assert main("<form><article><p>Main</p><form><p>mail</p></form></article></form>") == "Main"
    assert main("<article><p>it's 3 < 4 & 5 > 4<p title=don't>more</article>") == "it's 3 < 4 & 5 > 4\nmore"
    assert main('<p>one<p title="never closed>two<p>three') == "one\ntwo\nthree"
    assert main("<p>kept <a hre") == "kept"


def test_long_odd_markup():
    began = time.time()
    for page in ('<p title="abc>x ' * 30_000, "<p title='abc \"x " * 30_000, "<div>" * 50_000 + "x" + "</p>" * 50_000, "<a " + "b" * 500_000 + ">x", "<script " * 50_000, "<" * 300_000, "<!-- " * 50_000, "</b>" * 100_000 + "<b>" * 100_000):
        page_text.parse(page)
    assert time.time() - began < 40


def test_run_counts_equal_plain_counts():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(30)]
    texts += texts[:5]
    stream, content = page_text.Stream(texts), page_text.contents_of(texts)
    runs = [{tuple(t.split()[i : i + page_text.RUN]) for i in range(len(t.split()) - page_text.RUN + 1)} for t in texts]
    want = Counter(r for k, own in enumerate(runs) if k == texts.index(texts[k]) for r in own)
    flat = [tuple(t.split()[i : i + page_text.RUN]) for t in texts for i in range(len(t.split()) - page_text.RUN + 1)]
    assert stream.counts(content).tolist() == [want[r] for r in flat]
    assert len(set(stream.hashes().tolist())) == len(set(flat))


# -- op9, op10 ---------------------------------------------------------------------------------------------------------


def test_next_documents_over_gaps(spark):
    """Ids with an outlier: ranges are cut at counted quantiles, and every document meets its next."""
    rng = random.Random(6)
    ids = [*range(100), 5000, 10**15, 10**15 + 1]
    texts = {i: " ".join(f"t{rng.randint(0, 50)}" for _ in range(rng.randint(0, 120))) for i in ids}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in cdc.compare_with_next(df, rows_per_range=10).collect()}
    assert set(got) == set(ids)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        own, following = texts[a], texts[b]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        chunk = lambda t: cdc.chunks(t.encode())
        assert got[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[a]["fingerprint"] == cdc.fingerprint(chunk(own)) and got[a]["edited_fingerprint"] == cdc.fingerprint(chunk(edited))
        assert got[a]["near_edited"] == cdc.likeness(chunk(own), chunk(edited)) and got[a]["near_next"] == cdc.likeness(chunk(own), chunk(following))


def test_chunks_equal_plain_walk():
    """Boundaries as one byte after the other gives them."""
    rng = random.Random(9)
    for n in (0, 1, 24, 25, 100, 3000):
        data = bytes(rng.choices(range(256), k=n))
        out, start = [], 0
        while start < n:
            end = min(n, start + cdc.GREATEST)
            for at in range(start + cdc.LEAST, min(n, start + cdc.GREATEST) + 1):
                h = 0
                for byte in data[max(0, at - 32) : at]:
                    h = (2 * h + int(cdc.GEAR[byte])) % 2**32
                if h & int(cdc.STRICT if at < start + cdc.NORMAL else cdc.LOOSE) == 0:
                    end = at
                    break
            if n - start <= cdc.LEAST:
                end = n
            out.append(end)
            start = end
        assert cdc.cuts(cdc.gear(np.frombuffer(data, np.uint8))) == out


def test_shards_with_one_hub_over_half(spark):
    rows = [(k, "hot" if k % 5 < 3 else f"group {k % 200}" if k % 5 == 3 else f"alone {k}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df)
    counts = Counter(r["shard"] for r in got.collect())
    assert sorted(counts.values()) == [250] * 16
    links, cut = sharding.cut_links(got.select("text_crc32", "shard").where(got["text_crc32"] != 1446141936), "text_crc32").first()
    hot = got.groupBy("text_crc32").count().orderBy("count", ascending=False).first()
    rest = got.where(got["text_crc32"] != hot["text_crc32"])
    links, cut = sharding.cut_links(rest, "text_crc32").first()
    assert hot["count"] == 2400 and links == 800 and cut <= 0.05 * links


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_mixing_keeps_what_one_pass_takes(spark):
    rows = [(k if k % 50 else None, f"word{k} " * (k % 9), "en" if k % 3 else None, f"src{k % 12}" if k % 7 else None, k) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, leaf_last int")
    taken = {r["doc_id"] for r in mixing.mix_sources(df, share=(8, 10), epochs=1).where("take_tokens > 0").collect()} - {None}
    kept = mixing.keep_mixed(df, (8, 10))
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} - {None} == taken


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns with the names that the stages use inside."""
    near = [f"w{i}" for i in range(60)]
    rows = [(None, None, None, None, 1), (None, "", "en", "src1", 2), (1, " ".join(near), "en", "src1", 3), (1, " ".join(near), "en", "src1", 3), (2, " ".join(near[:58]), "de", "src2", 4), (3, "shared bench words one two three four five six seven eight", "en", "src1", 5)]
    rows += [(10 + k, f"document {k} tells its own story of {k * 31} things and {k * 17} others", "en", f"src{k % 20}", k) for k in range(30)]
    schema = "doc_id long, text string, lang string, source string, doc int"
    for name, some in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(some, schema).selectExpr("*", "doc AS `row`", "doc AS doc_key", "lang AS leaf_lang", "source AS shard_hint")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(k, 1, k % 2) for k in range(40)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "bench words one two three four five six seven eight nine")] if False else [(1, "shared bench words one two three four five six seven")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        frame = spark.read.parquet(f"{folder}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            before, frame = frame, common.materialize(stage(spark, frame, folder), "test")
            assert frame.columns == before.columns, stage_name
        out = corpus_pipeline.run(spark, folder).collect()
        assert len(out) == frame.count()
        ids = [r["doc_id"] for r in frame.collect()]
        assert ids.count(1) <= 1 and 2 not in ids and 3 not in ids
        assert len(ids) == 0 if not some else len(ids) > 15


def test_scratch_goes(spark):
    """Operators delete what nothing reads any more, drop_scratch() all the rest."""
    import glob

    df = texts_frame(spark, [f"some words of document {k} and a few more of {k}" for k in range(30)])
    kept = jaccard.keep_one_of_each(df).count()
    folder = common.scratch_folder(spark)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in glob.glob(folder.removeprefix("file://") + "/*")}
    assert kept == 30 and not left & {"members", "by-node", "places", "groups", "nodes", "star-tested"}
    common.drop_scratch(spark)
    assert not glob.glob(folder.removeprefix("file://") + "/*")


def test_components_odd(spark):
    from tessera.llm.components import components

    edges = [(1, 2), (2, 1), (2, 3), (3, 3), (9, 9), (None, 4), (7, 8), (7, 8)] + [(100, k) for k in range(101, 400)] + [(k, k + 1) for k in range(500, 530)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} | {k: 100 for k in range(100, 400)} | {k: 500 for k in range(500, 531)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
