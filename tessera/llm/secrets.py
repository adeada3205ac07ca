"""Secret scans by character Markov models, in DataFrame functions only.

Base patterns (assignments, access keys, hex strings) give the sure spans. For all other tokens of 16 or more characters that hold letters and digits, or
small letters around a capital, two Markov models of
character classes, one of random strings and one of ordinary identifiers, are compared: a token whose log-likelihood ratio per
transition is over the threshold is a span of kind "markov". The models are transition counts, trained from labelled samples
(text, label 1: random, 0: ordinary).

Results in odd cases: a null or empty text has no spans (the digest of the empty string); spans count code points, end
exclusive; a null doc_id is kept; repeated rows each get their row; samples without text or label are ignored; without
samples of both labels no markov spans are found; U+E000 in a text counts as a covered character, so no markov span holds it; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of letters and digits fails or passes as a whole
HEX = r"[0-9a-f]{24,}"
#: What the models judge, in a text whose base spans are covered by COVER.
COVER = "\ue000"
TOKEN = r"[A-Za-z0-9+/_=\x{E000}-]{16,}"
#: Matches that are walked through at once: what is found grows by so many.
BLOCK = 256
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

#: Classes of characters: each digit and letter is one of its own (case apart), all others one; 0 stands for the start.
CLASSES = 64
THRESHOLD = 0.35
#: Labelled samples of each label that the models use at most (those with the least hash).
SAMPLE = 20_000


def class_of(char: Column) -> Column:
    """1-10 digits, 11-36 small letters, 37-62 capitals, 63 others."""
    code = F.ascii(char)
    return F.when(code.between(97, 122), code - 86).when(code.between(48, 57), code - 47).when(code.between(65, 90), code - 28).otherwise(63)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def transitions(text: Column) -> Column:
    """Index of each step from one character to the next, in a table of CLASSES x CLASSES."""
    classes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), class_of)
    return let(classes, lambda own: F.zip_with(F.slice(F.concat(F.array(F.lit(0)), own), F.lit(1), F.size(own)), own, lambda a, b: a * CLASSES + b))


def _pieces(text: Column, pattern: str) -> Column:
    """What stands before each match, and the match (null for the last piece)."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, found: F.struct(gap.alias("gap"), found.alias("found")))


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, order, kind, found). Where they stand follows from the pieces
    between them; the pieces are taken in blocks, so that the work grows with the text and hardly with the number of matches."""
    none = F.array().cast("array<struct<start:int,end:int,order:int,kind:string,found:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["found"]), F.lit(0))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), x["found"].alias("found")))).alias("out"))

    def walk(pieces: Column) -> Column:
        block = lambda acc, k: let(F.aggregate(F.slice(pieces, k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), none.alias("out")), step), lambda got: F.struct(got["at"].alias("at"), F.concat(acc["out"], got["out"]).alias("out")))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda acc: acc["out"])

    # most texts have no match at all; the test is one pass and makes no copies
    out = F.when(text.rlike(pattern), F.filter(let(_pieces(text, pattern), walk), lambda s: s["found"].isNotNull())).otherwise(none)
    return F.filter(out, keep) if keep is not None else out


def covered(text: Column, pattern: str, keep=None) -> Column:
    """The text with COVER for each character of the matches."""
    fill = lambda found: F.coalesce(F.repeat(F.lit(COVER), F.length(found)), F.lit(""))
    one = lambda p: F.concat(p["gap"], fill(p["found"]) if keep is None else F.when(keep(p), fill(p["found"])).otherwise(F.coalesce(p["found"], F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(F.transform(_pieces(text, pattern), one), "")).otherwise(text)


def long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match["found"], ASSIGN, 2)) >= LEAST_VALUE


def base_spans(text: Column) -> list[Column]:
    return [spans(text, ASSIGN, "assign", long_value), spans(text, ACCESS, "access"), spans(text, HEX, "hex")]


def train(samples: DataFrame, text_col: str = "text", label_col: str = "label", limit: int = SAMPLE) -> list[float] | None:
    """Log-likelihood ratio of each transition (CLASSES x CLASSES numbers): random (label 1) against ordinary (label 0)."""
    rows = samples.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label")).where("text IS NOT NULL AND text <> '' AND label IN (0, 1)").distinct()
    order = [F.xxhash64("text"), "text"]
    rows = rows.where("label = 1").orderBy(*order).limit(limit).union(rows.where("label = 0").orderBy(*order).limit(limit))
    counts = rows.select("label", F.explode(transitions(F.col("text"))).alias("step")).groupBy("label", "step").count().collect()  # 2 * CLASSES**2 rows at most
    if {r["label"] for r in counts} != {0, 1}:
        return None
    table = {label: {r["step"]: r["count"] for r in counts if r["label"] == label} for label in (0, 1)}
    out = [0.0] * (CLASSES * CLASSES)
    for first in range(CLASSES):
        totals = [sum(table[label].get(first * CLASSES + k, 0) for k in range(CLASSES)) for label in (0, 1)]
        for k in range(1, CLASSES):
            p = [(table[label].get(first * CLASSES + k, 0) + 0.5) / (totals[label] + 0.5 * (CLASSES - 1)) for label in (0, 1)]
            out[first * CLASSES + k] = round(math.log(p[1] / p[0]), 4)
    return out


def ratio(text: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a text's transitions."""
    table = F.array(*[F.lit(x) for x in model])
    total = F.aggregate(transitions(text), F.lit(0.0), lambda acc, k: acc + F.element_at(table, k + 1))
    return total / F.greatest(F.length(text), F.lit(1))


def scan(docs: DataFrame, model: list[float] | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found (array of structs start, end, kind, text in the order of the spans) and the digest columns: one row for
    each row of docs. Markov spans do not overlap base spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    assign, access, hexes = base_spans(F.col("text"))
    rows = rows.select("doc_id", "text", assign.alias("assign"), access.alias("access"), hexes.alias("hex"))
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex"), _by_place))
    if model is None:
        rows = rows.withColumn("markov", F.slice("base", 1, 0))
    else:
        # what touches a base span is no span of its own
        rest = covered(covered(covered(F.col("text"), ASSIGN, long_value), ACCESS), HEX)
        rows = rows.withColumn("rest", F.when(F.size("base") > 0, rest).otherwise(F.col("text")))
        free = lambda s: ~s["found"].contains(COVER)
        # a random string mixes digits with letters or small letters with capitals
        mixed = lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]") | s["found"].rlike("[a-z][^a-z]*[A-Z][^A-Z]*[a-z]")
        rows = rows.withColumn("markov", spans(F.col("rest"), TOKEN, "markov", lambda s: mixed(s) & free(s) & (ratio(s["found"], model) >= threshold)))
    rows = rows.withColumn("found", F.array_sort(F.concat("base", "markov"), _by_place))
    listed = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"),
        F.size("markov").cast("long").alias("n_markov"), F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("text"))).alias("found"),
    )


def _by_place(a: Column, b: Column) -> Column:
    key = lambda s: s["start"].cast("long") * 8 + s["order"]
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def samples_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2_000) -> DataFrame:
    """Labelled samples where no others are given: of the `limit` documents with the least hash of doc_id the words that no
    base pattern touches are ordinary; random strings are cut from digests of a counter in the usual alphabets."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # ids first, and of these only the share of hashes that surely holds the least ones: no text goes through the one task that takes the first
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"))
    rows = docs.count()
    if rows > 4 * limit:
        ids = ids.where(F.xxhash64("doc") < F.lit(-(2**63) + 2**64 * 4 * limit // rows))
    ids = ids.distinct().orderBy(F.xxhash64("doc"), "doc").limit(limit)
    few = docs.select(F.col(id_col).alias("doc"), text.alias("text")).join(F.broadcast(ids), "doc")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = few.select(F.explode(F.regexp_extract_all(clean, F.lit(r"[A-Za-z][A-Za-z_.-]{5,}"), F.lit(0))).alias("word"))
    # ordinary identifiers come joined as well: snake case, camel case, with a short number, all capitals
    word = F.col("word")
    forms = F.array(word, F.concat(word, F.lit("_"), F.lower(F.reverse(F.substring(word, 1, 4)))), F.concat(word, F.initcap(F.substring(word, 1, 6))), F.upper(word), F.concat(word, F.lit("-20"), F.pmod(F.hash(word), F.lit(30)).cast("string")))
    ordinary = words.select(F.explode(forms).alias("text"), F.lit(0).alias("label"))
    n = F.col("id").cast("string")
    digest = F.sha2(n, 256)
    random = docs.sparkSession.range(4_000).select(F.explode(F.array(
        F.substring(digest, 1, 40), F.substring(F.base64(F.unhex(digest)), 1, 40), F.upper(F.substring(F.conv(F.substring(digest, 1, 14), 16, 36), 1, 16)),
        F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(n, F.lit("x")), 256))), "[+/=]", ""),
    )).alias("text"), F.lit(1).alias("label"))
    return ordinary.union(random)
