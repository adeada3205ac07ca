"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digits and signs that stand for letters) and matched by Aho-Corasick against
word beginnings and whole words with weights; a match inside an exception phrase doesn't count. The sum of weights,
normalised by the number of words, goes through a logistic curve.

Lexicon, exceptions and curve are fitted on labelled documents, at most SAMPLE of each class (those with the least hash of
doc_id; of texts that fold alike one of each class), so the model has a fixed bound at any size of input; every text is scored whole.

Results in odd cases: a null or empty text scores as one without any match; rows without a label are only scored; labels that
are null or neither 0 nor 1 are ignored; a document that is labelled both 0 and 1 is an example of either; without labels of both classes the lexicon is empty and all scores are 0; repeated rows
each get their row; a null doc_id counts as text "" and is never used for fitting; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

#: Most labelled documents of each class that the fit uses.
SAMPLE = 12_000
#: Words of a learned exception at most.
PHRASE = 3
PREFIXES = (3, 4, 5, 6)
#: An entry is in so many toxic documents at least and has this weight; so many entries may get in by chance.
LEAST_DOCS, LEAST_WEIGHT, BY_CHANCE = 3, 3.5, 0.05

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe",
}
# Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t"}
_OTHER = re.compile(r"[^a-z]+")
_LETTER = re.compile(r"[^\W\d_]")
_EDGE = "!|+$€@.,;:?\"'()[]{}<>*#%&~`^-_=/\\"


def fold_word(word: str) -> str:
    """Latin letters in lower case; parts that stay apart are separated by spaces."""
    if word.isascii() and word.isalpha():
        return word.lower()
    low = "".join([HOMOGLYPHS.get(c, c) for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)])
    low = low.strip(_EDGE.replace("$", "").replace("@", "")).rstrip("$@") if not low.isalpha() else low
    if not low.isalpha() and _LETTER.search(low):
        low = "".join([SUBSTITUTES.get(c, c) for c in low])
    return _OTHER.sub(" ", low).strip()


class Folds(dict):
    """Folded words by word; forgets all when full."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = fold_word(word)
        return out


def fold(text: str, folds: Folds) -> str:
    """Folded words with one space before and after each."""
    return f" {' '.join(filter(None, map(folds.__getitem__, text.split())))} "


def split_row(id_col: str = "doc_id") -> Column:
    """Whether a document is held out from fitting."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)  # " stem" or " word " -> weight
    exceptions: list[str] = field(default_factory=list)  # " phrase "
    slope: float = 0.0
    bias: float = -math.inf

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.lexicon:
            return None
        out = ahocorasick.Automaton()
        for text, weight in self.lexicon.items():
            out.add_word(text, (len(text), weight))
        for text in self.exceptions:
            out.add_word(text, (len(text), None))
        out.make_automaton()
        return out

    def score(self, strength: np.ndarray) -> np.ndarray:
        if self.bias == -math.inf:
            return np.zeros(len(strength))
        return 1 / (1 + np.exp(-np.clip(self.slope * strength + self.bias, -40, 40)))


def unspared(found: dict[int, float], spared: list[tuple[int, int]]) -> float:
    """The weights of the matches that begin in no spared range: one walk over both in order."""
    if not spared:
        return sum([found[at] for at in sorted(found)])
    spared.sort()
    total, k, reach = 0.0, 0, -1
    for at in sorted(found):
        while k < len(spared) and spared[k][0] <= at:
            reach = max(reach, spared[k][1])
            k += 1
        if at >= reach:
            total += found[at]
    return total


def strength(text: str, automaton, folds: Folds) -> float:
    """Weights of the matches per 1000 words, as a logarithm. Of matches that begin at one word the heaviest counts."""
    folded = fold(text, folds)
    if automaton is None:
        return 0.0
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > found.get(start, 0.0):
            found[start] = weight
    total = unspared(found, spared)
    return math.log1p(1000 * total / (folded.count(" ") + 10)) if total else 0.0


def _folded_hash(batches):
    """Adds the hash of the whole folded text."""
    folds = Folds()
    for batch in batches:
        digests = [hashlib.blake2b(fold(t, folds).encode(), digest_size=16).digest() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=["doc", "text", "toxic", "folded"])


def _features(batches):
    """Labelled texts -> (feature, toxic documents, clean documents), counted per batch."""
    folds = Folds()
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(fold(text, folds).split())
            own = {f" {w} " for w in words}
            for k in PREFIXES:
                own.update([f" {w[:k]}" for w in words if len(w) > k])
            counts[1 - toxic].update(own)
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["feature", "toxic", "clean"])


def _around(lexicon: dict[str, float]):
    """Labelled texts -> (phrase of up to PHRASE words around a match of the lexicon, toxic documents, clean documents)."""

    def matches(word: str) -> bool:
        return f" {word} " in lexicon or any(f" {word[:k]}" in lexicon for k in PREFIXES if len(word) >= k)

    def run(batches):
        folds = Folds()
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = fold(text, folds).split()
                own = set()
                for at in [k for k, w in enumerate(words) if matches(w)]:
                    for n in range(1, PHRASE + 1):
                        own.update([f" {' '.join(words[a : a + n])} " for a in range(max(0, at - n + 1), min(at, len(words) - n) + 1)])
                counts[1 - toxic].update(own)
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["feature", "toxic", "clean"])

    return run


def surprise(n_toxic: int, n_clean: int) -> Column:
    """Half the log-likelihood ratio of a feature's toxic and clean documents against equal shares; exp(-it) bounds the chance about."""
    share = n_toxic / (n_toxic + n_clean)
    part = lambda k, want: F.when(F.col(k) > 0, F.col(k) * F.ln(F.col(k) / ((F.col("toxic") + F.col("clean")) * want))).otherwise(0.0)
    return part("toxic", share) + part("clean", 1 - share)


def _lexicon(found: list, n_toxic: int, n_clean: int) -> dict[str, float]:
    """A whole word or longer beginning stands for the shorter ones that it nearly always follows; otherwise the shorter one
    stands for all that follow it."""
    weigh = lambda t, c: math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    known = {f: (t, w) for f, t, c in found if (w := weigh(t, c)) >= LEAST_WEIGHT}
    shorter = {f: [f[:k] for k in range(4, len(f)) if f[:k] in known] for f in known}
    most = Counter()
    for f, stems in shorter.items():
        for stem in stems:
            most[stem] = max(most[stem], known[f][0])
    out: dict[str, float] = {}
    for f in sorted(known, key=lambda f: (len(f.strip()), f)):
        toxic, weight = known[f]
        if most[f] < 0.9 * toxic and not any(s in out and out[s] >= weight - 0.7 for s in shorter[f]):
            out[f] = weight
    return out


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve with a small penalty."""
    slope, bias = 1.0, -1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * x + bias, -30, 30)))
        g = np.array([np.sum((p - y) * x) + 0.05 * slope, np.sum(p - y) + 0.01 * bias])
        v = p * (1 - p)
        h = np.array([[np.sum(v * x * x) + 0.05, np.sum(v * x)], [np.sum(v * x), np.sum(v) + 0.01]])
        step = np.linalg.solve(h, g)
        slope, bias = slope - np.clip(step[0], -1, 1), bias - np.clip(step[1], -1, 1)
    return float(slope), float(bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, phrases: list[str] = (), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """phrases: further exception phrases, all of which are kept."""
    marked = labels.select(F.col("doc_id").alias("doc"), F.col("toxic").cast("int").alias("toxic")).where("doc IS NOT NULL AND toxic IN (0, 1)").where(~split_row("doc")).distinct()
    order = [F.xxhash64("doc"), "doc"]
    taken = marked.where("toxic = 1").orderBy(*order).limit(sample).union(marked.where("toxic = 0").orderBy(*order).limit(sample))
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # at most 2 * sample rows
    taken = materialize(taken, "labels")
    known = texts.join(F.broadcast(taken), "doc").select(F.col("doc").cast("string").alias("doc"), "text", "toxic")
    known = known.mapInArrow(_folded_hash, "doc string, text string, toxic int, folded binary")
    # copies count once, by the one of the least doc_id
    least = F.min(F.struct(F.length("doc").alias("size"), "doc", "text")).alias("least")
    known = materialize(known.groupBy("toxic", "folded").agg(least).select("least.text", "toxic"), "labelled")
    discard(taken)
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model()
    counts = known.mapInArrow(_features, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    bound = math.exp(LEAST_WEIGHT) * sizes[1] / sizes[0]
    tried = materialize(counts.where(F.col("toxic") >= LEAST_DOCS), "features")
    least = math.log(max(1, tried.count()) / BY_CHANCE)
    # words of at most 2 * sample texts, and of these only the significant ones
    found = tried.where((F.col("toxic") >= bound * F.col("clean") * 0.5) & (surprise(sizes[1], sizes[0]) >= least)).collect()
    discard(tried)
    model = Model(_lexicon([tuple(r) for r in found], sizes[1], sizes[0]))
    if not model.lexicon:
        return Model()
    # exceptions: words under a stem and phrases around matches that clean documents use as much as toxic ones
    around = known.mapInArrow(_around(model.lexicon), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    usual = around.where((F.col("clean") >= 2) & (F.col("clean") * sizes[1] >= F.col("toxic") * sizes[0])).orderBy(F.length(F.regexp_replace("feature", "[^ ]", "")), F.desc("clean"), "feature").collect()
    learned: set[str] = set()
    for text in (r[0] for r in usual):  # a part stands for the phrases that hold it
        words = text.split()
        parts = (f" {' '.join(words[i:j])} " for i in range(len(words)) for j in range(i + 1, len(words) + 1) if j - i < len(words))
        if text not in model.lexicon and learned.isdisjoint(parts):
            learned.add(text)
    folds = Folds()
    model.exceptions = sorted({*learned, *(fold(p, folds) for p in phrases)} - model.lexicon.keys() - {"  "})
    scored = known.mapInArrow(_strengths(model, ["toxic"]), "toxic int, strength double").toPandas()
    discard(known)
    model.slope, model.bias = _curve(scored["strength"].to_numpy(), scored["toxic"].to_numpy())
    return model


def _strengths(model: Model, keep: list[str], text_col: str = "text"):
    """Adds `strength` to the kept columns."""

    def run(batches):
        automaton, folds = model.automaton(), Folds()
        for batch in batches:
            out = [strength(t or "", automaton, folds) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.array(out, pa.float64())], names=[*keep, "strength"])

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), split_row(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_strengths(model, ["doc_id", "held_out"]), f"doc_id {kind}, held_out boolean, strength double")
    if model.bias == -math.inf:
        score = F.lit(0.0)
    else:
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(model.slope) * F.col("strength") + F.lit(model.bias)))))
    return out.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under 0.5."""
    if not model.lexicon:
        return docs

    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        automaton, folds = model.automaton(), Folds()
        for batch in batches:
            found = np.array([strength(t or "", automaton, folds) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(model.score(found) < 0.5))

    return docs.mapInArrow(run, schema)
