"""Text functions as column expressions; Arrow UDFs only where Spark has no function for it."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks that titles fold to plain ones.
QUOTES, DASHES = {"‘": "'", "’": "'", "“": '"', "”": '"'}, {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-"}
FOLDS = {**QUOTES, **DASHES, " ": " "}

# English words that a search ignores.
STOP_WORDS = frozenset("a an and are as at be but by for from has have he her his i if in into is it its me my no not of on or our she so such that the their them then there these they this to was we were what when where which who will with you your".split())


def normalize_query(text: Column) -> Column:
    """One space for any white space, trimmed, lower case; punctuation stays."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", ""))


def _title(text: str | None) -> str | None:
    if text is None:
        return None
    if text.isascii():  # nothing to fold
        return " ".join(text.lower().split())
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join("".join(FOLDS.get(c, c) for c in plain).lower().split())


@F.pandas_udf(T.StringType())
def normalize_title(titles: pd.Series) -> pd.Series:
    """Compatibility form without combining marks, plain quotes and dashes, lower case, single spaces."""
    return titles.map(_title, na_action="ignore")


def is_present(text: Column) -> Column:
    """Something else than white space stands in it."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def compose_body(title: Column, ingredients: Column, steps: Column) -> Column:
    """Present parts, a blank line between them."""
    return F.array_join(F.filter(F.array(title, ingredients, steps), is_present), "\n\n")


def resolve_lines(stored: Column, rows: Column, field: str) -> Column:
    """The stored text if present, else the present values of a field of the rows, a line each."""
    return F.when(is_present(stored), stored).otherwise(F.array_join(F.filter(F.transform(rows, lambda r: r[field]), is_present), "\n"))


def content_hash(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def locator_hash(page_end: Column, page_start: Column, kind: Column) -> Column:
    """Digest of the locator's canonical JSON (fields by name)."""
    return F.sha2(F.to_json(F.struct(page_end.alias("page_end"), page_start.alias("page_start"), kind.alias("type"))), 256)


def input_hash(spans: Column, prompt_version: str, schema_version: str) -> Column:
    """spans: array of structs (id, text_hash) in page order."""
    pairs = F.transform(spans, lambda s: F.struct(s["id"].alias("id"), s["text_hash"].alias("text_hash")))
    return F.sha2(F.to_json(F.struct(F.lit(prompt_version).alias("prompt_version"), F.lit(schema_version).alias("schema_version"), pairs.alias("spans"))), 256)


def window_key(span_ids: Column) -> Column:
    return F.array_join(F.array_sort(span_ids), " ")


def render_window(spans: Column) -> Column:
    """spans: array of structs (id, page, text)."""
    return F.array_join(F.transform(spans, lambda s: F.concat(F.lit("[SOURCE_SPAN "), s["id"], F.lit(" | PDF page "), s["page"].cast("string"), F.lit("]\n"), s["text"])), "\n\n")


def page_label(start: Column, end: Column) -> Column:
    """"page N", "pages N–M", or "" without a start."""
    one = F.concat(F.lit("page "), start.cast("string"))
    return F.when(start.isNull(), "").when(end.isNull() | (end == start), one).otherwise(F.concat(F.lit("pages "), start.cast("string"), F.lit("–"), end.cast("string")))


def badges(servings: Column, cook: Column, total: Column, prep: Column) -> Column:
    full = lambda c: F.when(is_present(c), c)
    return F.array_compact(F.array(full(servings), F.coalesce(full(cook), full(total), full(prep))))


def snippet(text: Column, size: int = 240) -> Column:
    return F.substring(text, 1, size)


def subtitle(document: Column, label: Column) -> Column:
    """Document title and page label, whichever is present."""
    return F.array_join(F.filter(F.array(document, label), is_present), " · ")


# Minutes of the words for units of time.
UNIT_MINUTES = {"hours": 60.0, "hour": 60.0, "hrs": 60.0, "hr": 60.0, "h": 60.0, "minutes": 1.0, "minute": 1.0, "mins": 1.0, "min": 1.0, "m": 1.0}


def parse_minutes(text: Column) -> Column:
    """Minutes of a bare number, an ISO duration, or the sum of hour and minute phrases; null if there is none. Numbers with units are read
    alike from phrases and from ISO forms, where seconds count too."""
    t = F.lower(F.trim(text))
    worth = F.create_map(*[F.lit(x) for kv in {**UNIT_MINUTES, "s": 1 / 60}.items() for x in kv])

    def total(source: Column, pattern: str) -> Column:
        number, unit = (F.regexp_extract_all(source, F.lit(pattern), F.lit(k)) for k in (1, 2))
        return F.aggregate(F.zip_with(number, unit, lambda n, u: n.cast("double") * worth[u]), F.lit(0.0), lambda a, x: a + x)

    phrase = r"(\d+(?:\.\d+)?)\s*(" + "|".join(UNIT_MINUTES) + r")\b"
    iso = t.rlike(r"^pt(\d+h)?(\d+m)?(\d+s)?$") & (t != "pt")
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double")).when(iso, total(F.substring(t, 3, 1000), r"(\d+)([hms])")).when(t.rlike(phrase), total(t, phrase))


def same_text(a: Column, b: Column) -> Column:
    """Equal when trimmed in lower case; null equals null."""
    return F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def confidence_bucket(value: Column) -> Column:
    return F.when(value >= 0.9, ">=0.90").when(value >= 0.75, ">=0.75").when(value >= 0.5, ">=0.50").otherwise("<0.50")


def json_int(text: Column, path: str) -> Column:
    """A number inside a JSON text; null where it is missing or no whole number."""
    return F.get_json_object(text, path).try_cast("int")


def positive_or(value: Column, default) -> Column:
    return F.when(value > 0, value).otherwise(F.lit(default))


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


# Units of ingredients with their usual names, and the value of fraction characters.
UNITS = {
    "tablespoon": "tbsp tbsps tablespoon tablespoons tbs", "teaspoon": "tsp tsps teaspoon teaspoons", "cup": "cup cups", "pound": "lb lbs pound pounds", "ounce": "oz ounce ounces", "gram": "g gram grams", "kilogram": "kg", "milliliter": "ml", "liter": "l liter liters",
    "quart": "quart quarts", "pint": "pint pints", "clove": "clove cloves", "inch": "inch inches", "sprig": "sprig sprigs", "package": "package packages", "can": "can cans", "stick": "stick sticks", "pinch": "pinch",
}
FRACTIONS = {"½": 1 / 2, "¼": 1 / 4, "¾": 3 / 4, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 1 / 8}


def ingredient_parts(line: Column) -> Column:
    """quantity (whole, decimal, fraction or mixed), unit, item and preparation (what follows the first comma) of an ingredient line."""
    amount = r"^\s*•?\s*(?:(\d+(?:\.\d+)?)(?!\d*/)(?:\s+(\d+)/(\d+))?|(\d+)/(\d+))?\s*([" + "".join(FRACTIONS) + r"])?\s*"
    part = lambda k: F.nullif(F.regexp_extract(line, amount, k), F.lit(""))
    ratio = lambda a, b: F.try_divide(part(a).cast("double"), part(b).cast("double"))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    terms = [part(1).cast("double"), ratio(2, 3), ratio(4, 5), table(FRACTIONS)[part(6)]]
    quantity = F.when(F.coalesce(*terms).isNotNull(), sum((F.coalesce(x, F.lit(0.0)) for x in terms), F.lit(0.0)))
    rest = F.regexp_replace(line, amount, "")
    unit = table({n: u for u, names in UNITS.items() for n in names.split()})[F.regexp_replace(F.lower(F.regexp_extract(rest, r"^(\S+)", 1)), r"[.,]+$", "")]
    named = F.when(unit.isNotNull(), F.regexp_replace(rest, r"^\S+\s*", "")).otherwise(rest)
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    item = clean(F.regexp_replace(F.lower(F.trim(F.regexp_extract(named, r"^([^,]*)", 1))), r"\.+$", ""))
    return F.struct(quantity.alias("quantity"), unit.alias("unit"), item.alias("item"), clean(F.regexp_extract(named, r"^[^,]*,(.*)$", 1)).alias("preparation"))


def _pack(parts: list[str], cap: int, glue: str) -> list[str]:
    out, open_part = [], ""
    for part in parts:
        joined = f"{open_part}{glue}{part}" if open_part else part
        if len(joined.encode()) <= cap:
            open_part = joined
        else:
            if open_part:
                out.append(open_part)
            open_part = part
    return out + [open_part] if open_part else out


def split_text(text: str, cap: int) -> list[str]:
    """Parts of at most `cap` UTF-8 bytes: by paragraphs, then lines, then code points; blank parts are dropped."""
    if len(text.encode()) <= cap:
        return [text] if text.strip() else []
    for glue in ("\n\n", "\n"):
        if glue in text:
            pieces = [p for part in text.split(glue) for p in (split_text(part, cap) if len(part.encode()) > cap else [part])]
            return [p for p in _pack(pieces, cap, glue) if p.strip()]
    out, at, size = [], 0, 0
    for k, c in enumerate(text):
        width = len(c.encode())
        if size + width > cap:
            out.append(text[at:k])
            at, size = k, 0
        size += width
    return [p for p in [*out, text[at:]] if p.strip()]


def split_bytes(cap: int = 8000):
    """Only texts above the cap go to Python, a few at a time: an Arrow batch of 10,000 long ones would be as large as they are together."""

    @F.udf(T.ArrayType(T.StringType()), useArrow=False)
    def run(text):
        return None if text is None else split_text(text, cap)

    return lambda text: F.when(F.octet_length(text) <= cap, F.filter(F.array(text), is_present)).otherwise(F.coalesce(run(F.when(F.octet_length(text) > cap, text)), F.array().cast("array<string>")))


# -- stems (Porter 1980) -----------------------------------------------------------------------------------------------

def _shape(stem: str) -> str:
    return "".join("v" if c in "aeiou" or (c == "y" and k and stem[k - 1] not in "aeiou") else "c" for k, c in enumerate(stem))


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# The suffix tables of the published algorithm.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((_STEP2, 0), (_STEP3, 0)):
        found = max((s for s in table if w.endswith(s[0])), key=lambda s: len(s[0]), default=None)
        if found and _measure(w[: -len(found[0])]) > least:
            w = w[: -len(found[0])] + found[1]
    end = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)][-1:] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@functools.lru_cache(1 << 16)
def _stem(word: str) -> str:
    return stem(word)


_LEXEMES = T.ArrayType(T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("pos", T.IntegerType())]))


@F.arrow_udf(_LEXEMES)
def lexemes(texts: pa.Array) -> pa.Array:
    """Stems with their places; stop words take a place but are left out."""
    found, places, ends = [], [], [0]
    for text in texts:
        for k, w in enumerate(re.findall(r"[^\W_]+", (text.as_py() or "").lower()), 1):
            if w not in STOP_WORDS:
                found.append(_stem(w))
                places.append(k)
        ends.append(len(found))
    rows = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(places, pa.int32())], ["lexeme", "pos"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
