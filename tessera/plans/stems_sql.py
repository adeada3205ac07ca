"""The stems of functions.text and the cover density of operators.search in SQL, for the queries that rank by them."""

from __future__ import annotations

from tessera.functions import text as X


def _shape(w: str) -> str:
    """V for vowels (a y after none of aeiou is one), C for the rest."""
    y = rf"regexp_replace(regexp_replace({w}, '([^aeiou])y', '\1Y', 'g'), '([^aeiou])y', '\1Y', 'g')"
    return f"regexp_replace(regexp_replace({y}, '[aeiouY]', 'V', 'g'), '[^V]', 'C', 'g')"


def _measure(w: str) -> str:
    return f"len(regexp_extract_all({_shape(w)}, 'V+C+'))"


def _cvc(w: str) -> str:
    return f"(suffix({_shape(w)}, 'CVC') AND right({w}, 1) NOT IN ('w', 'x', 'y'))"


def _cut(n: int, w: str = "w") -> str:
    return f"left({w}, length({w}) - {n})"


def _longest(ends) -> str:
    return "CASE " + " ".join(f"WHEN suffix(w, '{e}') THEN '{e}'" for e in sorted(ends, key=len, reverse=True)) + " END"


def _replace(table) -> str:
    to = "CASE e " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table) + " END"
    return f"CASE WHEN e IS NOT NULL AND {_measure('s')} > 0 THEN s || {to} ELSE w END"


def stems(words: str) -> str:
    """CTEs; the last, `stems`, has (word, stem) for the column `word` of the CTE `words`."""
    steps = [
        "CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN " + _cut(2) + " WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN " + _cut(1) + " ELSE w END",
        None,
        f"CASE WHEN suffix(w, 'y') AND contains({_shape(_cut(1))}, 'V') THEN {_cut(1)} || 'i' ELSE w END",
    ]
    out = [f"stem0 AS (SELECT DISTINCT word, word AS w FROM {words} WHERE length(word) >= 3 AND regexp_full_match(word, '[a-z0-9]*'))"]
    out.append(f"stem1 AS (SELECT word, {steps[0]} AS w FROM stem0)")
    out.append(f"""stem2a AS (SELECT word, w, CASE WHEN suffix(w, 'eed') THEN NULL WHEN suffix(w, 'ed') AND contains({_shape(_cut(2))}, 'V') THEN {_cut(2)} WHEN suffix(w, 'ing') AND contains({_shape(_cut(3))}, 'V') THEN {_cut(3)} END AS s FROM stem1)""")
    out.append(f"""stem2 AS (SELECT word, CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_measure(_cut(3))} > 0 THEN {_cut(1)} ELSE w END WHEN s IS NULL THEN w
    WHEN suffix(s, 'at') OR suffix(s, 'bl') OR suffix(s, 'iz') THEN s || 'e' WHEN length(s) > 1 AND s[-1] = s[-2] AND NOT contains('aeiouylsz', s[-1]) THEN {_cut(1, 's')} WHEN {_measure('s')} = 1 AND {_cvc('s')} THEN s || 'e' ELSE s END AS w FROM stem2a)""")
    out.append(f"stem3 AS (SELECT word, {steps[2]} AS w FROM stem2)")
    for k, table in ((4, X._STEP2), (5, X._STEP3)):
        out.append(f"stem{k}a AS (SELECT word, w, e, left(w, length(w) - length(e)) AS s FROM (SELECT word, w, {_longest(a for a, _ in table)} AS e FROM stem{k - 1}))")
        out.append(f"stem{k} AS (SELECT word, {_replace(table)} AS w FROM stem{k}a)")
    out.append(f"stem6a AS (SELECT word, w, e, left(w, length(w) - length(e)) AS s FROM (SELECT word, w, {_longest(X._STEP4)} AS e FROM stem5))")
    out.append(f"stem6 AS (SELECT word, CASE WHEN e IS NOT NULL AND {_measure('s')} > 1 AND (e <> 'ion' OR right(s, 1) IN ('s', 't')) THEN s ELSE w END AS w FROM stem6a)")
    out.append(f"stem7 AS (SELECT word, CASE WHEN suffix(w, 'e') AND ({_measure(_cut(1))} > 1 OR ({_measure(_cut(1))} = 1 AND NOT {_cvc(_cut(1))})) THEN {_cut(1)} ELSE w END AS w FROM stem6)")
    out.append(f"stem8 AS (SELECT word, CASE WHEN suffix(w, 'll') AND {_measure('w')} > 1 THEN {_cut(1)} ELSE w END AS w FROM stem7)")
    out.append(f"stems AS (SELECT word, coalesce(w, word) AS stem FROM (SELECT DISTINCT word FROM {words}) LEFT JOIN stem8 USING (word))")
    return ",\n".join(out)


_STOP = ", ".join(f"'{w}'" for w in sorted(X.STOP_WORDS))


def stemmed_search(chunks: str, n_terms: int, top_k: int = 50) -> str:
    """CTEs; the last, `found`, has (query_id, chunk_id, rank, raw_score): chunks (chunk_id, text, of the CTE `chunks`) that have all of the first n_terms stems
    of a benchmark text, by cover density."""
    words = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
    last = ", ".join(f"max(CASE WHEN t = {t} THEN pos END) OVER w AS last{t}" for t in range(1, n_terms + 1))
    lasts = ", ".join(f"last{t}" for t in range(1, n_terms + 1))
    had = " + ".join(f"CAST(last{t} IS NOT NULL AS INTEGER)" for t in range(1, n_terms + 1))
    return f"""said AS (SELECT chunk_id, w AS word, k AS pos FROM (SELECT chunk_id, unnest({words.format("text")}) AS w, generate_subscripts({words.format("text")}, 1) AS k FROM {chunks}) WHERE w NOT IN ({_STOP})),
asked0 AS (SELECT item_id, w AS word, k FROM (SELECT item_id, unnest({words.format("text")}) AS w, generate_subscripts({words.format("text")}, 1) AS k FROM benchmark) WHERE w NOT IN ({_STOP})),
every AS (SELECT word FROM said UNION SELECT word FROM asked0),
{stems("every")},
front AS (SELECT item_id, stem, k, row_number() OVER (PARTITION BY item_id ORDER BY k) AS n FROM asked0 JOIN stems USING (word)),
terms AS (SELECT item_id AS query_id, stem, row_number() OVER (PARTITION BY item_id ORDER BY min(k)) AS t, count(*) OVER (PARTITION BY item_id) AS n_terms FROM front WHERE n <= {n_terms} GROUP BY item_id, stem),
events AS (SELECT query_id, chunk_id, pos, t, n_terms, {last} FROM said JOIN stems USING (word) JOIN terms USING (stem) WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY pos)),
lows AS (SELECT *, CASE WHEN {had} = n_terms THEN least({lasts}) END AS low FROM events),
closed AS (SELECT *, low IS NOT NULL AND coalesce(lead(low) OVER (PARTITION BY query_id, chunk_id ORDER BY pos) > low, true) AS ends FROM lows),
covers AS (SELECT *, ends AND low > coalesce(max(CASE WHEN ends THEN low END) OVER (PARTITION BY query_id, chunk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS cover FROM closed),
scored AS (SELECT query_id, chunk_id, coalesce(sum(1.0::DOUBLE / greatest(1, pos - low + 1 - n_terms + 1) ORDER BY pos) FILTER (WHERE cover), 0) AS raw_score FROM covers GROUP BY query_id, chunk_id HAVING count(DISTINCT t) = any_value(n_terms)),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS rank FROM scored) WHERE rank <= {top_k})"""
