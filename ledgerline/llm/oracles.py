"""DuckDB SQL of the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality_rules import MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_DOCS, MIN_WORDS, TOP_WORDS, WORD_CHARS

_CLASSES = (r"[#*$%&|<>]", "[0-9]", "[A-Z]", r"""[.,;:!?"()_=/+-]""")
_COUNTS = ", ".join(f"length(t) - length(regexp_replace(t, '{c}', '', 'g')) AS c{k}" for k, c in enumerate(_CLASSES))


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two counts' shares, summed over rows with columns p, q and their totals."""
    a, b = f"({p} / {p}_total)", f"({q} / {q}_total)"
    half = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    return f"sqrt(greatest(0, sum({half(a, b)} + {half(b, a)}) / 2))"


#: The rules of quality_rules.judge, for tables of at most MAX_LANGS languages.
OP4 = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM d),
c AS (SELECT *, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines, {_COUNTS} FROM w),
pos AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
grams AS (SELECT r, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM pos WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS n FROM grams WHERE w3 IS NOT NULL),
covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY r),
based AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
  CASE WHEN lang IN (SELECT lang FROM d GROUP BY lang HAVING count(*) >= {MIN_DOCS}) THEN lang ELSE '' END AS ref FROM c LEFT JOIN covered USING (r)),
cls AS (SELECT r, lang, ref, unnest([c0, c1, c2, c3, length(t) - c0 - c1 - c2 - c3]) AS p, unnest([0, 1, 2, 3, 4]) AS k, length(t) AS p_total FROM based),
cref AS (SELECT ref, k, sum(p) AS q FROM (SELECT lang AS ref, k, p FROM cls WHERE lang IS NOT NULL UNION ALL SELECT '', k, p FROM cls) GROUP BY ref, k),
cdist AS (SELECT r, {_distance("p", "q")} AS char_distance FROM (SELECT r, p, p_total, q, sum(q) OVER (PARTITION BY r) AS q_total FROM cls JOIN cref USING (ref, k)) WHERE p_total > 0 GROUP BY r),
wc AS (SELECT lang, word, count(*) AS n FROM pos JOIN d USING (r) GROUP BY lang, word),
wk AS (SELECT ref, word, sum(n) AS n FROM (SELECT lang AS ref, word, n FROM wc WHERE lang IS NOT NULL UNION ALL SELECT '', word, n FROM wc) GROUP BY ref, word),
tops AS (SELECT ref, word, n, row_number() OVER (PARTITION BY ref ORDER BY n DESC, word) AS k FROM wk WHERE length(word) <= {WORD_CHARS} QUALIFY k <= {TOP_WORDS}),
wref AS (SELECT ref, word, n AS q FROM tops UNION ALL SELECT ref, NULL, sum(n) - coalesce((SELECT sum(n) FROM tops x WHERE x.ref = wk.ref), 0) FROM wk GROUP BY ref),
own AS (SELECT b.r, t.word, count(*) AS p FROM based b JOIN pos USING (r) LEFT JOIN tops t ON t.ref = b.ref AND t.word = pos.word GROUP BY b.r, t.word),
wdist AS (SELECT r, {_distance("p", "q")} AS word_distance FROM (SELECT b.r, coalesce(o.p, 0) AS p, b.n_words AS p_total, f.q, sum(f.q) OVER (PARTITION BY b.r) AS q_total
  FROM based b JOIN wref f USING (ref) LEFT JOIN own o ON o.r = b.r AND o.word IS NOT DISTINCT FROM f.word) WHERE p_total > 0 GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(c0 AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND NOT coalesce((length(t) >= {MIN_CHARS} AND char_distance > {MAX_CHAR_DISTANCE}) OR (n_words >= {MIN_WORDS} AND word_distance > {MAX_WORD_DISTANCE}), false) AS kept
FROM based LEFT JOIN cdist USING (r) LEFT JOIN wdist USING (r)
"""

#: Links by counting shared shingles, and the smallest id that they reach.
OP6 = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 90 * (x.n + y.n - met)),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM two UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""
