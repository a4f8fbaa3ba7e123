"""op7: the quality rules over all documents."""

from stemloom.llm.quality_rules import filter_quality
from stemloom.llm.store import table


def op7_quality_rules(spark, sf_dir):
    return filter_quality(table(spark, sf_dir, "documents"))


_RATIOS = {"word_length": "1000 * word_chars // n_words", "symbol_ratio": "1000 * n_symbols // n_words", "dup_line_ratio": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeat_ratio": "1000 * n_repeat_words // n_words"}
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, floor(ln(1.0e0 + {x}) / ln(1.01e0)) AS b FROM good" for m, x in _RATIOS.items())
_AT = lambda q: f"list_extract(list_sort(list(b)), CAST(ceil({q}e0 * count(*)) AS INT))"
_EDGES = ", ".join(f"pow(1.01e0, {_AT(q)}) - 1 AS q{int(100 * q)}" for q in (0.25, 0.5, 0.75, 0.85, 0.98))
_SPREAD = "greatest(least(q75 - q50, q50 - q25), (1.01e0 - 1) * q50)"
_FENCES = f"CASE metric WHEN 'word_length' THEN q50 + 10 * {_SPREAD} WHEN 'symbol_ratio' THEN 1.5e0 * q85 ELSE 1.5e0 * q98 END AS high, q50 - 10 * {_SPREAD} AS low"
_SIDE = lambda m, side: f"max(CASE WHEN g.metric = '{m}' THEN (g.n * g.{side} + 50 * w.{side}) / (g.n + 50) END) AS {m}_{side}"
_OVER = lambda count, of, m: f"{count} > {m}_high / 1000 * {of} + 3 * sqrt({m}_high / 1000 * {of} + 1)"
SQL = {
    "op7_quality_rules": rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
spread AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT rid, regexp_extract_all(t, '[^ 	-
]+') AS ws FROM texts)),
triples AS (SELECT rid, k, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS tri FROM spread WINDOW o AS (PARTITION BY rid ORDER BY k)),
again AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, tri) AS n FROM triples WHERE tri IS NOT NULL) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, k FROM again UNION ALL SELECT rid, k + 1 FROM again UNION ALL SELECT rid, k + 2 FROM again) GROUP BY rid),
words AS (SELECT rid, count(*) AS n, sum(length(w)) AS chars FROM spread GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY rid),
counts AS (SELECT d.doc_id AS doc_id, d.lang AS lang, d.source AS source, CAST(coalesce(w.n, 0) AS BIGINT) AS n_words, CAST(coalesce(w.chars, 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM texts d LEFT JOIN words w ON w.rid = d.rid LEFT JOIN lines l ON l.rid = d.rid LEFT JOIN covered c ON c.rid = d.rid),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
good AS (SELECT * FROM judged WHERE NOT base_failed),
long AS ({_LONG}),
own AS (SELECT *, {_FENCES} FROM (SELECT lang, source, metric, count(*) AS n, {_EDGES} FROM long GROUP BY lang, source, metric)),
whole AS (SELECT metric, {_FENCES} FROM (SELECT metric, {_EDGES} FROM long GROUP BY metric)),
bounds AS (SELECT g.lang AS lang, g.source AS source, {", ".join(_SIDE(m, side) for m in _RATIOS for side in ("high", "low"))} FROM own g JOIN whole w ON w.metric = g.metric GROUP BY g.lang, g.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({_RATIOS["word_length"]} > word_length_high OR {_RATIOS["word_length"]} < word_length_low OR {_OVER("n_symbols", "n_words", "symbol_ratio")} OR {_OVER("n_dup_lines", "n_lines", "dup_line_ratio")} OR {_OVER("n_repeat_words", "n_words", "repeat_ratio")}, false) AS kept
FROM judged j LEFT JOIN bounds b ON b.lang IS NOT DISTINCT FROM j.lang AND b.source IS NOT DISTINCT FROM j.source
"""
}
QUERIES = {"op7_quality_rules": op7_quality_rules}
