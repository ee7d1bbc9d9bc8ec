"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

from .quality_rules import GAMMA, LEAST, LOOSEST, LOWER, MEASURES, SPREAD, UPPER

_WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _byte_windows() -> str:
    """Names of 400-byte windows by doubling: a name of 2k bytes is that of two names of k."""
    steps, of = [], "SELECT doc_id, i, y, h0 AS h1 FROM b"
    for k in (1, 2, 4, 8, 16, 32, 64, 128):
        steps.append(f"h{2 * k} AS (SELECT *, hash(h{k}, lead(h{k}, {k}) OVER (PARTITION BY doc_id ORDER BY i)) AS h{2 * k} FROM {'h1' if k == 1 else f'h{k}'})")
    return f"h1 AS ({of}), " + ", ".join(steps)


OP1 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, i, y, hash(y) AS h0 FROM (SELECT doc_id, unnest(range(len(x) // 2)) AS i, unnest(regexp_extract_all(x, '..')) AS y FROM d)),
{_byte_windows()},
t AS (SELECT doc_id, i, y, hash(h256, lead(h128, 256) OVER p, lead(h16, 384) OVER p) AS h, i + 400 <= count(*) OVER (PARTITION BY doc_id) AS whole FROM h256 WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, i, y, whole AND count(*) OVER (PARTITION BY whole, h) > 1 AS twice FROM t),
c AS (SELECT doc_id, i, y, coalesce(max(CASE WHEN twice THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 400, false) AS gone FROM w),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
r AS (SELECT doc_id, sum(gone::INT) AS n_removed, sum(begins::INT) AS n_spans, string_agg(y, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY 1)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
b AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS y FROM d),
w AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) > 1 AS twice FROM (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 35], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(len(ws) - 34)) AS i FROM d WHERE len(ws) >= 35))),
c AS (SELECT b.doc_id, b.i, y, coalesce(max(CASE WHEN twice THEN b.i END) OVER (PARTITION BY b.doc_id ORDER BY b.i) > b.i - 35, false) AS gone FROM b LEFT JOIN w USING (doc_id, i)),
r AS (SELECT doc_id, sum(gone::INT) AS n_removed, string_agg(y, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""


def _quantiles(keys: str) -> str:
    """Median, low and high quantile of each measure in each group, of its merged sketch."""
    comma, over = f"{keys}, " if keys else "", f"PARTITION BY {keys + ', ' if keys else ''}measure"
    value = f"CASE WHEN step IS NULL THEN 0.0 ELSE pow({GAMMA}::DOUBLE, step) * {2 / (GAMMA + 1)!r}::DOUBLE END"
    reach = lambda q: f"min(CASE WHEN upto >= {q}::DOUBLE * size THEN v END)"
    return f"""(SELECT {comma}measure, max(size) AS size, {reach(0.5)} AS mid, {reach(LOWER)} AS low, {reach(UPPER)} AS high
  FROM (SELECT *, {value} AS v, sum(n) OVER ({over} ORDER BY step NULLS FIRST) AS upto, sum(n) OVER ({over}) AS size FROM (SELECT {comma}measure, step, sum(n) AS n FROM sketch GROUP BY {comma}measure, step)) GROUP BY {comma}measure)"""


_RATE = {k: f"CASE WHEN {n} > 0 THEN {c}::DOUBLE / {n} ELSE 0.0 END" for k, (c, n, _) in MEASURES.items()}
_CUT = {t: f"({t}.mid + {SPREAD}::DOUBLE * CASE WHEN {t}.mid > {t}.low THEN {t}.mid - {t}.low ELSE coalesce(nullif(cw.wide, 0), aw.wide, a.high - a.mid) END)" for t in "fca"}
_MIDDLE = f"quantile_disc(CASE WHEN size >= {LEAST} THEN high - mid END, 0.5) AS wide"

OP9 = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
b AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS y FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) > 1 AS twice FROM (SELECT doc_id, i, array_to_string(ws[i + 1:i + 5], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5))),
k AS (SELECT b.doc_id, coalesce(max(CASE WHEN twice THEN b.i END) OVER (PARTITION BY b.doc_id ORDER BY b.i) > b.i - 5, false) AS again, coalesce(y = lag(y) OVER (PARTITION BY b.doc_id ORDER BY b.i), false) AS echo FROM b LEFT JOIN g USING (doc_id, i)),
r AS (SELECT doc_id, sum(again::INT) AS n_repeat_words, sum(echo::INT) AS n_echo FROM k GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
m AS (SELECT d.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_echo, 0)::BIGINT AS n_echo_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS measure, {x} AS value FROM m WHERE n_words > 0" for k, x in _RATE.items())}),
sketch AS (SELECT lang, source, measure, CASE WHEN value > 0 THEN ceil(ln(value) / ln({GAMMA}::DOUBLE)) END AS step, count(*) AS n FROM v GROUP BY ALL),
f AS {_quantiles('lang, source')}, c AS {_quantiles('lang')}, a AS {_quantiles('')}, cw AS (SELECT lang, measure, {_MIDDLE} FROM f GROUP BY 1, 2), aw AS (SELECT measure, {_MIDDLE} FROM f GROUP BY 1),
t AS (SELECT f.lang, f.source, f.measure, CASE WHEN f.size >= {LEAST} THEN CASE WHEN c.size >= {LEAST} AND {_CUT['c']} > 0 THEN least({_CUT['f']}, {LOOSEST}::DOUBLE * {_CUT['c']}) ELSE {_CUT['f']} END WHEN c.size >= {LEAST} THEN {_CUT['c']} ELSE {_CUT['a']} END AS cut FROM f JOIN c ON f.lang IS NOT DISTINCT FROM c.lang AND f.measure = c.measure JOIN a ON a.measure = f.measure LEFT JOIN cw ON cw.lang IS NOT DISTINCT FROM f.lang AND cw.measure = f.measure LEFT JOIN aw ON aw.measure = f.measure),
w AS (SELECT lang, source, {', '.join(f"max(CASE WHEN measure = '{k}' THEN cut END) AS max_{k}" for k in MEASURES)} FROM t GROUP BY 1, 2),
j AS (SELECT m.*, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, {', '.join(f'max_{k}' for k in MEASURES)} FROM m LEFT JOIN w ON m.lang IS NOT DISTINCT FROM w.lang AND m.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(f'coalesce({c} <= max_{k} * {n} + {chance}::DOUBLE, false)' for k, (c, n, chance) in MEASURES.items())} AS kept FROM j
"""
