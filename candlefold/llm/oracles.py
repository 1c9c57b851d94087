"""DuckDB SQL for the corpus operators that SQL can express; plain definitions, without the operators' methods."""

from __future__ import annotations

from candlefold.llm import quality
from candlefold.llm.secrets import ASSIGN

_KEYS = "(?i)(password|passwd|secret|token|api_?key)"
_A = ASSIGN.replace("'", "''")


def _spans(kind: int, pattern: str, group: int) -> str:
    """Positions from the pieces between matches, whose lengths add up."""
    return f"""SELECT doc_id, source, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'v': g[i], 'n': length(m[i]), 's': (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT}})) AS x
  FROM (SELECT doc_id, source, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS g, string_split_regex(text, '{pattern}') AS p FROM t)"""


SECRETS = f"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
c AS ({_spans(0, _A, 2)} UNION ALL {_spans(1, 'AKIA[A-Z0-9]{12,}', 0)} UNION ALL {_spans(2, '[0-9a-f]{32,}', 0)} UNION ALL {_spans(3, '[A-Za-z0-9+/_=-]{20,}', 0)}),
d AS (SELECT doc_id, source, kind, x.v AS v, x.s AS s, x.s + x.n AS e FROM c WHERE CASE kind WHEN 0 THEN length(x.v) >= 8 WHEN 3 THEN regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[A-Za-z]') ELSE true END),
o AS (SELECT v, count(DISTINCT coalesce(source, '')) = 1 AND count(DISTINCT coalesce(doc_id, -1)) <= 3 AS own FROM d GROUP BY v),
j AS (SELECT d.*, own FROM d JOIN o USING (v)),
k AS (SELECT * FROM j WHERE kind < 3 OR (own AND NOT EXISTS (SELECT 1 FROM j b WHERE b.doc_id = j.doc_id AND b.kind < 3 AND j.s < b.e AND j.e > b.s))),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (own) AS n_live_looking, count(*) FILTER (NOT own) AS n_copied,
  string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans, string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base FROM k GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
coalesce(n_live_looking, 0) AS n_live_looking, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN g USING (doc_id)"""


def _cutoffs() -> str:
    rows = [f"('{r}', {place}, {i}, {c})" for place, (r, cs) in enumerate(quality.CUTOFFS.items()) for i, c in enumerate(cs)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(rule, place, pos, cutoff)"


_WORDS = r"string_split_regex(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')), ' ')"
QUALITY = rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents), w0 AS (SELECT *, list_filter({_WORDS}, lambda x: x <> '') AS w FROM t),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w0 WHERE len(w) >= 3), g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM p),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
c AS (SELECT w0.doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(list_distinct(w)) AS n_distinct
  FROM w0 LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS (SELECT doc_id, stratum, base_failed, unnest([{{'rule': 'symbol_ratio', 'v': coalesce(n_symbols / nullif(n_words, 0), 0)}}, {{'rule': 'dup_line_ratio', 'v': coalesce(n_dup_lines / nullif(n_lines, 0), 0)}}, {{'rule': 'repeat_ratio', 'v': coalesce(n_repeat_words / nullif(n_words, 0), 0)}},
  {{'rule': 'upper_ratio', 'v': coalesce(n_upper / nullif(word_chars, 0), 0)}}, {{'rule': 'reuse_ratio', 'v': coalesce((n_words - n_distinct) / nullif(n_words, 0), 0)}}]) AS x FROM b),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT v.doc_id, v.stratum, x.rule AS rule, x.v AS v, quality, substr(md5(v.doc_id::VARCHAR), 32, 1) < '8' AS proposes FROM v JOIN q USING (doc_id) WHERE NOT base_failed),
cu AS ({_cutoffs()}),
n AS (SELECT stratum, rule, place, pos, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND v >= cutoff) AS k, count(*) FILTER (quality = 0 AND v >= cutoff) AS bad FROM h JOIN cu USING (rule) WHERE proposes GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY bad DESC, pos) AS j FROM n WHERE bad > 0 AND k <= {quality.TARGET} * n) WHERE j = 1),
seq AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY bad DESC, place) AS step FROM best),
hd AS (SELECT h.doc_id, h.stratum, min(step) FILTER (h.v >= cutoff) AS step FROM h LEFT JOIN seq ON seq.stratum = h.stratum AND seq.rule = h.rule WHERE NOT proposes AND quality = 1 GROUP BY h.doc_id, h.stratum),
m AS (SELECT count(DISTINCT stratum) AS m FROM hd),
u AS (SELECT seq.stratum, seq.rule, seq.cutoff, seq.step, count(*) AS n, count(*) FILTER (hd.step <= seq.step) AS k FROM seq JOIN hd ON hd.stratum = seq.stratum GROUP BY ALL),
s AS (SELECT u.*, (SELECT ln(sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({quality.ALPHA}) + (n - i) * ln(1 - {quality.ALPHA})))) FROM (SELECT unnest(range(0, k + 1)) AS i)) <= ln({quality.DELTA} / m.m) AS ok FROM u, m),
f AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY step) AS safe FROM s),
bad AS (SELECT DISTINCT doc_id FROM v JOIN f ON f.safe AND f.stratum = v.stratum AND f.rule = v.x.rule WHERE v.x.v >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, hex, (SELECT string_agg(substr('{_B32}', (('0x' || substr(hex, 1 + (i // 8) * 10, 10))::BIGINT >> (5 * (7 - i % 8)) & 31)::INT + 1, 1), '' ORDER BY i) FROM (SELECT unnest(range(0, 32)) AS i)) AS payload_digest FROM p),
b AS (SELECT hex, max(page_id) AS best FROM d GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM d JOIN b USING (hex)"""

#: Every stretch of whole lines of 50 words is compared by its text; no fingerprints.
LINES = r"""WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM t),
l AS (SELECT * FROM (SELECT *, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n FROM a) WHERE n > 0),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS stop FROM l), s2 AS (SELECT *, stop - n AS start FROM s),
w AS (SELECT doc_id, array_to_string(list(line) OVER o, chr(10)) AS k, min(pos) OVER o AS f, max(pos) OVER o AS z, sum(n) OVER o AS words FROM s2 WINDOW o AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION SELECT doc_id, array_to_string(list(line) OVER o, chr(10)), min(pos) OVER o, max(pos) OVER o, sum(n) OVER o FROM s2 WINDOW o AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, f) AS nth FROM (SELECT DISTINCT doc_id, k, f, z FROM w WHERE words >= 50)),
x AS (SELECT DISTINCT doc_id, f, z FROM r WHERE nth > 1),
y AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY f, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, sum(CASE WHEN f <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY f, z) AS run FROM y),
u AS (SELECT doc_id, run, min(f) AS f, max(z) AS z FROM i GROUP BY doc_id, run),
g AS (SELECT doc_id, string_agg(f || '-' || z, ',' ORDER BY f) AS removed_lines, sum(z - f + 1)::BIGINT AS n_removed FROM u GROUP BY doc_id),
kept AS (SELECT a.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = a.doc_id AND a.pos BETWEEN u.f AND u.z) GROUP BY a.doc_id)
SELECT t.doc_id, CASE WHEN g.doc_id IS NULL THEN t.text ELSE coalesce(kept.text, '') END AS text, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines
FROM t LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""
