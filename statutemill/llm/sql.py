"""DuckDB SQL of the queries that SQL can express; each computes the rows its own way, from the tables alone."""

from __future__ import annotations

from .divergence import BEST, LEAST_DOCUMENTS, SCALE, SMOOTH, TERM
from .mixing import DIGITS, KEEP, ROUNDS, SEED, TEMPERATURE
from .quality_rules import ALPHA, DELTA, MAX_REPEAT_PERCENT, MIN_WORDS, RULES
from .url_filter import BLOCK_GLOBS

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')"

_grid = ", ".join(f"('{r}', {j}, {c})" for r, (_, _, cuts) in RULES.items() for j, c in enumerate(cuts))
_values = " ".join(f"WHEN '{r}' THEN CASE WHEN {below} > 0 THEN {top} / {below} ELSE 0.0 END" for r, (top, below, _) in RULES.items())
_alpha = ALPHA / len(RULES)

OP1 = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS k FROM w, unnest(range(1, len(ws) - 3)) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(0, 5) AS t(j) GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
grid(rule, step, cutoff) AS (VALUES {_grid}),
v AS (SELECT b.*, grid.*, CASE rule {_values} END > cutoff AS above FROM b, grid),
lab AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
k AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (above AND good) AS k, count(*) FILTER (above AND NOT good) AS b FROM v JOIN lab ON v.doc_id = lab.doc_id WHERE NOT base_failed GROUP BY ALL HAVING count(*) FILTER (good) > 0),
p AS (SELECT *, CASE WHEN k > 1.1 * n * {_alpha} + 1 THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_alpha}) + (n - i) * ln(1 - {_alpha})))) END AS p FROM k),
s AS (SELECT *, bool_and(p <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM k) * {len(RULES)})) OVER (PARTITION BY stratum, rule ORDER BY step) AS safe FROM p),
cut AS (SELECT stratum, rule, arg_max(cutoff, (b - k) * 1000 + cutoff) AS cutoff FROM s WHERE safe AND b > k GROUP BY ALL),
hit AS (SELECT v.doc_id, min(list_position({list(RULES)}, v.rule)) AS slot FROM v JOIN cut ON v.stratum = cut.stratum AND v.rule = cut.rule AND v.cutoff = cut.cutoff WHERE above GROUP BY v.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND slot IS NULL AS kept, ({list(RULES)})[slot] AS rejected_by FROM b LEFT JOIN hit ON b.doc_id = hit.doc_id
"""


def _regex(glob: str) -> str:
    out = glob.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("?", ".").replace("\0", ".*")
    return f"(?s)^{out}$"


_blocked = " ".join(f"WHEN regexp_matches(host || path, '{_regex(g)}') THEN '{g}'" for g in BLOCK_GLOBS)
OP2 = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
rules(host, path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule, arg_max(action, length(rules.host || rules.path)) AS action FROM h JOIN rules ON (h.host = rules.host OR h.host LIKE '%.' || rules.host) AND starts_with(h.path, rules.path) GROUP BY page_id),
g AS (SELECT *, CASE {_blocked} END AS matched FROM h)
SELECT g.page_id, host, path, rule, coalesce(action, CASE WHEN matched IS NULL THEN 'allow' ELSE 'block' END) AS verdict, matched AS glob FROM g LEFT JOIN m ON g.page_id = m.page_id
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text, CAST(len({_WORDS}) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN (length(text) - length(replace(text, '|', ''))) * 10 > n_tokens THEN 'table' WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'longform' END AS topic FROM d),
c AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM t GROUP BY ALL HAVING sum(n_tokens) > 0),
a AS (SELECT *, pow(CAST(sum(tokens) OVER (PARTITION BY source) AS DOUBLE), {TEMPERATURE["source"]}) AS ts, pow(CAST(sum(tokens) OVER (PARTITION BY lang) AS DOUBLE), {TEMPERATURE["lang"]}) AS tl, pow(CAST(sum(tokens) OVER (PARTITION BY topic) AS DOUBLE), {TEMPERATURE["topic"]}) AS tt FROM c),
r AS (SELECT 0 AS i, a.*, CAST(tokens AS DOUBLE) AS w FROM a UNION ALL
  SELECT i + 1, source, lang, topic, tokens, ts, tl, tt, w / sum(w) OVER (PARTITION BY topic) * tt FROM (
    SELECT * REPLACE (w / sum(w) OVER (PARTITION BY lang) * tl AS w) FROM (
      SELECT * REPLACE (w / sum(w) OVER (PARTITION BY source) * ts AS w) FROM r WHERE i < {ROUNDS}))),
ratio AS (SELECT source, lang, topic, (w / sum(w) OVER ()) / (tokens / sum(tokens) OVER ()) AS x FROM r WHERE i = {ROUNDS}),
rate AS (SELECT source, lang, topic, round({KEEP} * (x / max(x) OVER ()), {DIGITS}) AS rate FROM ratio),
p AS (SELECT t.doc_id, t.source, t.lang, t.topic, n_tokens, coalesce(rate, {KEEP}) AS probability FROM t LEFT JOIN rate ON t.source = rate.source AND t.lang = rate.lang AND t.topic = rate.topic)
SELECT *, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / {float(1 << 48)} < probability AS kept FROM p
"""

OP7 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM later, range(0, 13) AS t(j)),
listed AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(array_to_string(CASE WHEN places IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256 FROM w LEFT JOIN listed ON w.doc_id = listed.doc_id
"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM w GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT lang, source, term, sum(n) AS n FROM w GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, CAST(coalesce(x.n, 0) AS HUGEINT) AS n, CAST(k.n AS HUGEINT) AS m FROM g JOIN k ON g.lang = k.lang LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
s AS (SELECT *, 1 + ({SCALE} * (n + {SMOOTH})) // (sum(n) OVER grp + {SMOOTH} * count(*) OVER grp) AS p, 1 + ({SCALE} * (m + {SMOOTH})) // (sum(m) OVER grp + {SMOOTH} * count(*) OVER grp) AS q FROM c WINDOW grp AS (PARTITION BY lang, source)),
v AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= {BEST}
"""

ORACLES = {"op1_quality_rules": OP1, "op2_url_filter": OP2, "op5_topk_search": OP5, "op6_mixing": OP6, "op7_super_kmers": OP7, "op13_source_divergence": OP13}
