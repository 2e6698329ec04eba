"""Pieces of the SQL that the queries are checked against (DuckDB)."""

from __future__ import annotations

from ..functions.hashing import FNV_OFFSET, FNV_PRIME, MIX_A, MIX_B, MIX_STEP
from .tables import DECISIONS, LINE_RULES

FILE = "'d' || lpad(CAST(doc_id AS VARCHAR), 12, '0')"
WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
BLANK = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def lines(x: str) -> str:
    raw = rf"string_split_regex({x}, '\r\n|\r|\n')"
    return f"CASE WHEN {x} = '' THEN [] WHEN {raw}[-1] = '' THEN {raw}[1:len({raw}) - 1] ELSE {raw} END"


def comment(line: str, language: str) -> str:
    t = trimmed(line)
    return f"CASE WHEN {language} = 'python' THEN starts_with({t}, '#') ELSE starts_with({t}, '//') OR starts_with({t}, '/*') OR starts_with({t}, '*') OR ends_with({t}, '*/') END"


def fnv(x: str) -> str:
    return f"list_reduce(list_prepend(CAST({FNV_OFFSET} AS BIGINT), list_transform(string_split({x}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * {FNV_PRIME}) % 4294967296)"


GRAMS = f"""
tok AS (SELECT source AS project_key, doc_id, {FILE} AS file, {WORDS} AS t FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT project_key, doc_id, file, {fnv("array_to_string(list_slice(t, i, i + least(12, len(t)) - 1), chr(1))")} AS h
  FROM (SELECT *, unnest(range(1, len(t) - least(12, len(t)) + 2)) AS i FROM tok WHERE len(t) > 0)),
cnt AS MATERIALIZED (SELECT project_key, doc_id, file, count(*) AS n FROM grams GROUP BY ALL)
"""
PAIRS = """
met AS (SELECT a.project_key, a.file AS file_a, b.file AS file_b, count(*) AS m FROM grams a JOIN grams b ON a.project_key = b.project_key AND a.h = b.h AND a.file < b.file GROUP BY ALL),
sim AS (SELECT met.project_key, file_a, file_b, m AS matching_k_grams, m / (x.n + y.n - m) AS jaccard FROM met
  JOIN cnt x ON x.project_key = met.project_key AND x.file = file_a JOIN cnt y ON y.project_key = met.project_key AND y.file = file_b),
good AS MATERIALIZED (SELECT * FROM sim WHERE jaccard >= 0.2)
"""
TOP = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY jaccard DESC, matching_k_grams DESC, file_a, file_b) AS seq FROM good),
top AS MATERIALIZED (SELECT * FROM ranked WHERE seq <= 5)
"""


def _times(x: str, k: int) -> str:
    return f"(({x} * {k & 0xFFFF} + ((({x} * {k >> 16}) & 65535) << 16)) & 4294967295)"


SIGNATURE = f"""
mixed AS (SELECT project_key, doc_id, file, s, xor(c, c >> 16) AS v FROM (
  SELECT project_key, doc_id, file, s, {_times("b", MIX_B)} AS c FROM (
    SELECT project_key, doc_id, file, s, xor(a, a >> 13) AS b FROM (
      SELECT project_key, doc_id, file, s, {_times("xor(x, x >> 16)", MIX_A)} AS a FROM (
        SELECT project_key, doc_id, file, s, xor(h, ((s + 1) * {MIX_STEP}) % 4294967296) AS x FROM grams, range(128) r(s)))))),
sig AS MATERIALIZED (SELECT project_key, doc_id, file, s, min(v) AS v FROM mixed GROUP BY ALL)
"""
BANDS = "bands AS MATERIALIZED (SELECT project_key, doc_id, file, CAST(s // 8 AS INTEGER) AS band, string_agg(CAST(v AS VARCHAR), ',' ORDER BY s) AS band_key FROM sig GROUP BY project_key, doc_id, file, s // 8)"
LSH = "lsh AS (SELECT DISTINCT a.project_key, a.file AS file_a, b.file AS file_b FROM bands a JOIN bands b ON a.project_key = b.project_key AND a.band = b.band AND a.band_key = b.band_key AND a.file < b.file)"

_hits = " UNION ALL ".join(f"SELECT project_key, file, lang, line, x, '{r}' AS ruleId, '{s}' AS severity, '{t}' AS type, '{r} {i}' AS message, {i} AS ord FROM lns WHERE regexp_matches(x, '{p}')" for i, (r, s, t, p) in enumerate(LINE_RULES))
LINES = f"lns AS (SELECT project_key, file, lang, line, l[line] AS x FROM (SELECT *, unnest(range(1, len(l) + 1)) AS line FROM (SELECT source AS project_key, {FILE} AS file, lang, {lines('text')} AS l FROM (SELECT source, doc_id, lang, coalesce(text, '') AS text FROM documents))))"
FOUND = f"""{LINES},
raw AS ({_hits}),
found AS MATERIALIZED (SELECT project_key, ruleId || ':' || file || ':' || line || ':1' AS id, ruleId, severity, type, file, CAST(line AS BIGINT) AS line, CAST(1 AS BIGINT) AS "column", message, substr({trimmed('x')}, 1, 240) AS snippet, ord, lang FROM raw),
finding AS MATERIALIZED (SELECT * EXCLUDE (ord, k) FROM (SELECT *, row_number() OVER (PARTITION BY project_key, id ORDER BY ord DESC) AS k FROM found) WHERE k = 1)
"""
_language = "CASE WHEN lang = 'en' THEN 'python' ELSE 'java' END"
METRICS = f"""
met0 AS (SELECT doc_id, source AS project_key, {FILE} AS file, {_language} AS language, {lines('text')} AS l, {WORDS} AS t, length(text) AS n FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)),
met AS MATERIALIZED (SELECT doc_id, project_key, file, language, CAST(len(l) AS BIGINT) AS totalLines,
  CAST(len(list_filter(l, lambda x: {comment('x', 'language')})) AS BIGINT) AS commentLines, CAST(len(list_filter(l, lambda x: {trimmed('x')} = '')) AS BIGINT) AS blank,
  CAST(1 + len(list_filter(t, lambda w: list_contains({list(DECISIONS)}, w))) AS BIGINT) AS complexity, CAST(n // 1000 AS BIGINT) AS nesting FROM met0)
"""

BLOCK_SEEDS = f"""
pos0 AS (SELECT source AS project_key, {FILE} AS file, {lines("coalesce(text, '')")} AS l FROM documents),
pos1 AS (SELECT project_key, file, flatten(list_transform(l, lambda x, i: list_transform(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+'), lambda w: {{'w': w, 'at': CAST(i AS BIGINT)}}))) AS t FROM pos0),
pos AS MATERIALIZED (SELECT project_key, file, n, i, t[i].w AS w, t[i].at AS line, array_to_string(list_transform(t[i:i + 11], lambda x: x.w), chr(1)) AS g FROM (SELECT project_key, file, t, len(t) AS n, unnest(range(1, len(t) + 1)) AS i FROM pos1 WHERE len(t) >= 48)),
seed AS (SELECT project_key, file, n, i, h, row_number() OVER (PARTITION BY file, h ORDER BY i) AS nth, min(i) OVER (PARTITION BY file, h) AS first FROM (SELECT *, {fnv('g')} AS h FROM pos WHERE i <= n - 11)),
far AS MATERIALIZED (SELECT a.project_key, a.file, a.n, a.first, a.i AS a, b.i AS b, b.i - a.i AS d FROM seed a JOIN seed b ON a.file = b.file AND a.h = b.h WHERE a.nth <= 20 AND b.nth <= 20 AND b.i - a.i >= 24)
"""
#: a match ends at the first difference of its diagonal, its second place or the end
BLOCK_CANDIDATES = f"""{BLOCK_SEEDS},
diagonal AS (SELECT DISTINCT file, n, d FROM far),
differs AS (SELECT x.file, g.d, x.i FROM diagonal g JOIN pos x ON x.file = g.file JOIN pos y ON y.file = g.file AND y.i = x.i + g.d WHERE x.w <> y.w UNION ALL SELECT file, d, n - d + 1 FROM diagonal),
grown AS (SELECT f.*, least(f.d, e.i - f.a) AS k FROM (SELECT *, a + 12 AS from_ FROM far) f ASOF JOIN differs e ON e.file = f.file AND e.d = f.d AND e.i >= f.from_),
spans AS (SELECT g.project_key, g.file, g.first, g.a, g.b, g.k, s1.line AS s1, e1.line AS e1, s2.line AS s2, e2.line AS e2 FROM grown g JOIN pos s1 ON s1.file = g.file AND s1.i = g.a JOIN pos e1 ON e1.file = g.file AND e1.i = g.a + g.k - 1
  JOIN pos s2 ON s2.file = g.file AND s2.i = g.b JOIN pos e2 ON e2.file = g.file AND e2.i = g.b + g.k - 1 WHERE g.k >= 24 AND e1.line - s1.line >= 2 AND e2.line - s2.line >= 2),
block AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k DESC, first, a, b) AS o FROM (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY file, s1, e1, s2, e2 ORDER BY first, a, b) = 1))
"""
#: the longest block that shares no tokens on both sides with one chosen before, five times
_steps, _chosen = [], []
for _i in range(5):
    _free = " ".join(f"AND NOT EXISTS (SELECT 1 FROM {c} c WHERE c.file = b.file AND b.a < c.a + c.k AND c.a < b.a + b.k AND b.b < c.b + c.k AND c.b < b.b + b.k)" for c in _chosen)
    _steps.append(f"b{_i} AS MATERIALIZED (SELECT b.*, {_i} AS rank FROM block b WHERE TRUE {_free} QUALIFY row_number() OVER (PARTITION BY file ORDER BY o) = 1)")
    _chosen.append(f"b{_i}")
BLOCKS = f"{BLOCK_CANDIDATES}, {', '.join(_steps)}, blocks AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM {c}' for c in _chosen)})"
