"""DuckDB SQL of the corpus queries that SQL can express, and of the part of others that it can."""

from __future__ import annotations

import string

from .hmm import ADD
from .urls import RULES

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
#: Words as the contracts define them.
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
# fixed value: the reversed polynomial of crc32
_STEP = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"


def crc32(text: str) -> str:
    """crc32 of an ASCII text."""
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: {_STEP}), 4294967295)"


def suffix_dedup(span: int = 100) -> str:
    """op8: every byte window, the later ones of equal windows, their union, and what is left."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, s, substr(h, 2 * s + 1, {2 * span}) AS x FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {span - 1})) AS s FROM d WHERE length(h) >= {2 * span})),
 k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM w),
 m AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {span} THEN 0 ELSE 1 END AS fresh FROM k WHERE k > 1),
 g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM m),
 c AS (SELECT doc_id, min(s) AS lo, max(s) + {span} AS hi FROM g GROUP BY doc_id, g),
 p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM c),
 q AS (SELECT doc_id, sum(p.hi - p.lo)::BIGINT AS gone, count(*) AS spans, max(hi) AS last, string_agg(substr(d.h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)"""


def near_duplicates(size: int = 3, percent: int = 85) -> str:
    """op9: all pairs that share a shingle, links, and what is reachable through them."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size - 2}), lambda i: {gram}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM t),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= {percent} * (na.n + nb.n - k)),
 e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e2.b FROM r JOIN e2 ON e2.a = r.b),
 c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def base_scores() -> str:
    """What op10 returns but for the model's own score."""
    return f"""
WITH t AS (SELECT doc_id, {crc32("doc_id::VARCHAR")} % 10 = 0 AS held_out, list_append({_WORDS}, chr(10)) AS w FROM documents),
 u AS (SELECT doc_id, held_out, unnest(w) AS token FROM t),
 k AS (SELECT token, count(*) FILTER (NOT held_out) AS c FROM u GROUP BY token),
 one AS (SELECT sum(c)::BIGINT AS n, count(*) FILTER (c > 0) AS v FROM k)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens,
 round(sum(log10((c + {ADD}) / (n + {ADD} * (v + 1)))), 4) AS base_score FROM u JOIN k USING (token), one GROUP BY doc_id"""


def url_rules() -> str:
    """What op3 returns but for the verdicts of urls that no rule fits."""
    path = "regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*')"
    host = f"translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))

    def case(value: str) -> str:
        fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}'" for kind, h, p in order for v in [kind if value == "given" else h + p])
        return f"CASE {fits} END AS {value}"

    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 b AS (SELECT page_id, {host} AS host, {path} AS path FROM a)
SELECT page_id, host, path, {case("rule")}, {case("given")} FROM b"""
