"""DuckDB SQL of the span operators' queries."""

from __future__ import annotations

from veilframe.llm import pii


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _size(x: str) -> str:
    return f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"


def places(rows: str, text: str, keep: str, pattern: str, more: str = "") -> str:
    """keep's columns, i, s and v of each match of pattern in text, and more from the lists m (matches) and g (gaps)."""
    p = _quoted(pattern)
    return (
        f"SELECT {keep}, CAST({_size('g[1:i]')} + {_size('m[1:i - 1]')} AS BIGINT) AS s, m[i] AS v{more} FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i "
        f"FROM (SELECT {keep}, regexp_extract_all({text}, {p}) AS m, string_split_regex({text}, {p}) AS g FROM {rows} WHERE regexp_matches({text}, {p})))"
    )


#: Fixed values of the contract, in this dialect and apart from those of the operator.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_LOOSE = "[A-Za-z0-9+/_-]{24,}"


def _secret_kinds() -> str:
    value = f"regexp_extract(v, {_quoted(_ASSIGN)}, 2)"
    of = lambda pattern: places("documents", "text", "doc_id, source", pattern)
    mixed = "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')"
    kinds = [("assign", of(_ASSIGN), value, f"length({value}) >= 12"), ("access", of("AKIA[A-Z0-9]+"), "v", "length(v) >= 18"), ("hex", of("[0-9a-f]+"), "v", "length(v) >= 16"), ("live", of(_LOOSE), "v", mixed)]
    return "\nUNION ALL ".join(f"SELECT doc_id, source, {k} AS k, '{kind}' AS kind, s, s + length(v) AS e, {val} AS val FROM ({rows}) WHERE {check}" for k, (kind, rows, val, check) in enumerate(kinds))


SECRETS = f"""
WITH c AS ({_secret_kinds()}),
o AS (SELECT val, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners, count(DISTINCT (source, doc_id)) AS repositories FROM c GROUP BY val),
v AS (SELECT val, owners = 1 AND repositories < 50 AS live, owners >= 3 OR repositories >= 50 AS example FROM o),
j AS (SELECT doc_id, k, s, kind || ':' || s || ':' || e AS span, val, live, example FROM c JOIN v USING (val) WHERE k < 3 OR live),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans,
    count(DISTINCT val) FILTER (live) AS live, count(DISTINCT val) FILTER (example) AS example FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live, 0) AS n_live, coalesce(example, 0) AS n_example
FROM documents LEFT JOIN a USING (doc_id)
"""

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_DIGIT = f"CAST(substr(reverse({_DIGITS}), CAST(i AS INT), 1) AS INT)"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGIT} WHEN {_DIGIT} > 4 THEN {_DIGIT} * 2 - 9 ELSE {_DIGIT} * 2 END)) % 10 = 0"


def _entities() -> str:
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}", r"[0-9](?:[\x20-]?[0-9])+", pii.PHONE]
    checks = ["TRUE", f"regexp_full_match(v, {_quoted(pii._OCTET + '(?:[.]' + pii._OCTET + '){3}')})", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}", f"length({_DIGITS}) BETWEEN 8 AND 15"]
    near = f", right(g[i], {pii.CONTEXT}) AS b, left(g[i + 1], {pii.CONTEXT}) AS a"
    return "\nUNION ALL ".join(f"SELECT doc_id, {k} AS k, '{pii.KINDS[k]}' AS kind, s, s + length(v) AS e, v, b, a FROM ({places('documents', 'text', 'doc_id', p, near)}) WHERE {c}" for k, (p, c) in enumerate(zip(patterns, checks, strict=True)))


_SIDE = "doc_id, ent, beg, cut"
PERSONAL = f"""
WITH x AS ({_entities()}),
w AS (SELECT doc_id, ent, beg + s AS s, beg + s + length(v) AS e, lower(v) AS t FROM ({places("(SELECT doc_id, v AS ent, s - length(b) AS beg, length(b) >= " + str(pii.CONTEXT) + " AS cut, b FROM x)", "b", _SIDE, pii.WORD)}) WHERE NOT cut OR s > 0
UNION ALL SELECT doc_id, ent, beg + s AS s, beg + s + length(v) AS e, lower(v) AS t FROM ({places("(SELECT doc_id, v AS ent, e AS beg, length(a) AS cut, a FROM x)", "a", _SIDE, pii.WORD)}) WHERE cut < {pii.CONTEXT} OR s + length(v) < cut),
held AS (SELECT v AS ent, count(DISTINCT doc_id) AS n_v FROM x GROUP BY v),
pairs AS (SELECT ent, t, count(DISTINCT doc_id) AS n_both FROM w GROUP BY ent, t HAVING count(DISTINCT doc_id) >= {pii.SUPPORT}),
known AS (SELECT t, count(*) AS n_t FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), {_quoted(pii.WORD)}))) AS t FROM documents) GROUP BY t),
share AS (SELECT ent, t, log2(least(n_both / greatest(n_t, n_both), 1.0)) AS p, log2((SELECT count(*) FROM documents) / n_v) AS bits FROM pairs JOIN held USING (ent) JOIN known USING (t)),
told AS (SELECT ent, t FROM share WHERE bits > 0 AND (p + bits) / bits >= {pii.GENERALISE}),
terms AS (SELECT DISTINCT doc_id, s, e FROM w JOIN told USING (ent, t) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = w.doc_id AND x.s < w.e AND w.s < x.e)),
spans AS (SELECT doc_id, k, s, kind || ':' || s || ':' || e AS span FROM x UNION ALL SELECT doc_id, 4, s, 'term:' || s || ':' || e FROM terms),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3, string_agg(span, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg(span, ',' ORDER BY k, s) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)
"""
