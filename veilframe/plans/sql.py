"""DuckDB SQL for the rules and generators, built from the same catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from veilframe.functions.types import STANDARD, THRESHOLDS
from veilframe.operators.detect import RULES, Rule
from veilframe.operators.generate import FIRST_NAMES


def quoted(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)


def values(names: str, rows: Sequence[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({names})"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn_sum(d: str) -> str:
    x = f"CAST(substr(reverse({d}), CAST(i AS INT), 1) AS INT)"
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {x} WHEN {x} > 4 THEN {x} * 2 - 9 ELSE {x} * 2 END))"


def luhn(v: str) -> str:
    return f"(length({digits(v)}) BETWEEN 13 AND 19 AND {luhn_sum(digits(v))} % 10 = 0)"


def mod97(code: str) -> str:
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) - 48 AS INT) ELSE CAST(ascii(c) - 55 AS INT) END"
    return f"list_reduce(list_concat([0], list_transform(string_split({code}, ''), lambda c: {value})), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END)"


def iban(v: str) -> str:
    c = f"upper(regexp_replace({v}, '[ -]', '', 'g'))"
    return f"CASE WHEN regexp_full_match({c}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') THEN {mod97(f'(substr({c}, 5) || substr({c}, 1, 4))')} = 1 ELSE FALSE END"


def entropy(v: str) -> str:
    p = f"(len(list_filter(string_split({v}, ''), lambda y: y = c)) / CAST(strlen({v}) AS DOUBLE))"
    return f"CASE WHEN {v} = '' THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: {p} * log2({p}))) END"


def secret(v: str) -> str:
    kinds = " + ".join(f"CAST(regexp_matches({v}, '{p}') AS INT)" for p in (r"\p{Lu}", r"\p{Ll}", "[0-9]", r"[^\p{L}\p{N}]"))
    return f"(strlen({v}) >= 12 AND {kinds} >= 3 AND {entropy(v)} > 3.5)"


CHECKS = {"iban": iban, "card": luhn, "password": secret}


def candidates(table: str, key: str, text: str, rules: Sequence[Rule] = RULES) -> str:
    """(id, p, s, e, t, v): every rule's valid matches, with places from the lengths of gaps and matches."""
    parts = []
    for i, r in enumerate(rules):
        pattern = quoted(r.plain or r.pattern)
        value = f"regexp_extract(m[i], {pattern}, {r.suffix_group})" if r.suffix_group else "m[i]"
        check = f"WHERE {CHECKS[r.name]('v')}" if r.name in CHECKS else ""
        size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
        parts.append(
            f"SELECT id, {i} AS p, CAST(e - length(v) AS INT) AS s, CAST(e AS INT) AS e, '{r.entity_type}' AS t, v FROM (SELECT id, {value} AS v, {size('g[1:i]')} + {size('m[1:i]')} AS e "
            f"FROM (SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key} AS id, regexp_extract_all({text}, {pattern}) AS m, string_split_regex({text}, {pattern}) AS g FROM {table} WHERE regexp_matches({text}, {pattern})))) {check}"
        )
    return "\nUNION ALL ".join(parts)


def entities(table: str, key: str, text: str, rules: Sequence[Rule] = RULES) -> str:
    """(id, p, s, e, t, v) of the fold by priority."""
    return f"""(WITH cand AS ({candidates(table, key, text, rules)}),
ordered AS (SELECT id, list([{{'p': p, 's': s, 'e': e, 't': t, 'v': v}}] ORDER BY p, s) AS c FROM cand GROUP BY id),
kept AS (SELECT id, list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.s < x[1].e AND x[1].s < k.e)) > 0 THEN acc ELSE list_concat(acc, x) END) AS k FROM ordered)
SELECT id, x.p AS p, x.s AS s, x.e AS e, x.t AS t, x.v AS v FROM (SELECT id, unnest(k) AS x FROM kept))"""


def seed(salt: str, kind: str, original: str) -> str:
    return f"md5(concat_ws('|', '{salt}', {kind}, {original}))"


def number(s: str, name: str, least: int, count: int) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {s}, {name})), 1, 8) AS BIGINT) % {count} + {least})"


def prefix(ip: str) -> str:
    return f"array_to_string(list_transform(string_split({ip}, '.')[1:3], lambda o: CAST(CAST(o AS INT) AS VARCHAR)), '.')"


def pseudonym(t: str, v: str, salt: str) -> str:
    """Of e-mail addresses, IPv4 addresses, phones and cards."""
    s = seed(salt, t, v)
    pool = "[" + ", ".join(f"'{n.lower()}'" for n in FIRST_NAMES) + "]"
    email = f"{pool}[CAST({number(s, chr(39) + 'name' + chr(39), 1, len(FIRST_NAMES))} AS INT)] || CAST({number(s, chr(39) + 'e' + chr(39), 10, 999990)} AS VARCHAR) || '@example.com'"
    net = seed(salt, "'NETWORK'", prefix(v))
    octets = " || '.' || ".join(f"CAST({number(net, quoted(f'o{k}'), 1, 254)} AS VARCHAR)" for k in range(3))
    phone = f"array_to_string(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN substr({v}, CAST(i AS INT), 1) BETWEEN '0' AND '9' THEN CAST({number(s, chr(39) + 'd' + chr(39) + ' || CAST(i - 1 AS VARCHAR)', 0, 10)} AS VARCHAR) ELSE substr({v}, CAST(i AS INT), 1) END), '')"
    body = f"('4' || array_to_string(list_transform(range(1, 15), lambda j: CAST({number(s, chr(39) + 'c' + chr(39) + ' || CAST(j AS VARCHAR)', 0, 10)} AS VARCHAR)), ''))"
    check = f"CAST((10 - {luhn_sum(f'({body} || {chr(39)}0{chr(39)})')} % 10) % 10 AS VARCHAR)"
    return f"CASE {t} WHEN 'EMAIL' THEN {email} WHEN 'IP_ADDRESS' THEN {octets} || '.' || string_split({v}, '.')[4] WHEN 'PHONE_NUMBER' THEN {phone} WHEN 'CREDIT_CARD' THEN {body} || {check} END"


def threshold(t: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items()) + f" ELSE {STANDARD} END"
