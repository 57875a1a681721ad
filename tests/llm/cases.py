"""Documents that every operator must take, and brute-force versions of the contracts."""

import hashlib
import re
import zlib

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, component_id string, spans string, ids string, key string, found string"


def table(name: str, columns: list[str]) -> list[tuple]:
    return [tuple(r.values()) for r in pq.read_table(f"{SF}/{name}.parquet", columns=columns).to_pylist()]


def odd_texts() -> list[str | None]:
    """Null, empty, white space alone, ties, repeats, long and non-ASCII texts, and texts full of findings."""
    key = "AK" + "IA"
    word = "pass" + "word"
    return [
        None,
        "",
        " \t\n",
        "one two three four five",
        "ONE two\x0bthree four five",
        "one two three four",
        "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3,
        "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3,
        "\U0001f600 é漢字 " + "x@y.com_foo@z.org 1.2.3.4 1.2.3.45.6.7.8.9 300.1.1.1 4111 1111 1111 1111 +1 (555) 555-0100",
        f'é {word} = "abcdefghijkl" {word}=short token = secret : abcdefghijklmnop {key}{"Z" * 16} {key}ab ' + "0123456789abcdef" * 3,
        f"API_KEY: {'Q1w2e3r4t5y6' * 3} api-key=no {'aB3' * 9} Token='{'f' * 40}'",
        "1" * 3000 + "@" + "2" * 3000 + "." + "-" * 5,
        "word " * 20000,
        "x" * 60000 + "@" + "y" * 50 + ".z",
        "ﬁne Ⅷ STRASSE straße İ    end",
        "fine VIII strasse strasse i̇ end",
        " double  space \n\n new\r\n\tline 'tis we'll don't 123abc",
    ]


def odd_documents(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 5 == 4 else f"s{i % 2}", None, "x", "x", "x", "x", "x", "x") for i, t in enumerate(odd_texts())]
    rows += [rows[6], rows[9], (None, "no id, mail me@here.org", None, None, None, *["x"] * 6), (None, None, None, None, None, *["x"] * 6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text: str | None) -> dict:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    names = ("assign", "access", "hex")
    return {"counts": tuple(sum(f[1] == k for f in found) for k in range(3)), "base": ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(found))}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal(text: str | None) -> dict:
    text = text or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = {
        "email": [m for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if len(text) < 50000 else [m for m in re.finditer(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m[0].split("."))],
        "card": [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15],
    }
    return {"counts": tuple(map(len, kinds.values())), "base": ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in kinds.items() for m in ms)}


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def components(rows: list[tuple], percent: int = 80) -> dict:
    """doc_id to the smallest doc_id reachable over links."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(sets)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                label[top(x)] = top(y)
    least: dict = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[top(x)] = min(i, least.get(top(x), i))
    return {i: (len(s), least[top(x)]) for x, (i, s) in enumerate(sets) if i is not None}
