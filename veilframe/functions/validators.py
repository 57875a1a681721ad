"""Checks and small scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.spans import let

#: Host names that are never upstreams, and beginnings of private and metadata addresses.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1", "[::1]", "0.0.0.0")
PRIVATE_PREFIXES = ("10.", "192.168.", *(f"172.{n}." for n in range(16, 32)), "169.254.")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Luhn's sum of a string of digits."""

    def value(d: Column, i: Column) -> Column:
        return let(d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x))

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), lambda a, x: a + x)


def luhn_valid(s: Column, least: int = 13, most: int = 19) -> Column:
    """Whether the digits of s pass Luhn's check and are least to most in number."""
    return let(digits(s), lambda d: F.when(F.length(d).between(least, most), luhn_sum(d) % 10 == 0).otherwise(False))


def luhn_check_digit(partial: Column) -> Column:
    return ((10 - luhn_sum(F.concat(partial, F.lit("0"))) % 10) % 10).cast("string")


def mod97(code: Column) -> Column:
    """The remainder of a string of digits and capital letters, A being 10, by 97."""
    return F.aggregate(F.split(code, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.try_cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def iban_valid(s: Column) -> Column:
    """15 to 34 letters and digits without spaces and hyphens, country and check digits first, remainder 1 by 97."""
    clean = F.upper(F.regexp_replace(s, "[ -]", ""))
    return let(clean, lambda c: F.when(c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), mod97(F.concat(F.substring(c, 5, 34), F.substring(c, 1, 4))) == 1).otherwise(False))


def shannon_entropy(s: Column) -> Column:
    """Bits for each character; counts are of characters but shares of bytes. 0 for an empty string."""
    chars = F.split(s, "")
    share = lambda all_, c: F.size(F.filter(all_, lambda x: x == c)) / F.octet_length(s)
    total = let(chars, lambda all_: F.aggregate(F.array_distinct(all_), F.lit(0.0), lambda a, c: let(share(all_, c), lambda p: a - p * F.log2(p))))
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(total)


def looks_like_secret(s: Column) -> Column:
    """12 bytes, over 3.5 bits for each character, and three of: upper case, lower case, digit, other."""
    kinds = [s.rlike(p).cast("int") for p in (r"\p{Lu}", r"\p{Ll}", r"[0-9]", r"[^\p{L}\p{N}]")]
    return (F.octet_length(s) >= 12) & (kinds[0] + kinds[1] + kinds[2] + kinds[3] >= 3) & (shannon_entropy(s) > 3.5)


def ip_prefix(ip: Column, octets: int = 3) -> Column:
    """The first octets of an IPv4 address without leading zeros; null for what isn't one."""
    parts = F.transform(F.slice(F.split(ip, r"\."), 1, octets), lambda p: p.cast("int").cast("string"))
    return F.when(ip.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), F.array_join(parts, "."))


def ip_host(ip: Column, octets: int = 3) -> Column:
    return F.array_join(F.slice(F.split(ip, r"\."), octets + 1, 4), ".")


def format_size(n: Column) -> Column:
    """Bytes as B, or as KB or MB with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def url_verdict(url: Column) -> Column:
    """ok, or why a URL must not be called: unparseable, scheme, empty_host, local, private."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    private = F.lit(False)
    for prefix in PRIVATE_PREFIXES:
        private = private | F.startswith(host, F.lit(prefix))
    return (
        F.when(scheme.isNull(), "unparseable")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host.isNull() | (host == ""), "empty_host")
        .when(host.isin(*LOCAL_HOSTS), "local")
        .when(private, "private")
        .otherwise("ok")
    )


def provider_of(path: Column) -> Column:
    """The provider that a request path is for: a, b or null."""
    b = F.startswith(path, F.lit("/v1/chat/completions")) | F.startswith(path, F.lit("/v1/embeddings")) | F.startswith(path, F.lit("/v1/models"))
    return F.when(F.startswith(path, F.lit("/v1/messages")), "a").when(b, "b")


def upstream_url(base: Column, path: Column) -> Column:
    """base without slashes at its end, and path; null unless http or https."""
    url = F.concat(F.regexp_replace(base, "/+$", ""), path)
    return F.when(url.rlike("^https?://"), url)


def register(spark: SparkSession) -> None:
    """SQL functions of the same names."""
    number = "regexp_replace(s, '[^0-9]', '')"
    doubled = f"transform(split(reverse({number}), ''), (d, i) -> CASE WHEN i % 2 = 1 AND int(d) > 4 THEN int(d) * 2 - 9 ELSE int(d) * (1 + i % 2) END)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION luhn_valid(s STRING) RETURNS BOOLEAN RETURN CASE WHEN length({number}) BETWEEN 13 AND 19 THEN aggregate({doubled}, 0, (a, x) -> a + x) % 10 = 0 ELSE false END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION format_size(n BIGINT) RETURNS STRING RETURN CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN format_string('%.1f KB', n / 1024) ELSE format_string('%.1f MB', n / 1048576) END")
