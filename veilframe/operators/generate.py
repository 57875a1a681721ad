"""Deterministic pseudonyms of the same kind as what they stand for.

All numbers come from md5 of salt, type and original, so a task that runs again gives the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.spans import let
from veilframe.functions.validators import ip_host, ip_prefix, luhn_check_digit, mod97

FIRST_NAMES = tuple(
    "Adele Alban Alice Amaury Anouk Armand Aurore Basile Bianca Bruno Camille Cedric Celeste Clovis Colette Damien Diane Edgar Elise Emile Estelle Fabien Flora Gaspard "
    "Gisele Hector Helene Igor Ines Jonas Judith Karl Lea Leon Lucie Malo Margot Nadia Nestor Oceane Octave Pauline Quentin Rachel Remi Sabine Simon Thelma Ugo Violette".split()
)
LAST_NAMES = tuple(
    "Abadie Arnoux Aubry Barbier Baudin Bessac Bouvet Cadet Carlier Chapuis Clavel Cordier Dalbert Delmas Dornier Duclos Escande Fabre Faucher Ferrand Gallet Garnier Gibert Grangier "
    "Hamelin Hubert Jacquet Joubert Kerval Lacaze Lambot Leduc Lormier Magnan Marchal Maurin Moulin Naudet Olivet Pasquier Perrot Quenet Ravel Rigaud Sabatier Tessier Tourneur Vallet Verdier Vidal".split()
)
STREET, TOWN = "rue des Tilleuls", "59000 Lille"
#: Beginnings of keys that a pseudonym keeps.
KEY_PREFIXES = ("sk-ant-", "sk-proj-", "sk-", "sk_live_", "sk_test_", "pk_live_", "pk_test_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "AKIA", "ASIA", "ABIA", "ACCA", "eyJ")
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def seed(salt: str, entity_type: Column, original: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(salt), entity_type, original))


def number(s: Column, name: str | Column, least: int, count: int) -> Column:
    """A number from least on, of count, by a seed and the name of its use."""
    name = F.lit(name) if isinstance(name, str) else name
    return (F.conv(F.substring(F.md5(F.concat_ws(":", s, name)), 1, 8), 16, 10).cast("long") % count + least).cast("long")


def _each(text: Column, change) -> Column:
    """text with change(character, position) in place of each character."""
    return F.array_join(F.transform(F.split(text, ""), change), "")


def same_format(s: Column, original: Column) -> Column:
    """Other digits in place of digits, all else as it is."""
    return _each(original, lambda c, i: F.when(c.rlike("[0-9]"), number(s, F.concat(F.lit("d"), i.cast("string")), 0, 10).cast("string")).otherwise(c))


def some_digits(s: Column, name: str, count: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: number(s, F.concat(F.lit(name), i.cast("string")), 0, 10).cast("string")), "")


def pool_name(s: Column, pool: tuple[str, ...], original: Column) -> Column:
    """A name of the pool, but the next one if it is the original."""
    names, at = F.array(*map(F.lit, pool)), number(s, "name", 0, len(pool)).cast("int")
    return let(F.element_at(names, at + 1), lambda n: F.when(F.lower(n) == F.lower(original), F.element_at(names, (at + 1) % len(pool) + 1)).otherwise(n))


def card(s: Column) -> Column:
    return let(F.concat(F.lit("4"), some_digits(s, "c", 14)), lambda p: F.concat(p, luhn_check_digit(p)))


def iban(s: Column) -> Column:
    return let(some_digits(s, "i", 23), lambda b: F.concat(F.lit("FR"), F.lpad((98 - mod97(F.concat(b, F.lit("FR00")))).cast("string"), 2, "0"), b))


def key(s: Column, original: Column) -> Column:
    """A known beginning kept, then as many letters and digits as there were characters."""
    pattern = "^(?:" + "|".join(KEY_PREFIXES) + ")"
    kept = F.regexp_extract(original, pattern, 0)
    rest = lambda i: F.substring(F.lit(_ALNUM), number(s, F.concat(F.lit("k"), i.cast("string")), 1, len(_ALNUM)).cast("int"), F.lit(1))
    size = F.length(original) - F.length(kept)
    return F.concat(kept, F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), rest), "")).otherwise(""))


def network(salt: str, original: Column) -> Column:
    """The pseudonymous first three octets, each 1 to 254, of an IPv4 address's network: one for each network."""
    s = seed(salt, F.lit("NETWORK"), ip_prefix(original))
    return F.concat_ws(".", *(number(s, f"o{k}", 1, 254).cast("string") for k in range(3)))


def pseudonym(entity_type: Column, original: Column, salt: str = "") -> Column:
    """What stands for original. Addresses of one network stay in one network, and keep their host octet."""
    s = seed(salt, entity_type, original)
    n = lambda name, least, count: number(s, name, least, count).cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    first = pool_name(s, FIRST_NAMES, original)
    v6 = text("fd00::", F.lower(F.hex(number(s, "a", 1, 0xFFFE))), ":", F.lower(F.hex(number(s, "b", 1, 0xFFFE))))
    v4 = F.when(ip_prefix(original).isNotNull(), F.concat_ws(".", network(salt, original), ip_host(original))).otherwise(text("10.0.", n("a", 1, 254), ".", n("b", 1, 254)))
    return (
        F.when(entity_type.isin("GIVEN_NAME", "PERSON_NAME"), first)
        .when(entity_type == "SURNAME", pool_name(s, LAST_NAMES, original))
        .when(entity_type == "EMAIL", text(F.lower(first), n("e", 10, 999990), "@example.com"))
        .when(entity_type == "IP_ADDRESS", F.when(F.contains(original, F.lit(":")), v6).otherwise(v4))
        .when(entity_type.isin("PHONE_NUMBER", "NATIONAL_ID", "TAX_NUMBER", "DRIVER_LICENSE"), same_format(s, original))
        .when(entity_type == "CREDIT_CARD", card(s))
        .when(entity_type.isin("IBAN", "ACCOUNT_NUMBER"), iban(s))
        .when(entity_type.isin("API_KEY", "PASSWORD"), key(s, original))
        .when(entity_type == "USERNAME", text("user_", F.lower(first), n("u", 10, 89)))
        .when(entity_type == "STREET", text(n("s", 1, 199), f" {STREET}"))
        .when(entity_type == "CITY", text("Villeneuve-", n("v", 1, 99999)))
        .when(entity_type == "ZIP_CODE", n("z", 10000, 89999))
        .when(entity_type == "DATE_OF_BIRTH", F.format_string("%02d/%02d/%d", number(s, "d", 1, 27), number(s, "m", 1, 11), number(s, "y", 1950, 55)))
        .when(entity_type.isin("INTERNAL_URL", "SERVER_NAME"), text("https://internal-", n("h", 1, 99999), ".example.com"))
        .when(entity_type == "FILE_PATH", text("/path/to/file-", n("f", 1, 99999)))
        .when(entity_type == "POSTAL_ADDRESS", text(n("p", 1, 199), f" {STREET}, {TOWN}"))
        .otherwise(text("[PSEUDO-", n("x", 1000, 8999), "]"))
    )
