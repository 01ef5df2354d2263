"""Column expressions on hostnames, addresses and attribute values; and the same as SQL text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def valid_hostname(c: Column) -> Column:
    c = F.lower(c)
    return F.coalesce((F.length(c) <= 253) & c.rlike(K.HOSTNAME), F.lit(False))


def looks_like_hostname(c: Column) -> Column:
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= 253) & ~c.contains(" ") & c.rlike(K.LOOSE_HOSTNAME), F.lit(False))


def octets_in_range(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda o: o.try_cast("int").between(0, 255))


def valid_ip(c: Column) -> Column:
    """IPv4 with octets in range, or eight groups of an IPv6 address."""
    return F.coalesce(F.when(c.rlike(K.IPV4), octets_in_range(c)).otherwise(c.rlike(K.IPV6)), F.lit(False))


def four_octets(c: Column) -> Column:
    """Four parts that parse as integers from 0 to 255; blanks and a sign are let pass."""
    parts = F.split(c, r"\.")
    return F.coalesce((F.size(parts) == 4) & F.forall(parts, lambda o: F.coalesce(F.trim(o).try_cast("int").between(0, 255), F.lit(False))), F.lit(False))


def ip_shaped(c: Column) -> Column:
    return F.coalesce(c.rlike(K.IPV4), F.lit(False))


def any_contains(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def first_keyword(c: Column, rules: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The first rule in order one of whose keywords is in c."""
    out = F.lit(default).cast("string")
    for name, words in reversed(rules):
        out = F.when(any_contains(c, words), name).otherwise(out)
    return out


def subnet(ip: Column) -> Column:
    return F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))


def datacenter(hostname: Column, ip: Column) -> Column:
    """By keyword, else by the second octet of a 10.x address."""
    octet = F.split(ip, r"\.")[1].try_cast("int")
    by_ip = F.lit("unknown")
    for bound, region in reversed(K.REGION_OCTETS):
        by_ip = F.when(octet < bound, region).otherwise(by_ip)
    return F.coalesce(first_keyword(F.lower(hostname), K.REGIONS), F.when(ip.startswith("10."), by_ip), F.lit("unknown"))


def present(c: Column) -> Column:
    return F.coalesce((c != "") & (c != "unknown"), F.lit(False))


def abstracted(c: Column) -> Column:
    """Digits as #, then long runs of hex letters as HEX."""
    return F.regexp_replace(F.regexp_replace(c, r"\d+", "#"), "[a-f0-9]{8,}", "HEX")


def sanitized(name: Column) -> Column:
    """A column name of word characters, not led by a digit, of 64 characters at most."""
    plain = F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")
    return F.lower(F.substring(F.when(plain.rlike(r"^\d"), F.concat(F.lit("col_"), plain)).otherwise(plain), 1, 64))


def attribute_type(c: Column) -> Column:
    """json, numeric, date, boolean or text, the first that fits."""
    json = F.try_parse_json(c).isNotNull() & ~c.rlike(r"^\s*'|^\s*$")
    numeric = c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$") | F.lower(F.trim(c)).isin("inf", "+inf", "-inf", "infinity", "nan")
    date = c.rlike(r"^\d{4}-\d{2}-\d{2}")
    boolean = F.lower(c).isin("true", "false", "yes", "no", "1", "0")
    return F.when(json, "json").when(numeric, "numeric").when(date, "date").when(boolean, "boolean").otherwise("text")


# The same as DuckDB SQL


def sql_first_keyword(c: str, rules: list[tuple[str, list[str]]], default: str = "NULL") -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains({c}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules)
    return f"CASE {cases} ELSE {default} END"


def sql_valid_hostname(c: str) -> str:
    return f"coalesce(length({c}) <= 253 AND regexp_matches(lower({c}), '{K.HOSTNAME}'), false)"


def sql_valid_ip(c: str) -> str:
    octets = f"list_bool_and(list_transform(string_split({c}, '.'), lambda o: try_cast(o AS INT) BETWEEN 0 AND 255))"
    return f"coalesce(CASE WHEN regexp_matches({c}, '{K.IPV4}') THEN {octets} ELSE regexp_matches({c}, '{K.IPV6}') END, false)"


def sql_datacenter(hostname: str, ip: str) -> str:
    cases = " ".join(f"WHEN try_cast(split_part({ip}, '.', 2) AS INT) < {bound} THEN '{region}'" for bound, region in K.REGION_OCTETS)
    return f"coalesce({sql_first_keyword(f'lower({hostname})', K.REGIONS)}, CASE WHEN starts_with({ip}, '10.') THEN CASE {cases} ELSE 'unknown' END END, 'unknown')"


def sql_present(c: str) -> str:
    return f"coalesce({c} <> '' AND {c} <> 'unknown', false)"


def sql_hashed_embedding(text: str, size: int) -> str:
    padded = f"('^' || lower({text}) || '$')"
    slots = f"list_transform(range(1, length({padded}) - 1), lambda k: ('0x' || left(md5(substr({padded}, k, 3)), 8))::BIGINT % {size})"
    return f"list_transform(range({size}), lambda x: len(list_filter({slots}, lambda s: s = x))::FLOAT)"
