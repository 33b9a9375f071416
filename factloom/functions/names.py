"""Names, identifiers and free text of entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.context import ascii_text
from factloom.functions.numbers import lookup

# Titles, company suffixes, schemes by priority and types by alias.
TITLES = "mr|mrs|ms|miss|dr|prof"
SUFFIXES = "co|company|corp|corporation|inc|incorporated|limited|ltd|llp|plc|private|pvt"
SCHEMES = ("din", "cin", "lei", "ticker", "registration", "registration_number")
TYPES = {"person": "person", "director": "person", "individual": "person", "company": "company", "organisation": "company", "organization": "company", "place": "place", "country": "place", "geography": "place"}


def display_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.trim(name), rf"(?i)^(?:(?:{TITLES})\.?\s+)+", ""), r"\s+", " "), F.lit(" ,;:.-"))


def name_key(name: Column) -> Column:
    """Plain lower-case tokens, without company suffixes at the end; all tokens if nothing else is left."""
    tokens = F.trim(F.regexp_replace(ascii_text(display_name(name)), "[^a-z0-9]+", " "))
    short = F.trim(F.regexp_replace(tokens, rf"(?:(?:^| )(?:{SUFFIXES}))+$", ""))
    return F.when(short != "", short).otherwise(tokens)


def entity_type(kind: Column) -> Column:
    key = F.lower(F.trim(kind))
    return F.coalesce(lookup(TYPES, key), F.when(key != "", key), F.lit("unknown"))


def scheme_key(scheme: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(scheme), "[^a-z0-9]+", "_"), F.lit("_"))


def identifier(scheme: Column, value: Column) -> Column:
    """DIN: digits to eight places; CIN and LEI: upper case without marks; else trimmed."""
    compact = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    return F.when(scheme == "din", F.lpad(F.regexp_replace(value, "[^0-9]", ""), 8, "0")).when(scheme.isin("cin", "lei", "ticker"), compact).otherwise(F.trim(value))


def identifier_conflicts(left: Column, right: Column) -> Column:
    """Schemes that both maps have with different values, sorted."""
    both = F.map_zip_with(left, right, lambda k, a, b: a.isNotNull() & b.isNotNull() & (a != b))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda k, v: v)))


def text_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_text(text), "[^a-z0-9]+", " "))


def unique_text(values: Column) -> Column:
    """Without later spellings that differ in case only."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)) | x.isNull(), kept).otherwise(F.array_append(kept, x)))


def redacted(text: Column, most: int = 500) -> Column:
    """Without what looks like credentials, cut to a length."""
    return F.substring(F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password|authorization)\b(\s*[=:]\s*)\S+", "$1$2[redacted]"), 1, most)


def short_hash(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256), 1, 24))
