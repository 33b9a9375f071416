"""Scope, basis and geography around a value, and keys of measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.numbers import has, let, lookup
from factloom.functions.periods import period

# Labels and the words that stand for them.
SCOPES = {"standalone": r"\bstand[- ]?alone\b", "consolidated": r"\bconsolidated\b|\bgroup\s+(?:level|accounts?)\b", "segment": r"\bsegment(?:al)?\b", "company": r"\bcompany[- ]wide\b"}
BASES = {
    "assurance": {"audited": r"\baudited\b", "unaudited": r"\bunaudited\b"},
    "value_status": {"actual": r"\bactuals?\b|\brealised\b|\brealized\b", "forecast": r"\bforecast(?:ed)?\b|\bprojection\b|\bprojected\b", "estimate": r"\bestimate(?:d)?\b", "provisional": r"\bprovisional\b"},
    "price_basis": {"nominal": r"\bnominal\b", "real": r"\breal\b"},
    "adjustment": {"adjusted": r"\badjusted\b|\bnon-gaap\b", "reported": r"\breported\b|\bgaap\b"},
}
GEOGRAPHIES = {"India": r"\bindia(?:n)?\b|\bdomestic\b", "global": r"\bglobal\b|\bworldwide\b"}
# Spellings of one measure.
SYNONYMS = {
    "revenue_from_contracts_with_customers": "revenue_from_operations",
    "total_revenue_from_contracts_with_customers": "revenue_from_operations",
    "revenue_from_customers": "revenue_from_operations",
    "total_revenue_from_customers": "revenue_from_operations",
    "revenues_from_customers": "revenue_from_operations",
    "total_revenue": "revenue_from_operations",
    "gdp_growth": "real_gdp_growth",
    "real_gdp_growth_rate": "real_gdp_growth",
    "real_gdp_percentage_change": "real_gdp_growth",
    "indias_real_gdp_percentage_change": "real_gdp_growth",
}
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēęěğīłńňōőœřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeegilnnooorsstuuuzzz"


#: A part that a text with the label's words has, where it isn't the label itself.
STEMS = {"standalone": ("stand",), "consolidated": ("consolidated", "group"), "company": ("wide",), "actual": ("actual", "reali"), "forecast": ("forecast", "project"), "adjusted": ("adjusted", "gaap"), "reported": ("reported", "gaap"), "India": ("india", "domestic"), "global": ("global", "worldwide")}


def _labels(low: Column, table: dict[str, str]) -> Column:
    """The labels whose words a lower-case text has; a cheap look for their stems comes before the pattern."""
    return F.array_compact(F.array(*(F.when(has(low, *STEMS.get(label, (label,))) & low.rlike(f"(?U){pattern}"), label) for label, pattern in table.items())))


def context(text: Column, publisher: Column | None = None, when: Column | None = None) -> Column:
    """(period, scope, basis, as_of, geography, publisher, qualifiers, warnings, confidence). A group with several labels stays empty and warns.

    when: the text's period, where it is a column already; plans stay smaller that way.
    """
    names = {"scopes": SCOPES, "places": GEOGRAPHIES} | BASES
    found = F.struct(text.alias("text"), (publisher if publisher is not None else F.lit(None)).cast("string").alias("publisher"), (period(text) if when is None else when).alias("when"), *(_labels(F.lower(text), table).alias(k) for k, table in names.items()))
    return let(found, _context)


def _context(x: Column) -> Column:
    when, publisher = x["when"], x["publisher"]
    only = lambda k: F.when(F.size(x[k]) == 1, F.get(x[k], F.lit(0)))
    cue = x["text"].rlike(r"(?iU)\b(?:fy|fiscal|quarter|period|year ended|as of|as at)\b")
    basis = F.nullif(F.concat_ws("; ", *(only(g) for g in BASES)), F.lit(""))
    several = {"scope": F.size(x["scopes"]) > 1} | {k: F.size(x[k]) > 1 for k in BASES}
    nothing = when["kind"].isNull() & only("scopes").isNull() & basis.isNull() & only("places").isNull() & publisher.isNull()
    warnings = F.array_compact(F.array(
        F.when(when["kind"].isNotNull() | cue, when["warning"]), *(F.when(c, f"ambiguous_{k}") for k, c in several.items()), F.when(F.size(x["places"]) > 1, "ambiguous_geography"), F.when(nothing, "missing_context"),
    ))
    doubt = when["kind"].isNull() & cue
    for c in several.values():
        doubt = doubt | c
    qualifiers = F.map_filter(F.create_map(*(y for k in BASES for y in (F.lit(k), only(k))), F.lit("period_kind"), when["kind"]), lambda k, v: v.isNotNull())
    return F.struct(
        F.when(when["label"].isNotNull(), F.struct(when["label"].alias("label"), when["start"].alias("start"), when["end"].alias("end"))).alias("period"),
        only("scopes").alias("scope"), basis.alias("basis"), when["as_of"].alias("as_of"), only("places").alias("geography"), publisher.alias("publisher"), qualifiers.alias("qualifiers"),
        warnings.alias("warnings"), F.when(nothing, 0.45).when(doubt, 0.65).otherwise(0.95).alias("confidence"),
    )


def ascii_text(text: Column) -> Column:
    """Lower case without accents; what has no plain letter goes."""
    return F.regexp_replace(F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


# What a unit note holds, in brackets or after "in".
NOTE = r"\((?:in\s+)?(?:rs\.?|inr|usd|\$)?\s*(?:thousand|lakh|lac|million|mn|crore|cr|billion|bn)s?\)"
NOTED_IN = r"\b(?:amounts? )?in\s+(?:inr|usd|rs\.?)?\s*(?:million|crore|billion|lakh)s?\b"


def measure_key(label: Column) -> Column:
    """The key of a measure's label: snake case, without a unit note, synonyms joined."""
    plain = F.replace(F.replace(ascii_text(label), F.lit("&"), F.lit(" and ")), F.lit("%"), F.lit(" percentage "))
    bare = F.regexp_replace(F.regexp_replace(plain, NOTE, " "), NOTED_IN, " ")

    def keyed(k: Column) -> Column:
        k = F.when(k == "", "unnamed_measure").when(k.rlike("^[a-z]"), k).otherwise(F.concat(F.lit("measure_"), k))
        return let(k, lambda x: F.coalesce(lookup(SYNONYMS, x), x))

    return let(F.btrim(F.regexp_replace(bare, r"[^a-z0-9]+", "_"), F.lit("_")), keyed)
