"""Numbers with scale, unit and currency, as native column expressions.

A parsed value is a struct: number DECIMAL(37,10), reported DECIMAL(24,8), dp (displayed
decimals), scale, unit, reported_unit, currency, approximate, warning, confidence. dp is kept
because a tolerance follows from what was displayed, which a decimal type forgets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale words, currency marks and units.
SCALES = {
    "thousand": 1_000, "thousands": 1_000, "k": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000,
    "million": 1_000_000, "millions": 1_000_000, "mn": 1_000_000, "crore": 10_000_000, "crores": 10_000_000, "cr": 10_000_000,
    "billion": 1_000_000_000, "billions": 1_000_000_000, "bn": 1_000_000_000,
}
CURRENCIES = {"₹": "INR", "inr": "INR", "rs": "INR", "rs.": "INR", "$": "USD", "usd": "USD", "us$": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP"}
CURRENCY_UNITS = {"INR": "rupee", "USD": "US dollar", "EUR": "euro", "GBP": "pound sterling"}
UNITS = {
    "km": "kilometre", "kilometer": "kilometre", "kilometers": "kilometre", "kilometre": "kilometre", "kilometres": "kilometre",
    "kg": "kilogram", "kilogram": "kilogram", "kilograms": "kilogram", "ton": "tonne", "tons": "tonne", "tonne": "tonne", "tonnes": "tonne",
    "metric ton": "tonne", "metric tons": "tonne", "metric tonne": "tonne", "metric tonnes": "tonne",
    "shipment": "shipment", "shipments": "shipment", "employee": "employee", "employees": "employee",
    "day": "day", "days": "day", "month": "month", "months": "month", "year": "year", "years": "year",
}

NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d+)?"
PERCENT = r"(?iU)%|\bpercent(?:age)?\b|\bpct\b|\bper cent\b"
BASIS_POINT = r"(?iU)\bbps?\b|\bbasis points?\b"
TIMES = r"(?iU)(?:\d|\s)x\s*$"
SCHEMA = "struct<number:decimal(37,10),reported:decimal(24,8),dp:int,scale:decimal(12,2),unit:string,reported_unit:string,currency:string,approximate:boolean,warning:string,confidence:double>"


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once; keeps plans and generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Columns made so far, by session's JVM, maker and column names.
_made: dict[tuple, Column] = {}


def reused(make: Callable[..., Column], *names: str) -> Column:
    """make(columns of these names), built once a process: the large expressions here take seconds of calls to the JVM, and are the same for every table."""
    key = (id(SparkContext._active_spark_context), make.__module__, make.__qualname__, names)
    if key not in _made:
        _made[key] = make(*map(F.col, names))
    return _made[key]


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words_array(words: Iterable[str]) -> Column:
    """A literal array, made in one call."""
    return F.expr(f"array({', '.join(map(_quoted, words))})")


def lookup(table: dict, key: Column, kind: str = "string") -> Column:
    """The value that a literal table has for a key, else null."""
    pairs = ", ".join(f"{_quoted(k)}, CAST({_quoted(v) if isinstance(v, str) else v} AS {kind})" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


#: Joins the words of a unit of two words while texts are cut into words.
_JOINED = "\x01"


def words_of(low: Column) -> Column:
    """Runs of a-z of a lower-case text, in order; a metric ton is one word."""
    return F.regexp_extract_all(F.when(F.contains(low, F.lit("metric")), F.regexp_replace(low, r"metric\s+ton", f"metric{_JOINED}ton")).otherwise(low), F.lit(f"([a-z{_JOINED}]+)"), 1)


def _first_of(table: dict, words: Column) -> Column:
    """The first of the words that is one of the table's keys, else null."""
    return F.get(F.array_intersect(words, words_array(k.replace(" ", _JOINED) for k in table)), F.lit(0))


def has(low: Column, *parts: str) -> Column:
    """A lower-case text contains one of the parts: cheap, and so asked before a pattern that needs one of them."""
    found = F.contains(low, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(low, F.lit(p))
    return found


def _currency(low: Column, words: Column) -> Column:
    mark = F.when(has(low, "₹", "$", "€", "£"), lookup(CURRENCIES, F.regexp_extract(low, r"(us\$|₹|\$|€|£)", 1)))
    return F.coalesce(mark, lookup(CURRENCIES, _first_of({k: v for k, v in CURRENCIES.items() if k.isalpha() and k.isascii()}, words)))


def currency_of(text: Column) -> Column:
    return _currency(F.lower(text), words_of(F.lower(text)))


def scale_of(text: Column) -> Column:
    """The scale word, null if there is none."""
    return _first_of(SCALES, words_of(F.lower(text)))


def unit_of(text: Column) -> Column:
    return F.replace(_first_of(UNITS, words_of(F.lower(text))), F.lit(_JOINED), F.lit(" "))


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("decimal(24,8)")


def _before(text: Column, part: Column) -> Column:
    return F.substr(text, F.lit(1), F.position(part, text) - 1)


def _after(text: Column, part: Column) -> Column:
    return F.substr(text, F.position(part, text) + F.length(part))


def _dp(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"\.(\d+)", 1))


def _value(**parts) -> Column:
    kinds = {"number": "decimal(37,10)", "reported": "decimal(24,8)", "dp": "int", "scale": "decimal(12,2)", "approximate": "boolean", "confidence": "double"}
    order = ("number", "reported", "dp", "scale", "unit", "reported_unit", "currency", "approximate", "warning", "confidence")
    return F.struct(*((parts.get(k) if isinstance(parts.get(k), Column) else F.lit(parts.get(k))).cast(kinds.get(k, "string")).alias(k) for k in order))


def _failed(code: str) -> Column:
    return _value(warning=code, confidence=0.0, approximate=False)


RATIO = rf"^\s*({NUMBER})\s*:\s*({NUMBER})\s*$"


def number(text: Column) -> Column:
    """One number. Failures have a null number and a warning: missing_number, ambiguous_number, invalid_ratio, invalid_number."""
    return let(F.struct(F.trim(text).alias("raw"), F.regexp_extract_all(F.trim(text), F.lit(rf"({NUMBER})"), 1).alias("found")), _number)


def _number(given: Column) -> Column:
    raw, found = given["raw"], given["found"]
    many = F.coalesce(F.size(found), F.lit(0))
    return (
        F.when(F.contains(raw, F.lit(":")) & raw.rlike(RATIO), let(F.struct(*(_plain(F.regexp_extract(raw, RATIO, k)).alias(n) for k, n in ((1, "a"), (2, "b")))), _quotient))
        .when(many <= 0, _failed("missing_number"))
        .when(many > 1, _failed("ambiguous_number"))
        .otherwise(let(F.struct(raw.alias("raw"), F.lower(raw).alias("low"), F.get(found, F.lit(0)).alias("digits"), words_of(F.lower(_before(raw, F.get(found, F.lit(0))))).alias("ahead"), words_of(F.lower(_after(raw, F.get(found, F.lit(0))))).alias("behind")), _single))
    )


def _quotient(x: Column) -> Column:
    number_ = lambda q: _value(number=q, reported=q, dp=F.length(F.regexp_extract(F.regexp_replace(q.cast("string"), r"0+$", ""), r"\.(\d+)", 1)), scale=1, unit="ratio", approximate=False, confidence=0.99)
    return F.when(x["b"] == 0, _failed("invalid_ratio")).otherwise(let((x["a"] / F.nullif(x["b"], F.lit(0))).cast("decimal(24,8)"), number_))


def _single(x: Column) -> Column:
    raw, low, digits, words = x["raw"], x["low"], x["digits"], F.concat(x["ahead"], x["behind"])
    value = _plain(digits)
    parts = F.struct(
        F.when(raw.startswith("(") & raw.endswith(")"), -F.abs(value)).otherwise(value).alias("value"), _currency(low, words).alias("currency"), _first_of(SCALES, words).alias("word"), F.replace(_first_of(UNITS, x["behind"]), F.lit(_JOINED), F.lit(" ")).alias("unit"),
        (has(low, "%", "per", "pct") & raw.rlike(PERCENT)).alias("percent"), (has(low, "bp", "basis") & raw.rlike(BASIS_POINT)).alias("bps"), (has(low, "x") & low.rlike(TIMES)).alias("times"), F.btrim(_after(low, digits), F.lit(" .,)\n\t")).alias("suffix"),
    )

    def named(p: Column) -> Column:
        unit = F.coalesce(lookup(CURRENCY_UNITS, p["currency"]), F.when(p["percent"], "percent").when(p["bps"], "percentage_point").when(p["times"], "ratio").otherwise(lookup(UNITS, p["unit"])))
        scale = F.when(p["bps"], F.lit(0.01)).otherwise(F.coalesce(lookup(SCALES, p["word"], "decimal(12,2)"), F.lit(1))).cast("decimal(12,2)")
        return let(F.struct(p.alias("p"), unit.alias("unit"), scale.alias("scale"), ((p["suffix"] != "") & p["word"].isNull() & unit.isNull()).alias("unknown")), finished)

    def finished(y: Column) -> Column:
        p, unknown = y["p"], y["unknown"]
        reported_unit = F.when(p["percent"], "%").when(p["bps"], "basis point").when(p["times"], "x").when(unknown, p["suffix"]).otherwise(F.coalesce(p["unit"], F.when(p["currency"].isNotNull(), p["word"])))
        return F.when(p["value"].isNull(), _failed("invalid_number")).otherwise(_value(
            number=p["value"] * y["scale"], reported=p["value"], dp=_dp(digits), scale=y["scale"], unit=y["unit"], reported_unit=reported_unit, currency=p["currency"],
            approximate=has(low, "about", "approx", "~", "≈") & low.rlike(r"(?U)\babout\b|\bapprox(?:imately)?\.?(?![a-z])|~|≈"), warning=F.when(unknown, "unknown_unit"), confidence=F.when(unknown, 0.72).otherwise(0.99),
        ))

    return let(parts, named)


RANGE = rf"(?iU)^(.*?)({NUMBER})\s*(?:–|—|-|\bto\b|\band\b)\s*({NUMBER})(.*)$"


def number_range(text: Column) -> Column:
    """(low, high, unit, currency, approximate, warning, confidence) of ``a – b`` or ``a to b``; missing_range or reversed_range where there is none."""
    raw = F.trim(text)
    side = lambda k: number(F.concat(F.regexp_extract(raw, RANGE, 1), F.lit(" "), F.regexp_extract(raw, RANGE, k), F.regexp_extract(raw, RANGE, 4)))
    return let(F.struct(raw.alias("raw"), raw.rlike(RANGE).alias("ok"), side(2).alias("low"), side(3).alias("high")), _range)


def _range(x: Column) -> Column:
    low, high = x["low"], x["high"]
    wrong = x["ok"] & (low["number"] > high["number"])
    good = x["ok"] & ~wrong
    return F.struct(
        F.when(good, low["number"]).alias("low"), F.when(good, high["number"]).alias("high"), F.when(good, low["unit"]).alias("unit"), F.when(good, low["currency"]).alias("currency"),
        (good & (low["approximate"] | x["raw"].rlike("(?i)\\bbetween\\b|about|approx|~|≈"))).alias("approximate"),
        F.when(~x["ok"], "missing_range").when(wrong, "reversed_range").alias("warning"), F.when(good, 0.97).otherwise(0.0).alias("confidence"),
    )


def tolerance(value: Column) -> Column:
    """Half a unit of the last displayed digit, in the value's own scale. A float keeps it simple to divide later; it is exact for these powers of ten up to 15 digits."""
    return (F.lit(0.5) * F.pow(F.lit(10.0), -value["dp"]) * value["scale"].cast("double")).cast("decimal(37,10)")


def compare(left: Column, right: Column) -> Column:
    """(comparable, difference, tolerance, agrees). Agreement is strict: a difference equal to the tolerance disagrees, unless both are 0."""
    comparable = ~F.coalesce(left["currency"] != right["currency"], F.lit(False)) & left["unit"].eqNullSafe(right["unit"])
    either = F.coalesce(left["approximate"], F.lit(False)) | F.coalesce(right["approximate"], F.lit(False))
    shown = tolerance(left) + tolerance(right)
    one_percent = (F.greatest(F.abs(left["number"]), F.abs(right["number"])).cast("double") * 0.01).cast("decimal(37,10)")
    parts = F.struct(comparable.alias("c"), F.abs(left["number"] - right["number"]).alias("d"), F.when(either, F.greatest(one_percent, shown)).otherwise(shown).alias("t"))
    when = lambda p, x: F.when(p["c"], x)
    return let(parts, lambda p: F.struct(p["c"].alias("comparable"), when(p, p["d"]).alias("difference"), when(p, p["t"]).alias("tolerance"), when(p, (p["d"] == 0) | (p["d"] < p["t"])).alias("agrees")))
