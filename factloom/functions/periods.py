"""Dates and reporting periods. Fiscal years start in April and bear the year in which they end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.numbers import has, let

MONTH = r"(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)"
DAY = r"(\d{1,2})(?:st|nd|rd|th)?"


def _day(month: Column, day: Column, year: Column) -> Column:
    return F.try_to_date(F.concat_ws(" ", F.initcap(F.substring(F.lower(month), 1, 3)), day, year), "MMM d yyyy")


def _found(text: Column, pattern: str):
    return text.rlike(pattern), lambda k: F.regexp_extract(text, pattern, k)


def year4(text: Column) -> Column:
    """Two digits up to 50 belong to this century."""
    n = text.try_cast("int")
    return F.when(F.length(text) == 4, n).when(n <= 50, n + 2000).otherwise(n + 1900)


def _date(year: Column, month: int | Column, day: int) -> Column:
    m = F.lit(month) if isinstance(month, int) else month
    return F.try_to_date(F.format_string(f"%04d-%02d-{day:02d}", year.cast("int"), m.cast("int")))


def date_value(text: Column) -> Column:
    """(value, precision, warning, confidence); a date that the calendar lacks is invalid_date."""
    raw = F.trim(text)
    iso, g1 = _found(raw, r"^(\d{4}-\d{2}-\d{2})$")
    mdy, g2 = _found(raw, rf"(?i)^({MONTH})\s+{DAY},?\s+(\d{{4}})$")
    dmy, g3 = _found(raw, rf"(?i)^{DAY}\s+({MONTH}),?\s+(\d{{4}})$")
    my, g4 = _found(raw, rf"(?i)^({MONTH})\s+(\d{{4}})$")
    y, g5 = _found(raw, r"^(\d{4})$")
    value = F.when(iso, F.try_to_date(g1(1))).when(mdy, _day(g2(1), g2(2), g2(3))).when(dmy, _day(g3(2), g3(1), g3(3))).when(my, _day(g4(1), F.lit("1"), g4(2))).when(y, _date(g5(1), 1, 1))
    precision = F.when(iso | mdy | dmy, "day").when(my, "month").when(y, "year")
    return F.struct(
        value.alias("value"), F.when(value.isNotNull(), precision).alias("precision"), F.when(precision.isNull(), "unknown_date").when(value.isNull(), "invalid_date").when(y, "year_only").alias("warning"),
        F.when(value.isNull(), 0.0).when(y, 0.78).when(my, 0.92).otherwise(0.99).alias("confidence"),
    )


def _result(kind: str, label: Column | None, start: Column | None, end: Column | None, confidence: float, as_of: Column | None = None, warning: str | None = None) -> Column:
    typed = lambda c, t: (c if c is not None else F.lit(None)).cast(t)

    def checked(x: Column) -> Column:
        ok = F.coalesce(x["as_of"].isNotNull() | (x["start"] <= x["end"]), F.lit(False))
        return F.struct(*(F.when(ok, x[k]).alias(k) for k in ("label", "start", "end", "as_of")), F.when(ok, kind).alias("kind"), F.when(~ok, "invalid_period").otherwise(F.lit(warning)).cast("string").alias("warning"), F.when(ok, confidence).otherwise(0.0).alias("confidence"))

    return let(F.struct(typed(label, "string").alias("label"), typed(start, "date").alias("start"), typed(end, "date").alias("end"), typed(as_of, "date").alias("as_of")), checked)


def period(text: Column) -> Column:
    """(label, start, end, as_of, kind, warning, confidence).

    The first form that the text holds decides; if its date isn't in the calendar the whole
    text is invalid_period, whatever else it holds. Without any form: unknown_period.
    """
    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), _period)


def quarter_of(text: Column) -> Column:
    return F.regexp_extract(text, r"(?iU)\bQ([1-4])\b", 1).try_cast("int")


def _period(x: Column) -> Column:
    t, low = x["text"], x["low"]
    as_of_cue, month_cue = low.rlike(r"\bas\s+(?:of|at)\b"), low.rlike("jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec")
    as_mdy, a1 = _found(t, rf"(?iU)\bas\s+(?:of|at)\s+({MONTH})\s+{DAY},?\s+(\d{{4}})\b")
    as_iso, a2 = _found(t, r"(?iU)\bas\s+(?:of|at)\s+(\d{4}-\d{2}-\d{2})\b")
    as_dmy, a3 = _found(t, rf"(?iU)\bas\s+(?:of|at)\s+{DAY}\s+({MONTH}),?\s+(\d{{4}})\b")
    fy, f = _found(t, r"(?iU)\b(?:fy|fiscal\s+year)\s*['’]?(\d{4}|\d{2})(?:\s*[-–/]\s*(\d{4}|\d{2}))?\b")
    fy = has(low, "fy", "fiscal") & fy
    second = F.when(f(2) != "", f(2))
    first = year4(f(1))
    end_year = F.coalesce(year4(second), first)
    start_year = F.when(second.isNotNull() & (F.length(f(1)) == 4), first).otherwise(end_year - 1)
    years = F.struct(start_year.alias("a"), end_year.alias("b"), quarter_of(t).alias("q"))
    label = lambda a, b: F.format_string("FY %04d-%02d", a, F.pmod(b, F.lit(100)))
    pair, p = _found(t, r"(?iU)\b(20\d{2})\s*[-–/]\s*(\d{2})\b")
    cue = t.rlike(r"(?iU)\b(?:fiscal|financial|growth|projected|estimate|estimated|outlook|budget)\b")
    pair_start = p(1).try_cast("int")
    ended, e = _found(t, rf"(?iU)\byear\s+ended\s+(?:on\s+)?({MONTH})\s+{DAY},?\s+(\d{{4}})\b")
    ended_on = _day(e(1), e(2), e(3))
    span, s = _found(t, rf"(?iU)\b({MONTH})\s+{DAY},?\s+(\d{{4}})\s+(?:to|through|until|[-–])\s+({MONTH})\s+{DAY},?\s+(\d{{4}})\b")
    my, m = _found(t, rf"(?iU)\b({MONTH})\s+(\d{{4}})\b")
    m_start = _day(m(1), F.lit("1"), m(2))
    cq, c = _found(t, r"(?iU)\bQ\s*([1-4])\s+(?:of\s+)?(\d{4})\b")
    cq_start = _date(c(2), (c(1).try_cast("int") - 1) * 3 + 1, 1)
    only, y = _found(F.trim(t), r"^(\d{4})$")
    last = lambda start, months: F.date_sub(F.add_months(start, months), 1)
    as_of = lambda d: _result("point_in_time", None, None, None, 0.99, as_of=d)
    fiscal = lambda y: F.when(y["q"].isNotNull(), let(F.struct(F.add_months(_date(y["a"], 4, 1), (y["q"] - 1) * 3).alias("s"), F.concat(F.lit("Q"), y["q"].cast("string"), F.lit(" "), label(y["a"], y["b"])).alias("n")), lambda z: _result("quarter", z["n"], z["s"], last(z["s"], 3), 0.99))).otherwise(_result("fiscal_year", label(y["a"], y["b"]), _date(y["a"], 4, 1), _date(y["b"], 3, 31), 0.99))
    unknown = F.struct(*(F.lit(None).cast(k).alias(n) for n, k in (("label", "string"), ("start", "date"), ("end", "date"), ("as_of", "date"), ("kind", "string"))), F.lit("unknown_period").alias("warning"), F.lit(0.0).alias("confidence"))
    return (
        F.when(as_of_cue & as_mdy, as_of(_day(a1(1), a1(2), a1(3))))
        .when(as_of_cue & as_iso, as_of(F.try_to_date(a2(1))))
        .when(as_of_cue & as_dmy, as_of(_day(a3(2), a3(1), a3(3))))
        .when(fy, let(years, fiscal))
        .when(cue & pair, let(F.struct(pair_start.alias("a"), (p(2).try_cast("int") + 2000).alias("b")), lambda y: _result("fiscal_year", label(y["a"], y["b"]), _date(y["a"], 4, 1), _date(y["b"], 3, 31), 0.94)))
        .when(month_cue & has(low, "ended") & ended, _result("date_range", F.concat(F.lit("year ended "), ended_on.cast("string")), F.date_add(F.add_months(ended_on, -12), 1), ended_on, 0.98))
        .when(month_cue & span, _result("date_range", F.concat(_day(s(1), s(2), s(3)).cast("string"), F.lit(" to "), _day(s(4), s(5), s(6)).cast("string")), _day(s(1), s(2), s(3)), _day(s(4), s(5), s(6)), 0.99))
        .when(month_cue & has(low, "ended") & my & t.rlike(r"(?iU)\bended\b"), _result("month", F.date_format(m_start, "MMMM yyyy"), m_start, F.last_day(m_start), 0.96))
        .when(has(low, "q") & cq, _result("quarter", F.concat(F.lit("Q"), c(1), F.lit(" "), c(2)), cq_start, last(cq_start, 3), 0.98))
        .when(only, _result("calendar_year", y(1), _date(y(1), 1, 1), _date(y(1), 12, 31), 0.78, warning="year_assumed_calendar"))
        .otherwise(unknown)
    )
