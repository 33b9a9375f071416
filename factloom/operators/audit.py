"""Arithmetic checks: growth against its base values, totals against their components."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.context import measure_key
from factloom.functions.names import short_hash
from factloom.functions.numbers import tolerance

# Confidence factors of the decisions.
FACTORS = {"corroborates": 0.97, "contradicts": 0.95, "likely_contradiction": 0.72, "needs_review": 0.5}
GROWTH = r"(_percentage_change|_percent_change|_growth|_change)$"


def decide(difference: Column, tol: Column, blocking: Column, doubt: Column) -> Column:
    """A difference equal to the tolerance still corroborates here."""
    return F.when(blocking | difference.isNull(), "needs_review").when(difference <= tol, "corroborates").when(doubt, "likely_contradiction").otherwise("contradicts")


def confidence(least: Column, kind: Column) -> Column:
    out = F.when(kind == "corroborates", FACTORS["corroborates"])
    for k in list(FACTORS)[1:]:
        out = out.when(kind == k, FACTORS[k])
    return F.round(least * out.otherwise(0.65), 6)


def growth(rows: DataFrame) -> DataFrame:
    """Adds calculated, difference, tolerance, decision and confidence to rows (stated, current, prior: facts; issues: array of strings).

    calculated = (current - prior) / |prior| * 100, with a tolerance from what the three numbers display.
    """
    v = lambda s: F.col(f"{s}.value")
    c, p = (v(s)["number"].cast("double") for s in ("current", "prior"))
    stated = v("stated")["number"].cast("double") * F.when(v("stated")["unit"] == "ratio", 100.0).otherwise(1.0)
    tc, tp, ts = (tolerance(v(s)).cast("double") for s in ("current", "prior", "stated"))
    base = F.nullif(p, F.lit(0.0))
    calculated = (c - p) / F.abs(base) * 100
    tol = tc / F.abs(base) * 100 + F.abs(c) * tp / (base * base) * 100 + ts * F.when(v("stated")["unit"] == "ratio", 100.0).otherwise(1.0)
    approximate = F.coalesce(v("stated")["approximate"], F.lit(False)) | F.coalesce(v("current")["approximate"], F.lit(False)) | F.coalesce(v("prior")["approximate"], F.lit(False))
    tol = F.when(approximate, F.greatest(tol, F.abs(calculated) * 0.01)).otherwise(tol)
    uncertain = F.exists(F.array(*(F.col(f"{s}.review_state") for s in ("stated", "current", "prior"))), lambda r: r != "ready") | (F.size("issues") > 0)
    no_period = F.col("stated.context.period").isNull()
    rows = rows.withColumns({"stated_value": stated, "calculated": calculated, "difference": F.abs(calculated - stated), "tolerance": tol})
    rows = rows.withColumn("relation_type", decide(F.col("difference"), F.col("tolerance"), no_period, uncertain))
    least = F.least(*(F.col(f"{s}.{k}") for s in ("stated", "current", "prior") for k in ("extraction_confidence", "normalization_confidence")))
    zero = F.when(p == 0, 0.5).otherwise(1.0)
    operand = lambda s: F.struct(F.col(f"{s}.id").alias("fact_id"), F.col(f"{s}.value.raw").alias("raw"))
    return rows.withColumns({"confidence": F.round(confidence(least, F.col("relation_type")) * zero, 6), "operands": F.to_json(F.struct(operand("stated").alias("stated"), operand("current").alias("current"), operand("prior").alias("prior")))})


def discover_growth(facts: DataFrame) -> DataFrame:
    """Growth checks that a set of facts allows: a percentage of a measure's change, the measure in its period and in the period before."""
    side = lambda df, name: df.select("subject_id", F.col("base"), F.struct(*facts.columns).alias(name))
    numeric = facts.where("value.kind = 'number'")
    stated = numeric.where(F.col("predicate_key").rlike(GROWTH) & (F.col("value.unit") == "percent") & F.col("context.period").isNotNull()).withColumn("base", measure_key(F.replace(F.regexp_replace("predicate_key", GROWTH, ""), F.lit("_"), F.lit(" ")))).where(F.regexp_replace("predicate_key", GROWTH, "") != "")
    plain = numeric.where("value.unit is null or value.unit <> 'percent'").withColumn("base", F.col("predicate_key"))
    keys = ["subject_id", "base"]
    scope = lambda x, y: x.isNull() | y.isNull() | (x == y)
    joined = side(stated, "stated").join(side(plain, "current"), keys).where((F.col("stated.context.period.label") == F.col("current.context.period.label")) & scope(F.col("stated.context.scope"), F.col("current.context.scope")))
    joined = joined.join(side(plain, "prior"), keys)
    start, end = F.col("current.context.period.start"), F.col("current.context.period.end")
    before, until = F.col("prior.context.period.start"), F.col("prior.context.period.end")
    gap = F.date_diff(start, until)
    long, other = F.date_diff(end, start), F.date_diff(until, before)
    joined = joined.where(gap.between(-1, 45) & F.col("current.context.scope").eqNullSafe(F.col("prior.context.scope")) & (F.abs(long - other) <= F.greatest(F.lit(31.0), long * 0.25)))
    joined = joined.withColumn("order", F.struct(F.col("current.id").alias("c"), (-F.unix_date(before)).alias("p"), F.col("prior.id").alias("i")))
    best = joined.groupBy("subject_id", "base", F.col("stated.id").alias("stated_id")).agg(F.min_by(F.struct("stated", "current", "prior"), "order").alias("x")).select("subject_id", "base", "x.*")
    same = lambda k, *sides: reduce(and_, (F.col(f"{sides[0]}.{k}").eqNullSafe(F.col(f"{o}.{k}")) for o in sides[1:]))
    shared = lambda k: reduce(and_, (F.lower(F.trim(F.col(f"current.context.{k}"))).eqNullSafe(F.lower(F.trim(F.col(f"{o}.context.{k}")))) for o in ("prior", "stated")))
    days = lambda s: F.date_diff(F.col(f"{s}.context.period.end"), F.col(f"{s}.context.period.start"))
    wrong = [(~same(f"value.{k}", "current", "prior"), k) for k in ("unit", "currency")] + [(~shared(k), k) for k in ("scope", "basis", "as_of", "geography")] + [(F.abs(days("current") - days("prior")) > 7, "period")]
    issues = F.array_compact(F.array(*(F.when(is_, name) for is_, name in wrong)))
    return growth(best.withColumn("issues", issues)).withColumns({"id": short_hash("finding_", F.lit("growth"), F.col("stated.id"), F.col("current.id"), F.col("prior.id")), "check_type": F.lit("growth"), "formula": F.lit("(current - prior) / abs(prior) * 100")})


def totals(cells: DataFrame, complete: bool = False) -> DataFrame:
    """Component totals of grids (subject_id, document_id, page_index, table_index, column_index, row_index, predicate_key, value).

    A section ends with each row whose key begins with total; components have the total's unit and
    currency and aren't percentages; two at least. As a grid never proves that all components
    are there, the decision is needs_review unless ``complete``.
    """
    keys = ["subject_id", "document_id", "page_index", "table_index", "column_index"]
    is_total = F.col("predicate_key").rlike(r"^(?:total|sub_?total|grand_total)(?:_|$)")
    w = W.partitionBy(*keys).orderBy("row_index").rowsBetween(W.unboundedPreceding, -1)
    rows = cells.withColumn("total", is_total).withColumn("section", F.coalesce(F.sum(F.col("total").cast("int")).over(w), F.lit(0)))
    # A section has one total at most, so its parts get it without a join: cells are made and dealt out once.
    of = F.first(F.when(F.col("total"), F.struct(F.col("value").alias("stated"), F.col("predicate_key").alias("total_key"))), ignorenulls=True).over(W.partitionBy(*keys, "section"))
    rows = rows.dropna(subset=keys).withColumn("of", of).where("not total and of is not null").select(*keys, "section", "value", "of.stated", "of.total_key")
    parts = rows.where(F.col("value.unit").eqNullSafe(F.col("stated.unit")) & F.col("value.currency").eqNullSafe(F.col("stated.currency")) & ~F.coalesce(F.col("value.unit") == "percent", F.lit(False)))
    out = parts.groupBy(*keys, "section", "total_key", "stated").agg(F.count(F.lit(1)).alias("n_components"), F.sum("value.number").alias("calculated"), F.sum(tolerance(F.col("value"))).alias("parts_tolerance")).where("n_components >= 2")
    out = out.withColumns({"difference": F.abs(F.col("stated.number") - F.col("calculated")), "tolerance": F.col("parts_tolerance") + tolerance(F.col("stated"))}).drop("parts_tolerance")
    return out.withColumns({"check_type": F.lit("component_total"), "relation_type": decide(F.col("difference"), F.col("tolerance"), F.lit(not complete), F.lit(False))})


def repeated_metrics(relations: DataFrame) -> DataFrame:
    """Decided relations as findings."""
    return relations.where("relation_type in ('corroborates', 'contradicts')").select(short_hash("finding_", F.lit("repeated"), F.col("fact_a_id"), F.col("fact_b_id")).alias("id"), F.lit("repeated_metric").alias("check_type"), "relation_type", F.array("fact_a_id", "fact_b_id").alias("fact_ids"), "explanation", "confidence")
