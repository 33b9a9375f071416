"""Pairs of facts about one thing, and what they say of each other.

The pairs come from one self-join on (subject, predicate). Everything after it is one
projection: the values are compared with the tolerance of what was displayed, the contexts
are compared field by field, and a CASE decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import text_key
from factloom.functions.numbers import compare, let

RULE_VERSION = "1"
# Confidence factors of the verdicts, and the context fields in order.
FACTORS = {"corroborates": 0.98, "contradicts": 0.96, "reconciled": 0.92, "incomparable": 0.72, "needs_review": 0.55}
FIELDS = ("period", "scope", "basis", "as_of", "unit", "geography", "publisher")
RECONCILING = ("period", "scope", "basis", "as_of", "unit")


def pairs(facts: DataFrame, new: DataFrame | None = None, cross_document: bool = False) -> DataFrame:
    """(a, b) structs of facts on one subject and predicate, a.id < b.id, without pairs from one passage.

    new: only pairs with at least one of these facts; facts are then the stored ones, which
    new ones may repeat. A null subject or predicate pairs with nothing.
    """
    stored = facts.where("subject_id is not null").dropDuplicates(["id"])
    side = lambda df, name: df.select("subject_id", "predicate_key", F.struct(*df.columns).alias(name))
    keep = (F.col("a.id") != F.col("b.id")) & ~F.coalesce(F.col("a.passage_id") == F.col("b.passage_id"), F.lit(False))
    if cross_document:
        keep = keep & (F.col("a.document_id") != F.col("b.document_id"))
    keys = ["subject_id", "predicate_key"]
    if new is None:
        return side(stored, "a").join(side(stored, "b"), keys).where(keep & (F.col("a.id") < F.col("b.id"))).select("a", "b")
    fresh = new.where("subject_id is not null").dropDuplicates(["id"])
    everything = stored.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
    found = side(fresh, "a").join(side(everything, "b"), keys).where(keep).select("a", "b")
    swap = F.col("a.id") > F.col("b.id")
    found = found.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    return found.dropDuplicates(["a", "b"]) if not any("map<" in t for _, t in found.dtypes) else found.withColumn("k", F.struct("a.id", "b.id")).dropDuplicates(["k"]).drop("k")


def _ratio(v: Column) -> Column:
    """Percent and ratio on one scale."""
    hundredth = F.lit(0.01).cast("decimal(2,2)")
    percent = v["unit"] == "percent"
    return F.struct(
        F.when(percent, (v["number"] * hundredth).cast("decimal(37,10)")).otherwise(v["number"]).alias("number"), v["dp"].alias("dp"),
        F.when(percent, (v["scale"].cast("double") * 0.01).cast("decimal(20,10)")).otherwise(v["scale"].cast("decimal(20,10)")).alias("scale"),
        F.lit("ratio").alias("unit"), F.lit(None).cast("string").alias("currency"), v["approximate"].alias("approximate"),
    )


def value_result(a: Column, b: Column) -> Column:
    """(comparable, agrees, uncertain, unit_reconciled, difference, tolerance)."""
    bridge = F.coalesce((a["unit"].isin("percent", "ratio")) & (b["unit"].isin("percent", "ratio")) & (a["unit"] != b["unit"]), F.lit(False))
    either = F.when(bridge, compare(_ratio(a), _ratio(b))).otherwise(compare(a, b))
    no = F.lit(False)
    null_unit = a["unit"].isNull() | b["unit"].isNull()
    result = lambda comparable, agrees, uncertain=no, unit=no, diff=None, tol=None: F.struct(
        comparable.alias("comparable"), agrees.cast("boolean").alias("agrees"), uncertain.alias("uncertain"), unit.alias("unit_reconciled"),
        (diff if diff is not None else F.lit(None)).cast("decimal(38,10)").alias("difference"), (tol if tol is not None else F.lit(None)).cast("decimal(38,10)").alias("tolerance"))
    yes, none = F.lit(True), F.lit(None)
    text = text_key(a["text"]) == text_key(b["text"])
    same_scheme = a["scheme"].eqNullSafe(b["scheme"])
    compact = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    return (
        F.when(a["kind"] != b["kind"], result(no, none, yes))
        .when(a["kind"] == "number", let(either, lambda x: result(x["comparable"], x["agrees"], ~x["comparable"] & null_unit, bridge, x["difference"], x["tolerance"])))
        .when(a["kind"].isin("text", "category"), result(yes, text))
        .when(a["kind"] == "date", F.when(a["precision"].eqNullSafe(b["precision"]), result(yes, a["date_value"] == b["date_value"])).otherwise(result(yes, none, yes)))
        .when(a["kind"] == "boolean", result(yes, a["bool_value"] == b["bool_value"]))
        .when(a["kind"] == "identifier", F.when(same_scheme, result(yes, compact(a["identifier"]) == compact(b["identifier"]))).otherwise(result(no, none)))
        .otherwise(result(no, none, yes))
    )


def period_comparable(a: Column, b: Column) -> Column:
    """The longer span is at most twice the shorter; a missing or empty span decides nothing."""
    days = lambda p: F.date_diff(p["end"], p["start"]) + 1
    short, long = F.least(days(a), days(b)), F.greatest(days(a), days(b))
    return F.coalesce(F.when(short > 0, long <= 2 * short), F.lit(True))


def context_diff(a: Column, b: Column, unit_reconciled: Column) -> Column:
    """Array of (field, left, right, explains) of the unequal fields."""
    ca, cb = a["context"], b["context"]
    dates = lambda p: F.coalesce(F.when(p["start"].isNotNull() | p["end"].isNotNull(), F.concat_ws("..", p["start"].cast("string"), p["end"].cast("string"))), p["label"])
    unit = lambda v: F.nullif(F.concat_ws("/", v["unit"], v["currency"]), F.lit(""))
    sides = {"period": (dates(ca["period"]), dates(cb["period"])), "unit": (unit(a["value"]), unit(b["value"]))} | {k: (ca[k].cast("string"), cb[k].cast("string")) for k in ("scope", "basis", "as_of", "geography", "publisher")}
    rows = []
    for k in FIELDS:
        x, y = sides[k]
        both = x.isNotNull() & y.isNotNull()
        explains = both if k in ("scope", "basis", "as_of", "geography") else both & period_comparable(ca["period"], cb["period"]) if k == "period" else both & unit_reconciled if k == "unit" else F.lit(False)
        rows.append(F.struct(F.lit(k).alias("field"), x.alias("left"), y.alias("right"), explains.alias("explains")))
    return F.filter(F.array(*rows), lambda r: ~r["left"].eqNullSafe(r["right"]))


def relations(candidates: DataFrame) -> DataFrame:
    """A row for each pair (a, b): verdict, the values' comparison, context difference, confidence, explanation."""
    has = lambda s: reduce(lambda x, y: x | y, (F.col(f"{s}.context.{k}").isNotNull() for k in ("period", "scope", "basis", "as_of", "geography")))
    df = candidates.withColumn("value", value_result(F.col("a.value"), F.col("b.value")))
    df = df.withColumn("diff", context_diff(F.col("a"), F.col("b"), F.col("value.unit_reconciled")))
    considered = F.filter("diff", lambda r: r["field"] != "publisher")
    explaining = F.transform(F.filter(considered, lambda r: r["explains"]), lambda r: r["field"])
    stated = F.exists(considered, lambda r: ~r["explains"] & r["left"].isNotNull() & r["right"].isNotNull() & ~((r["field"] == "unit") & F.col("value.unit_reconciled")))
    one_sided = F.size(F.filter(considered, lambda r: ~r["explains"] & (r["left"].isNull() | r["right"].isNull())))
    df = df.withColumns({"explaining": explaining, "stated": stated, "gaps": one_sided})
    doubtful = F.col("a.review_state").isin("needs_review", "rejected") | F.col("b.review_state").isin("needs_review", "rejected")
    verdict = (
        F.when(doubtful, "needs_review")
        .when((F.col("a.value.kind") == "number") & ~has("a") & ~has("b"), "needs_review")
        .when(F.col("value.uncertain"), "needs_review")
        .when(~F.col("value.comparable"), "incomparable")
        .when(F.col("stated"), "needs_review")
        .when(F.size("explaining") > 1, "incomparable")
        .when((F.size("explaining") == 1) & (F.col("explaining")[0] == "geography"), "incomparable")
        .when(F.size("explaining") == 1, F.concat(F.lit("reconciled_by_"), F.col("explaining")[0]))
        .when(F.col("value.agrees"), "corroborates")
        .when(~F.col("value.agrees") & (F.col("gaps") > 0), "needs_review")
        .when(~F.col("value.agrees"), "contradicts")
        .otherwise("needs_review")
    )
    df = df.withColumn("relation_type", verdict)
    factor = F.when(F.col("relation_type").startswith("reconciled"), FACTORS["reconciled"])
    for k in ("corroborates", "contradicts", "incomparable", "needs_review"):
        factor = factor.when(F.col("relation_type") == k, FACTORS[k])
    factor = F.when(~F.col("value.comparable"), F.least(factor, F.lit(0.7))).otherwise(factor) * F.when(F.col("gaps") > 0, F.greatest(F.lit(0.75), F.pow(F.lit(0.92), F.col("gaps")))).otherwise(1.0)
    least = F.least(*(F.col(f"{s}.{c}") for s in "ab" for c in ("extraction_confidence", "normalization_confidence")))
    return df.select(
        F.sha2(F.to_json(F.array("a.id", "b.id", F.lit(RULE_VERSION))), 256).alias("id"), F.col("a.id").alias("fact_a_id"), F.col("b.id").alias("fact_b_id"),
        F.col("a.subject_id").alias("subject_id"), F.col("a.predicate_key").alias("predicate_key"), "relation_type", F.col("value").alias("value_comparison"), F.col("diff").alias("context_diff"),
        explanation(doubtful).alias("explanation"), F.round(least * factor, 6).alias("confidence"), F.lit(RULE_VERSION).alias("rule_version"),
        F.when(F.col("relation_type").isin("needs_review", "incomparable"), "needs_review").otherwise("ready").alias("review_state"),
    )


def explanation(doubtful: Column) -> Column:
    """One sentence on the verdict; a doubtful source comes first."""
    fields = F.array_join(F.transform("diff", lambda r: r["field"]), ", ")
    silent = F.array_join(F.transform(F.filter("diff", lambda r: r["left"].isNull() | r["right"].isNull()), lambda r: r["field"]), ", ")
    note = F.when(silent != "", F.concat(F.lit(" Only one side states: "), silent, F.lit("."))).otherwise("")
    raw = lambda s: F.coalesce(F.col(f"{s}.value.raw"), F.lit("?"))
    kind = F.col("relation_type")
    return (
        F.when(doubtful, F.lit("A source fact is itself under review, so the pair can't be decided."))
        .when(kind == "corroborates", F.concat(raw("a"), F.lit(" and "), raw("b"), F.lit(" agree within what they display."), note))
        .when(kind == "contradicts", F.concat(raw("a"), F.lit(" and "), raw("b"), F.lit(" differ by more than what they display, in one context.")))
        .when(kind.startswith("reconciled"), F.concat(F.lit("The sources differ in "), F.col("explaining")[0], F.lit(" only: "), raw("a"), F.lit(" and "), raw("b"), F.lit("."), note))
        .when(kind == "incomparable", F.concat(F.lit("The values can't be compared; the sources differ in: "), F.when(fields != "", fields).otherwise("their unit or kind"), F.lit(".")))
        .otherwise(F.concat(F.lit("More context is needed."), note))
    )
