"""The read side: filters, counts, pages, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAMILIES = {"reconciled": [f"reconciled_by_{k}" for k in ("period", "scope", "basis", "as_of", "unit")], "contradicts": ["contradicts", "likely_contradiction"]}


def facts(df: DataFrame, document: str | None = None, entity: str | None = None, predicate: str | None = None, review_state: str | None = None, least_confidence: float | None = None) -> DataFrame:
    for column, value in (("document_id", document), ("subject_id", entity), ("predicate_key", predicate), ("review_state", review_state)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df if least_confidence is None else df.where(F.least("extraction_confidence", "normalization_confidence") >= least_confidence)


def relations(df: DataFrame, kind: str | None = None, least_confidence: float | None = None, review_state: str | None = None, entity: str | None = None, predicate: str | None = None) -> DataFrame:
    """kind: a type, or a family of types."""
    if kind is not None:
        df = df.where(F.col("relation_type").isin(FAMILIES.get(kind, [kind])))
    for column, value in (("review_state", review_state), ("subject_id", entity), ("predicate_key", predicate)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df if least_confidence is None else df.where(F.col("confidence") >= least_confidence)


def with_facts(rel: DataFrame, fact: DataFrame) -> DataFrame:
    side = lambda s: fact.select(F.col("id").alias(f"fact_{s}_id"), F.struct("document_id", "value", "context", "quote").alias(f"fact_{s}"))
    return rel.join(side("a"), "fact_a_id").join(side("b"), "fact_b_id")


def failures(df: DataFrame, document: str | None = None, stage: str | None = None) -> DataFrame:
    df = df if document is None else df.where(F.col("document_id") == document)
    return df if stage is None else df.where(F.col("stage") == stage)


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("pages count from 1 and have 1 to 500 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def document_counts(documents: DataFrame, fact: DataFrame, rel: DataFrame, failure: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    owner = fact.select("id", "document_id")
    touched = rel.select("id", F.explode(F.array_distinct(F.array("fact_a_id", "fact_b_id"))).alias("fact")).join(owner.withColumnRenamed("id", "fact"), "fact").select("id", "document_id").distinct()
    out = documents.select(F.col("id").alias("document_id"))
    for df, name in ((fact, "facts"), (touched, "relations"), (failure, "failures")):
        out = out.join(n(df, name), "document_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def top_per_kind(rel: DataFrame, k: int = 3) -> DataFrame:
    w = W.partitionBy("relation_type").orderBy(F.desc("confidence"), "id")
    return rel.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_reasons(failure: DataFrame, k: int = 10) -> DataFrame:
    return counts(failure, "reason").orderBy(F.desc("n"), "reason").limit(k)


def interleaved(fact: DataFrame) -> DataFrame:
    """Round robin over documents."""
    w = W.partitionBy("document_id").orderBy("id")
    return fact.withColumn("turn", F.row_number().over(w)).orderBy("turn", "document_id")


def band(confidence):
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def search(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(text.lower())))


def report(document: str, fact: DataFrame, rel: DataFrame, failure: DataFrame) -> dict[str, DataFrame]:
    """One document's facts, the relations that touch them, its failures."""
    own = facts(fact, document=document)
    ids = own.select(F.col("id").alias("own"))
    by_a = rel.join(ids, F.col("fact_a_id") == F.col("own"), "left_semi")
    touching = by_a.unionByName(rel.join(ids, F.col("fact_b_id") == F.col("own"), "left_semi").join(ids, F.col("fact_a_id") == F.col("own"), "left_anti"))
    return {"facts": own, "relations": touching, "failures": failures(failure, document=document)}


def documents(df: DataFrame, status: str | None = None, extraction_mode: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("extraction_mode", extraction_mode)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df.orderBy("created_at", "id")


def fact_details(fact: DataFrame) -> DataFrame:
    """Facts with raw_value, normalized_value (as text: the number, else the date, state, identifier or text) and confidence, the lesser of the two."""
    v = lambda k: F.col(f"value.{k}").cast("string")
    return fact.withColumns({"raw_value": F.col("value.raw"), "normalized_value": F.coalesce(v("number"), v("date_value"), v("bool_value"), v("identifier"), v("text"), v("raw")), "confidence": F.least("extraction_confidence", "normalization_confidence")})


def evidence(df: DataFrame, passages: DataFrame, fact: str | None = None, document: str | None = None) -> DataFrame:
    """Evidence with its document and page, in reading order."""
    df = df if fact is None else df.where(F.col("fact_id") == fact)
    at = df.drop("document_id", "page_index").join(passages.select(F.col("id").alias("passage_id"), "document_id", "page_index"), "passage_id")
    return (at if document is None else at.where(F.col("document_id") == document)).orderBy("page_index", "quote_start", "id")


def findings(df: DataFrame, check_type: str | None = None, relation_type: str | None = None, review_state: str | None = None, fact: str | None = None) -> DataFrame:
    for column, value in (("check_type", check_type), ("relation_type", relation_type), ("review_state", review_state)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df if fact is None else df.where(F.array_contains("fact_ids", fact))


def run_counts(passages: DataFrame, cells: DataFrame, candidates: DataFrame, fact: DataFrame, stored: DataFrame, failure: DataFrame, rel: DataFrame, related: DataFrame, asked: DataFrame) -> DataFrame:
    """(counter, n) of a run. stored: facts (ids) before it; related: relations (fact_a_id, fact_b_id) before it; candidates: of extract.statistics; asked: response_json (recorded) and call of replay.budgeted."""
    once = lambda df, counter, n: df.agg(n.alias("n")).select(F.lit(counter).alias("counter"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    n, pair = F.count(F.lit(1)), ["fact_a_id", "fact_b_id"]
    parts = (
        once(passages.select("document_id", "page_index").distinct(), "pages", n), once(passages, "passages", n), once(cells.select("document_id", "page_index", "table_index").distinct(), "tables", n),
        once(candidates, "candidates_seen", F.sum("seen")), once(fact, "facts_extracted", n), once(fact.join(stored, "id", "left_anti"), "facts_created", n), once(fact.join(stored, "id", "left_semi"), "facts_reused", n), once(failure, "failures", n),
        once(rel.join(related, pair, "left_anti"), "relations_created", n), once(rel.join(related, pair, "left_semi"), "relations_updated", n), once(asked, "cache_hits", F.count("response_json")), once(asked, "provider_calls", F.count("call")),
    )
    return reduce(DataFrame.unionAll, parts)


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as a folder of JSON lines."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
