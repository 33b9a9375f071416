"""Model answers, recorded or from a provider that the caller brings: eligibility, budget, validation, grounding."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.numbers import number
from factloom.functions.periods import date_value

ANSWER = "facts array<struct<subject:string,subject_type:string,predicate:string,value_kind:string,raw_value:string,normalized_value:string,identifier_scheme:string,quote:string,confidence:double>>, _corrupt string"
MAX_FACTS = 20
# Confidence by kind of value.
CONFIDENCE = {"boolean": 0.92, "identifier": 0.94, "category": 0.86, "text": 0.82}
VERBS = r"(?iU)\b(?:was|were|is|are|reported|stood|amounted|increased|decreased|grew|declined|appointed|resigned|ceased|announced|acquired|expects?|estimated|projected)\b"


def eligible(passages: DataFrame) -> DataFrame:
    """Body passages of 40 to 6000 characters with a verb of a statement and a sign of a value."""
    return passages.where("role = 'body'").where(F.length("text").between(40, 6000) & F.col("text").rlike(VERBS) & F.col("text").rlike(r"\d|(?i)\b(?:appointed|resigned|ceased|acquired)\b"))


def recorded(cached: DataFrame, models: tuple[str, ...] | None = None, schema_version: int | None = None, prompt_version: int | None = None) -> DataFrame:
    """(passage_hash, response_json, model): one recorded answer for each passage, of the first of the models that has one, of these versions."""
    for column, value in (("schema_version", schema_version), ("prompt_version", prompt_version)):
        if value is not None:
            cached = cached.where(F.col(column) == value)
    rank = F.lit(0)
    if models is not None:
        cached, rank = cached.where(F.col("model").isin(*models)), F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return cached.groupBy("passage_hash").agg(F.min_by(F.struct("response_json", "model"), F.struct(rank, "model", "response_json")).alias("x")).select("passage_hash", "x.*")


def budgeted(passages: DataFrame, cached: DataFrame, budget: int = 150, **which) -> tuple[DataFrame, DataFrame]:
    """(eligible passages with their recorded answer or a place in the budget, one summary failure for each document over it). which: see recorded."""
    e = eligible(passages).withColumn("passage_hash", F.sha2("text", 256)).join(recorded(cached, **which), "passage_hash", "left")
    w = W.partitionBy("document_id", F.col("response_json").isNull()).orderBy("page_index", "reading_order", "id")
    e = e.withColumn("call", F.when(F.col("response_json").isNull(), F.row_number().over(w)))
    over = e.where(F.col("call") > budget).groupBy("document_id").agg(F.count(F.lit(1)).alias("passages_over_budget")).withColumn("reason", F.concat(F.col("passages_over_budget").cast("string"), F.lit(" passages were over the budget")))
    return e.where(F.col("call").isNull() | (F.col("call") <= budget)), over


def fetched(passages: DataFrame, providers: list[tuple[str, Callable[[str], str]]], deadline: float = 60.0, concurrency: int = 4) -> DataFrame:
    """Passages without an answer (id, document_id, text, char_start, passage_hash), asked of a chain of models: with model, response_json, calls and reason.

    A model that raises is dropped for the rest of its partition, and the next is asked. What
    isn't answered within ``deadline`` seconds of a partition's start is given up; reason says so.
    """
    columns = ["id", "document_id", "text", "char_start", "passage_hash"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lost: set[str] = set()
        end, pool = time.monotonic() + deadline, ThreadPoolExecutor(concurrency)

        def ask(text: str) -> tuple[str | None, str | None, int, str | None]:
            calls, reason = 0, "provider: no model is left"
            for name, call in providers:
                if name in lost:
                    continue
                if time.monotonic() >= end:
                    return None, None, calls, "deadline: not asked"
                calls += 1
                try:
                    return name, call(text), calls, None
                except Exception as error:  # whatever a provider raises ends its use
                    lost.add(name)
                    reason = f"provider: {type(error).__name__}"
            return None, None, calls, reason

        try:
            for batch in batches:
                waiting, got = [pool.submit(ask, t) for t in batch["text"]], []
                for one in waiting:
                    try:
                        got.append(one.result(max(0.0, end - time.monotonic())))
                    except Late:
                        got.append((None, None, int(not one.cancel()), "deadline: abandoned"))
                yield batch.assign(**{k: [g[i] for g in got] for i, k in enumerate(("model", "response_json", "calls", "reason"))})
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    kinds = ", ".join(f"{c} {passages.schema[c].dataType.simpleString()}" for c in columns)
    return passages.select(columns).mapInPandas(run, f"{kinds}, model string, response_json string, calls int, reason string")


def answer_statistics(cached: DataFrame, asked: DataFrame, items: DataFrame) -> DataFrame:
    """One row: cache_hits, passages_asked, provider_calls, answered, abandoned, provider_failures, items, accepted, rejected. items: of ground."""
    late = F.coalesce(F.col("reason").startswith("deadline"), F.lit(False))
    parts = (
        cached.agg(F.count("response_json").alias("cache_hits")),
        asked.agg(F.count(F.lit(1)).alias("passages_asked"), F.coalesce(F.sum("calls"), F.lit(0)).alias("provider_calls"), F.count("response_json").alias("answered"), F.count_if(late).alias("abandoned"), F.count_if(F.col("reason").isNotNull() & ~late).alias("provider_failures")),
        items.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count("reason").alias("rejected")),
    )
    return parts[0].withColumn("_k", F.lit(0)).join(parts[1].withColumn("_k", F.lit(0)), "_k").join(parts[2].withColumn("_k", F.lit(0)), "_k").drop("_k")  # one row each


def ground(answered: DataFrame) -> DataFrame:
    """A row for each item of the recorded answers: its fields, offsets, confidence, and reason (null: a fact)."""
    parsed = answered.where("response_json is not null").withColumn("answer", F.from_json("response_json", ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    items = parsed.select("*", F.posexplode_outer("answer.facts").alias("item_no", "item"))
    at = F.instr("text", F.col("item.quote"))
    kind = F.col("item.value_kind")
    missing = F.col("item").isNull() | F.col("item.predicate").isNull() | kind.isNull() | F.col("item.raw_value").isNull() | F.col("item.quote").isNull() | (F.col("item_no") >= MAX_FACTS)
    reason = (
        F.when(missing, "schema: the answer doesn't fit")
        .when(at == 0, "grounding: the quotation was not found verbatim")
        .when(F.instr("item.quote", F.col("item.raw_value")) == 0, "grounding: the raw value was not present in the quotation")
        .when(F.col("item.subject").isNotNull() & (F.instr(F.lower("text"), F.lower("item.subject")) == 0), "grounding: the subject was not present in the passage")
        .when((kind == "number") & number(F.col("item.raw_value"))["number"].isNull(), "normalization: the number could not be read")
        .when((kind == "date") & date_value(F.col("item.raw_value"))["value"].isNull(), "normalization: the date could not be read")
    )
    sure = F.when(kind == "number", number(F.col("item.raw_value"))["confidence"]).when(kind == "date", date_value(F.col("item.raw_value"))["confidence"])
    for k, v in CONFIDENCE.items():
        sure = sure.when(kind == k, v)
    return items.select("document_id", F.col("id").alias("passage_id"), "item.*", F.when(reason.isNull(), F.col("char_start") + at - 1).alias("quote_start"), sure.alias("normalization_confidence"), reason.alias("reason"))
