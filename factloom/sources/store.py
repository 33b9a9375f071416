"""Stored evidence, findings, recorded answers and entities: what a new batch adds to them, and old layouts brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.names import short_hash
from factloom.sources.documents import upsert

ANSWER_KEY = ("passage_hash", "model", "schema_version", "prompt_version")
SPAN = ("fact_id", "passage_id", "quote_start", "quote_end")
#: Columns that each version of the stored tables added, with what older rows get there.
LAYOUTS = {2: {"passages": {"role": "body"}}, 3: {"answers": {"schema_version": 1}}, 4: {}}
VERSION = max(LAYOUTS)


def _first(df: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def store_evidence(stored: DataFrame, new: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored rows and the new ones, rejected new rows with their reason). Rows: id, fact_id, passage_id, quote, quote_start, quote_end.

    A quotation is cut again from its passage. A span that its fact already has is skipped. An
    id that other evidence has gives way to one made of the id and the span; of new rows with
    one id the first by fact and span keeps it.
    """
    where = passages.select(F.col("id").alias("passage_id"), F.col("text").alias("_text"), F.col("char_start").alias("_from"))
    cut = F.substr("_text", F.col("quote_start") - F.col("_from") + 1, F.col("quote_end") - F.col("quote_start"))
    reason = F.when(F.col("_text").isNull(), "missing passage").when(~cut.eqNullSafe(F.col("quote")) | (F.length("quote") == 0), "grounding: the quotation was not found at its place")
    seen = new.join(where, "passage_id", "left").withColumn("reason", reason)
    fresh = _first(seen.where("reason is null"), SPAN, "id").select(stored.columns).join(stored.select(*SPAN), [*SPAN], "left_anti")
    turn = F.row_number().over(W.partitionBy("id").orderBy(*SPAN))
    owned = fresh.withColumn("_turn", turn).join(stored.select("id", F.lit(True).alias("_owned")).distinct(), "id", "left")
    other = F.coalesce("_owned", F.lit(False)) | (F.col("_turn") > 1)
    return stored.unionByName(owned.withColumn("id", F.when(other, short_hash("evidence_", F.col("id"), *map(F.col, SPAN))).otherwise(F.col("id"))).select(stored.columns)), seen.where("reason is not null").select(*new.columns, "reason")


def store_findings(stored: DataFrame, new: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, operands, rejected). Findings: id, check_type, formula, fact_ids, ...; stored ones have a fingerprint of what they check too.

    A finding with an operand that isn't a stored fact is rejected, with the missing ids. A
    check made again replaces the stored one under its old id; of repeated new ones the least
    id counts. operands: finding_id, position (from 0), fact_id.
    """
    rows = new.withColumn("fingerprint", F.sha2(F.to_json(F.struct("check_type", "fact_ids", "formula")), 256))
    operand = rows.select("fingerprint", F.explode("fact_ids").alias("_fact")).distinct()
    missing = operand.join(facts.select(F.col("id").alias("_fact")), "_fact", "left_anti").groupBy("fingerprint").agg(F.array_sort(F.collect_set("_fact")).alias("missing"))
    good = _first(rows.join(missing, "fingerprint", "left_anti"), ("fingerprint",), "id")
    known = stored.select("fingerprint", F.col("id").alias("_id"))
    fresh = good.join(known, "fingerprint", "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")
    kept = stored.join(good.select("fingerprint"), "fingerprint", "left_anti").unionByName(fresh)
    return kept, kept.select(F.col("id").alias("finding_id"), F.posexplode("fact_ids").alias("position", "fact_id")), rows.join(missing, "fingerprint").drop("fingerprint")


def store_answers(stored: DataFrame, new: DataFrame, latest: str = "created_at") -> DataFrame:
    """Recorded answers, one for each passage, model and pair of versions: the latest."""
    return upsert(stored, new, list(ANSWER_KEY), latest)


def store_entities(entities: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fact_id and entity_id of each subject, entities with the new ones).

    subjects: fact_id, subject_id, name, entity_type, confidence, review_state. A subject is
    the entity with its id, else the least one with its name (in any case) and type, else a new one.
    """
    kind = F.coalesce("entity_type", F.lit("unknown"))
    s = subjects.withColumns({"_name": F.lower("name"), "_kind": kind})
    by_id = entities.select(F.col("id").alias("subject_id"), F.col("id").alias("_by_id"))
    by_name = entities.groupBy(F.lower("canonical_name").alias("_name"), F.col("entity_type").alias("_kind")).agg(F.min("id").alias("_by_name"))
    own = F.coalesce("subject_id", short_hash("entity_", F.col("_name"), F.col("_kind")))
    found = s.join(by_id, "subject_id", "left").join(by_name, ["_name", "_kind"], "left").withColumns({"entity_id": F.coalesce("_by_id", "_by_name", own), "_new": F.col("_by_id").isNull() & F.col("_by_name").isNull()})
    least = F.struct("name", "fact_id")
    made = found.where("_new").groupBy(F.col("entity_id").alias("id")).agg(F.min_by("name", least).alias("canonical_name"), F.min_by("_kind", least).alias("entity_type"), F.min("confidence").alias("confidence"), F.min_by("review_state", least).alias("review_state"))
    return found.select("fact_id", "entity_id"), entities.unionByName(made, allowMissingColumns=True)


def alias_evidence(resolved: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, alias, evidence_ids): the evidence of each name that an entity was merged under. evidence: mention_id, evidence_id."""
    merged = resolved.where("method in ('identifier', 'exact_name', 'fuzzy_name')").select(F.col("id").alias("mention_id"), "entity_id", F.col("name").alias("alias"))
    return merged.join(evidence, "mention_id").groupBy("entity_id", "alias").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))


def migrated(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """Tables of an older layout in the present one; a version that isn't known is an error."""
    if version != 1 and version not in LAYOUTS:
        raise ValueError(f"tables of version {version} are not supported; the present one is {VERSION}")
    out = dict(tables)
    for step in range(version + 1, VERSION + 1):
        for name, columns in LAYOUTS[step].items():
            for column, value in columns.items():
                if name in out and column not in out[name].columns:
                    out[name] = out[name].withColumn(column, F.lit(value))
    return out
