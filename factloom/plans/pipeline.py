"""From passages to facts, stored once, and lazily from those to relations and findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import audit, compare, extract, layout
from factloom.sources.stored import stored


@dataclass
class Result:
    facts: DataFrame
    failures: DataFrame
    relations: DataFrame
    findings: DataFrame


def run(passages: DataFrame, defaults: DataFrame | None = None, cross_document: bool = False, tables: DataFrame | None = None, cells: DataFrame | None = None) -> Result:
    """passages: schemas.PASSAGES and subject_id; without that column the subject is what the document reports on.

    With tables (boxes of each page's tables) also boxes, and numbers in tables are no prose
    facts; with cells (schemas.CELLS) the tables' numbers are facts too. Totals aren't checked here (see audit.totals).
    """
    if "subject_id" not in passages.columns:
        passages = extract.with_subjects(passages, extract.reporting_entity(passages.select("document_id", "page_index", "text")))
    facts, failures = extract.parted(stored(extract.extracted(passages if tables is None else layout.outside_tables(passages, tables), defaults), "extracted"))
    if cells is not None:
        more, lost = extract.cell_facts(layout.keep_tables(cells), passages)
        facts, failures = facts.unionByName(stored(more, "cell-facts")), failures.unionByName(lost)
    relations = compare.relations(compare.pairs(facts, cross_document=cross_document))
    growth = audit.discover_growth(facts)
    kept = growth.select("id", "check_type", "relation_type", F.array("stated.id", "current.id", "prior.id").alias("fact_ids"), "operands", "confidence")
    repeated = audit.repeated_metrics(relations).select("id", "check_type", "relation_type", "fact_ids", F.lit(None).cast("string").alias("operands"), "confidence")
    return Result(facts, failures, relations, kept.unionByName(repeated))


def link_new(stored: DataFrame, new: DataFrame, cross_document: bool = False) -> DataFrame:
    """Relations of new facts with all facts of their groups; old pairs aren't compared again."""
    return compare.relations(compare.pairs(stored, new=new, cross_document=cross_document))
