"""Documents as files, their registration by content, and the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_BYTES = 100 << 20


def discover(spark: SparkSession, paths: list[str]) -> DataFrame:
    """PDF files under the paths: path, length, content, content_hash, document_id, reason (why not usable, else null). One row per path.

    A path that is missing, is another kind of file or holds no PDF file is an error.
    """
    found = lambda where: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(where)
    for path in paths:
        if found(path).select("path").isEmpty():
            raise ValueError(f"no PDF files at {path}")
    files = found(paths).dropDuplicates(["path"])
    digest = F.sha2("content", 256)
    reason = F.when(F.col("length") == 0, "empty file").when(F.col("length") > MAX_BYTES, "larger than 100 MiB").when(F.instr(F.substring("content", 1, 1024).cast("string"), "%PDF-") == 0, "no PDF header")
    return files.select("path", "length", "content", digest.alias("content_hash"), F.concat(F.lit("doc_"), F.substring(digest, 1, 24)).alias("document_id"), reason.alias("reason"))


def register(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The new documents (content_hash, original_filename, ...) whose content isn't stored, one for each content: the first by name."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy("content_hash").orderBy("original_filename"))).where("_n = 1").drop("_n")
    return first.join(stored.select("content_hash"), "content_hash", "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """Stored rows, replaced by new ones of the same key; of repeated new rows the one with the highest ``latest`` stays, without it any.

    Columns that the new row leaves null keep their stored value.
    """
    one = new.dropDuplicates(keys) if latest is None else new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(latest)))).where("_n = 1").drop("_n")
    others = [c for c in stored.columns if c not in keys]
    s, n = stored.withColumn("_s", F.lit(True)), one.select(*keys, *(F.col(c).alias(f"_{c}") for c in others))
    return s.join(n, keys, "full_outer").select(*(F.col(c) if c in keys else F.coalesce(f"_{c}", c).alias(c) for c in stored.columns))


def _claimed(stored: DataFrame, new: DataFrame) -> DataFrame:
    claim = F.sha2(F.to_json(F.struct("subject_id", "predicate_key", "value.number", "value.text", "value.identifier", "value.unit", "value.currency", "context.period", "context.scope", "context.basis", "context.as_of", "context.geography", "document_id")), 256)
    return stored.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)), allowMissingColumns=True).withColumn("fingerprint", claim)


def store_facts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Facts with a fingerprint of what they claim and where; a claim repeated in a document is kept once, its places are in ``evidence``."""
    both = _claimed(stored, new)
    return both.withColumn("_n", F.row_number().over(W.partitionBy("fingerprint").orderBy("_o", "id"))).where("_n = 1").drop("_n", "_o")


def evidence(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(fact_id, document_id, passage_id, quote, quote_start, quote_end): every place of each claim, under the id of the fact that is kept."""
    both = _claimed(stored, new)
    kept = both.groupBy("fingerprint").agg(F.min_by("id", F.struct("_o", "id")).alias("fact_id"))
    return both.join(kept, "fingerprint").select("fact_id", "document_id", "passage_id", "quote", "quote_start", "quote_end").distinct()


def canonical_relations(relations: DataFrame) -> DataFrame:
    """One row per unordered pair, least id first; the sides of each difference follow."""
    swap = F.col("fact_a_id") > F.col("fact_b_id")
    turned = F.transform("context_diff", lambda r: F.struct(r["field"].alias("field"), r["right"].alias("left"), r["left"].alias("right"), r["explains"].alias("explains")))
    out = relations.withColumn("context_diff", F.when(swap, turned).otherwise(F.col("context_diff"))).withColumns({"fact_a_id": F.least("fact_a_id", "fact_b_id"), "fact_b_id": F.greatest("fact_a_id", "fact_b_id")})
    return out.dropDuplicates(["fact_a_id", "fact_b_id"])


def clear_document(document_id: str, facts: DataFrame, relations: DataFrame, findings: DataFrame, failures: DataFrame, passages: DataFrame) -> dict[str, DataFrame]:
    """All tables without what came from the document: its facts, and relations and findings that touch them."""
    gone = facts.where(F.col("document_id") == document_id).select(F.col("id").alias("gone"))
    touched = findings.select("id", F.explode("fact_ids").alias("gone")).join(gone, "gone", "left_semi").select("id").distinct()
    other = lambda df: df.where(~F.col("document_id").eqNullSafe(F.lit(document_id)))
    kept = relations.join(gone, F.col("fact_a_id") == F.col("gone"), "left_anti").join(gone, F.col("fact_b_id") == F.col("gone"), "left_anti")
    return {"facts": other(facts), "relations": kept, "findings": findings.join(touched, "id", "left_anti"), "failures": other(failures), "passages": other(passages)}


def set_status(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents with the non-null columns of changes (id, status, extraction_mode, page_count) applied."""
    c = changes.select("id", *(F.col(k).alias(f"_{k}") for k in changes.columns if k != "id"))
    fresh = {k: F.coalesce(f"_{k}", k) for k in changes.columns if k != "id"}
    return documents.join(c, "id", "left").withColumns(fresh).select(*documents.columns)
