"""Documents that arrive as a stream: stateless extraction, then a delta join in each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import compare, extract
from factloom.schemas import FACTS


def start(spark: SparkSession, passages: DataFrame, folder: str, checkpoint: str, cross_document: bool = False) -> StreamingQuery:
    """Each batch's facts go to ``folder``/facts, their relations with all facts before to ``folder``/relations.

    A batch writes folders named by its number, with overwriting, so a repeated batch leaves
    the same rows; its stored facts are those of smaller numbers.
    """

    def batch(df: DataFrame, n: int) -> None:
        facts, failures = extract.numeric_facts(df)
        facts.write.mode("overwrite").parquet(f"{folder}/facts/batch={n}")
        failures.write.mode("overwrite").parquet(f"{folder}/failures/batch={n}")
        new = spark.read.schema(FACTS).parquet(f"{folder}/facts/batch={n}")
        stored = spark.read.schema(f"{FACTS}, batch long").parquet(f"{folder}/facts").where(f"batch < {n}").drop("batch")
        compare.relations(compare.pairs(stored, new=new, cross_document=cross_document)).write.mode("overwrite").parquet(f"{folder}/relations/batch={n}")

    return passages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
