"""Measures: one key has one kind of value for ever; aliases belong to one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predicates, conflicts) of mentions (key, label, value_kind, ord). The first kind and label of a key win; a mention of another kind is a conflict."""
    firsts = mentions.groupBy("key").agg(F.min_by("value_kind", "ord").alias("kind"), F.min_by("label", "ord").alias("display_name"))
    joined = mentions.join(firsts, "key")
    good = joined.where("value_kind = kind")
    predicates = good.groupBy("key").agg(F.first("display_name").alias("display_name"), F.first("kind").alias("value_kind"), F.array_sort(F.collect_set("label")).alias("aliases"))
    return predicates, joined.where("value_kind <> kind").select("key", "label", "value_kind", "kind", F.concat(F.lit("the measure holds values of kind "), "kind").alias("reason"))


def resolve(labels: DataFrame, predicates: DataFrame, label_col: str = "label") -> DataFrame:
    """Each label with the key that has it as an alias, in any case; null for none. An alias of several keys goes to the least."""
    alias = predicates.select("key", F.explode("aliases").alias("alias")).groupBy(F.lower("alias").alias("alias")).agg(F.min("key").alias("key"))
    return labels.join(alias, F.lower(F.col(label_col)) == F.col("alias"), "left").drop("alias")
