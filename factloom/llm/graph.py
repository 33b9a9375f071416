"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._io import materialize

MAX_STEPS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for each end of an edge (u, v): the least id that it is connected with.

    The edges stay in tables; minima are pre-aggregated, so a vertex with very many
    neighbours isn't gathered in a task. Loops and repeated edges are allowed. No edges give no rows.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = _state(now)
    for _ in range(MAX_STEPS):
        if not before[0]:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components have not settled")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


#: Parts that the rows of one class are dealt into where they meet the class's row.
SALTS = 16


def with_least(rows: DataFrame, value: str) -> DataFrame:
    """The rows (class, ...) with class_id, the least value of their class; null if it has none.

    Minima are pre-aggregated. Rows of classes of several meet them in SALTS parts a class, so that no class is one task's.
    """
    least = rows.groupBy("class").agg(F.min(value).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "least", F.lit(True).alias("several"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.hash("uid"), F.lit(SALTS)))
    return salted.join(least, ["class", "salt"], "left").withColumn("class_id", F.when(F.col("several"), F.col("least")).otherwise(F.col(value))).drop("salt", "least", "several")


def centred(entry: DataFrame, label: DataFrame | None) -> DataFrame:
    """Candidate pairs (a < b) of different components, from entries (key, uid): each uid with the one that it shares most keys with among the keys' centres.

    A key's centre is the least uid of its least component. Without labels every uid is a
    component. One pair a uid at most, so a group whose members share keys pairwise gives as
    many pairs as it has members; keys whose uids are all in one component give none.
    """
    entry = entry.withColumn("label", F.col("uid")) if label is None else entry.join(label.withColumnRenamed("id", "uid"), "uid", "left").select("key", "uid", F.coalesce("label", "uid").alias("label"))
    mid = entry.groupBy("key").agg(F.min(F.struct("label", "uid")).alias("m"), F.max("label").alias("most")).where("m.label < most").select("key", "m")
    met = entry.join(mid, "key").where("label <> m.label").groupBy("uid", F.col("m.uid").alias("end")).agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("uid").agg(F.max(F.struct("n", (-F.col("end")).alias("end"))).alias("x"))
    return best.select(F.least("uid", -F.col("x.end")).alias("a"), F.greatest("uid", -F.col("x.end")).alias("b")).distinct()


def shared(entry: DataFrame) -> DataFrame:
    """The entries (key, uid) whose key several uids have, with two centres of the key's uids, stored.

    lo: the least uid; hi: the one whose keys have most entries in all, which in a group of
    varied copies is mostly the text or picture that they vary.
    """
    size = entry.groupBy("key").agg(F.min("uid").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = materialize(entry.join(size, "key").select("key", "uid", "lo", "n"), "shared")
    weight = found.groupBy("uid").agg(F.sum("n").alias("weight"))
    centre = found.join(weight, "uid").groupBy("key").agg(F.max(F.struct("weight", (-F.col("uid")).alias("uid"))).alias("m"))
    return materialize(found.join(centre, "key").select("key", "uid", "lo", (-F.col("m.uid")).alias("hi")), "shared")


def stars(entry: DataFrame) -> DataFrame:
    """Candidate pairs (a < b), two for each uid at most: of the centres of its keys, those of either kind that it shares most keys with.

    A group of n uids that share keys pairwise gives 2n pairs, not its square; ``across`` finds what they leave apart.
    """
    counted = entry.select("uid", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lo").alias("end")), F.struct(F.lit(1).alias("side"), F.col("hi").alias("end")))).alias("e")).where("uid <> e.end").groupBy("uid", "e").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("uid", "e.side").agg(F.max(F.struct("n", (-F.col("e.end")).alias("end"))).alias("m"))
    return best.select(F.least("uid", -F.col("m.end")).alias("a"), F.greatest("uid", -F.col("m.end")).alias("b")).distinct()


def across(entry: DataFrame, label: DataFrame, near=None, extra: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidate pairs (a < b) of one key and different components, from shared entries.

    near: a condition on the columns of both entries, named with x and y at their ends; it is
    part of the join. extra: from the uids that such keys have to further columns for them.
    """
    entry = entry.join(label.withColumnRenamed("id", "uid"), "uid", "left").select("key", "uid", F.coalesce("label", "uid").alias("label"))
    several = entry.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
    rest = materialize(entry.join(several, "key", "left_semi"), "across")
    if extra is not None:
        rest = rest.join(extra(rest.select("uid").distinct()), "uid")
    left, right = (rest.select(*(F.col(c).alias(f"{c}{s}") for c in rest.columns)) for s in "xy")
    on = (F.col("keyx") == F.col("keyy")) & (F.col("uidx") < F.col("uidy")) & (F.col("labelx") != F.col("labely"))
    both = left.join(right, on if near is None else on & near)
    return both.select(F.col("uidx").alias("a"), F.col("uidy").alias("b")).distinct()
