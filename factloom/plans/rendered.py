"""Reports rendered from the order tables, so that text has facts whose truth is known.

Amounts are whole numbers of the last displayed digit: report A in million, report B in
crore, both with two decimals. Report B is 10 % higher for every fifth nation, and
standalone for those after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, rule, fy, cents, a, b): a in 10,000 and b in 100,000 rupees."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    fy = (F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 4, 1).otherwise(0)).alias("fy")
    out = joined.groupBy(F.col("n_name").alias("nation"), F.col("n_nationkey").alias("rule"), fy).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    b = F.when(F.col("rule") % 5 == 0, F.expr("(cents * 11 + 50000000) div 100000000")).otherwise(F.expr("(cents + 5000000) div 10000000"))
    return out.withColumns({"a": F.expr("(cents + 500000) div 1000000"), "b": b})


def amount(hundredths: Column) -> Column:
    sign = F.when(hundredths < 0, "-").otherwise("")
    return F.concat(sign, F.format_number(F.floor(F.abs(hundredths) / 100).cast("bigint"), 0), F.lit("."), F.lpad((F.abs(hundredths) % 100).cast("string"), 2, "0"))


def fy_short(fy: Column) -> Column:
    return F.concat(F.lit("FY"), F.lpad((fy % 100).cast("string"), 2, "0"))


def passages(rows: DataFrame, document: str, text: Column, order: Column) -> DataFrame:
    """One passage a row; rows need nation."""
    return rows.select(
        F.concat_ws(":", F.lit(document), "nation", order.cast("string")).alias("id"), F.lit(document).alias("document_id"), F.lit(0).alias("page_index"), order.cast("int").alias("reading_order"),
        F.lit("body").alias("role"), text.alias("text"), F.lit(100).alias("char_start"), F.col("nation").alias("subject_id"),
    )


def two_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = order_value(spark, sf_dir)
    scope = F.when(F.col("rule") % 5 == 1, "standalone").otherwise("consolidated")
    line = lambda scope_, number, unit: F.concat(F.lit("The order value on "), scope_, F.lit(" basis for "), fy_short(F.col("fy")), F.lit(" stood at ₹ "), amount(number), F.lit(f" {unit}."))
    return passages(v, "report-a", line(F.lit("consolidated"), F.col("a"), "million"), F.col("fy")).unionByName(passages(v, "report-b", line(scope, F.col("b"), "crore"), F.col("fy")))


def growth_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values, and their stated growth in percent; five points too high for every third nation."""
    v = order_value(spark, sf_dir)
    prior = v.select("nation", (F.col("fy") + 1).alias("fy"), F.col("a").alias("p"))
    bp = F.round((F.col("a") - F.col("p")) * 10000 / F.col("p")).cast("bigint") + F.when(F.col("rule") % 3 == 0, 500).otherwise(0)
    stated = v.join(prior, ["nation", "fy"]).withColumn("bp", bp)
    value = passages(v, "values", F.concat(F.lit("The order value for "), fy_short(F.col("fy")), F.lit(" stood at ₹ "), amount(F.col("a")), F.lit(" million.")), F.col("fy"))
    return value.unionByName(passages(stated, "growth", F.concat(F.lit("The order value increased by "), amount(F.col("bp")), F.lit("% during "), fy_short(F.col("fy")), F.lit(".")), F.col("fy")))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table a nation: a header with the unit and fiscal years, and a row of order values in crore."""
    v = order_value(spark, sf_dir).withColumn("column_index", (F.col("fy") - 1990).cast("int"))
    at = [F.col("nation").alias("document_id"), F.lit(0).alias("page_index"), F.lit(0).alias("table_index")]
    cell = lambda df, row, column, text: df.select(*at, F.lit(row).alias("row_index"), column.cast("int").alias("column_index"), text.alias("text"))
    one = v.select("nation").distinct()
    return cell(one, 0, F.lit(0), F.lit("₹ crore")).unionByName(cell(one, 1, F.lit(0), F.lit("Order value"))).unionByName(cell(v, 0, F.col("column_index"), fy_short(F.col("fy")))).unionByName(cell(v, 1, F.col("column_index"), amount(F.col("b"))))


def grid_passages(cells: DataFrame) -> DataFrame:
    """One passage for each table's page: its cells' texts, row by row."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "column_index", "text"))), lambda c: c["text"]), " | ")
    return cells.groupBy("document_id", "page_index").agg(text.alias("text")).select(F.concat_ws(":", "document_id", F.lit("grid")).alias("id"), F.concat(F.lit("grid of "), "document_id").alias("document_id"), "page_index", F.lit(0).alias("reading_order"), F.lit("body").alias("role"), "text", F.lit(100).alias("char_start"), F.col("document_id").alias("subject_id"))


def line_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order as a column of amounts with their total below, 1,000 too high for every seventh order."""
    from factloom.functions.numbers import number, reused

    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    sums = lines.groupBy("l_orderkey").agg(F.sum("cents").alias("s"), F.max("l_linenumber").alias("n"))
    total = sums.select("l_orderkey", (F.col("n") + 1).alias("row_index"), F.lit("total").alias("predicate_key"), (F.col("s") + F.when(F.col("l_orderkey") % 7 == 0, 100_000).otherwise(0)).alias("cents"))
    rows = lines.select("l_orderkey", F.col("l_linenumber").alias("row_index"), F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("predicate_key"), "cents").unionByName(total)
    rows = rows.withColumn("raw", F.concat(F.lit("₹ "), amount(F.col("cents"))))
    return rows.select(F.col("l_orderkey").cast("string").alias("subject_id"), F.lit("d").alias("document_id"), F.lit(0).alias("page_index"), F.lit(0).alias("table_index"), F.lit(1).alias("column_index"), "row_index", "predicate_key", reused(number, "raw").alias("value"))
