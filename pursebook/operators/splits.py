"""Splitting a transaction over categories, to the paisa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_splits(txns: DataFrame, parts: DataFrame) -> DataFrame:
    """Transactions with those that have parts replaced by them, as (.., part_no); the month
    and category views see the parts' categories and amounts.

    parts: (txn_id, part_no, category_id, weight).  An amount is shared in proportion to the
    weights, rounded down, and what is left goes paisa by paisa to the largest remainders, of
    equal ones to the smallest part_no, then category, then the greatest weight.  Weights below 0 or null count as 0; if
    all are 0 the parts are equal.  Parts that come to nothing have no row, parts of unknown
    transactions neither.  One shuffle by id; the parts of one transaction are a few rows."""
    own = parts.select("txn_id", F.col("part_no").alias("_no"), F.col("category_id").alias("_category"), F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("decimal(19,0)").alias("_w"), F.lit(True).alias("_split"))
    rows = txns.join(own, F.col("id") == F.col("txn_id"), "left").drop("txn_id")
    of_txn = W.partitionBy("id")
    rows = rows.withColumn("_all", F.sum("_w").over(of_txn))
    rows = rows.withColumn("_all", F.when(F.col("_all") > 0, F.col("_all")).otherwise(F.greatest(F.count("_split").over(of_txn), F.lit(1)))).withColumn("_w", F.when(F.sum("_w").over(of_txn) > 0, F.col("_w")).otherwise(1))
    exact = F.col("amount_paisa").cast("decimal(19,0)") * F.col("_w").cast("decimal(19,0)")
    rows = rows.withColumn("_exact", exact).withColumn("_all", F.col("_all").cast("decimal(38,0)")).withColumn("_base", F.expr("_exact div _all"))
    rows = rows.withColumn("_rest", F.col("_exact") - F.col("_base").cast("decimal(19,0)") * F.col("_all").cast("decimal(19,0)"))
    rank = F.row_number().over(of_txn.orderBy(F.desc("_rest"), "_no", "_category", F.desc("_w")))
    left = F.col("amount_paisa") - F.sum("_base").over(of_txn)
    paisa = F.when(F.col("_split"), F.col("_base") + F.when(rank <= left, 1).otherwise(0)).otherwise(F.col("amount_paisa"))
    rows = rows.withColumn("amount_paisa", paisa).where(F.col("_split").isNull() | (F.col("amount_paisa") > 0))
    rows = rows.withColumn("category_id", F.when(F.col("_split"), F.col("_category")).otherwise(F.col("category_id"))).withColumn("part_no", F.col("_no"))
    return rows.select(*txns.columns, "part_no")


def unbalanced(txns: DataFrame, split: DataFrame) -> DataFrame:
    """(id, amount_paisa, parts_paisa) of transactions whose parts do not add up: none, if the
    constraint holds."""
    whole = txns.groupBy("id").agg(F.sum("amount_paisa").alias("amount_paisa"))
    sums = split.groupBy(F.col("id").alias("_id")).agg(F.sum("amount_paisa").alias("parts_paisa"))
    return whole.join(sums, F.col("id").eqNullSafe(F.col("_id")), "full_outer").where(~F.col("amount_paisa").eqNullSafe(F.col("parts_paisa"))).select(F.coalesce("id", "_id").alias("id"), "amount_paisa", "parts_paisa")
