"""How spending moves: burn against last month, change of each category from month to month."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.operators import views


def cumulative_burn(txns: DataFrame, until: date) -> DataFrame:
    """(user_id, currency, day, spent_paisa, last_month_paisa, difference_paisa) for every
    local day from a user's first month to ``until``: what the month has cost up to that day,
    and what the month before had cost up to the same day of the month, or to its end if it is
    shorter.  The first month has nothing to compare with (nulls).

    Sums are made on two levels: by day, with map-side combine, and then along the days of a
    month, at most 31 rows.  Rows after ``until`` are left out."""
    key = ("user_id", "currency")
    days = views.daily_spend(txns).where(F.col("day") <= F.lit(until)).select(*key, "day", F.coalesce("spent_paisa", F.lit(0)).alias("_paisa"))
    grid = days.groupBy(*key).agg(F.min("day").alias("_first")).select(*key, F.explode(F.sequence(F.trunc("_first", "month"), F.lit(until))).alias("day"), F.lit(0).cast("bigint").alias("_paisa"))
    dense = days.unionByName(grid).groupBy(*key, "day").agg(F.sum("_paisa").alias("_paisa"))
    month = W.partitionBy(*key, F.trunc("day", "month")).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    running = dense.select(*key, "day", F.sum("_paisa").over(month).alias("spent_paisa"))
    # add_months ends at the last day of a shorter month.
    before = running.select(F.col("user_id").alias("_u"), F.col("currency").alias("_c"), F.col("day").alias("_d"), F.col("spent_paisa").alias("last_month_paisa"))
    on = F.col("user_id").eqNullSafe(F.col("_u")) & F.col("currency").eqNullSafe(F.col("_c")) & (F.add_months("day", -1) == F.col("_d"))
    return running.join(before, on, "left").select(*key, "day", "spent_paisa", "last_month_paisa", (F.col("spent_paisa") - F.col("last_month_paisa")).alias("difference_paisa"))


def category_changes(months: DataFrame, categories: DataFrame, until: date) -> DataFrame:
    """(user_id, currency, month, side, group_name, leaf_name, spent_paisa, previous_paisa,
    change_paisa, share_bp) of every group (leaf_name null) and leaf.

    A category has a row for every month from its first to the one after its last, but not
    after that of ``until``: it starts from 0, pauses at 0 and ends at 0.  ``share_bp`` is the
    amount in hundredths of a percent, rounded down, of the user's spend of that month; null
    for what does not count as spend."""
    key = ("user_id", "currency", "side", "group_name", "leaf_name")
    leaves = views.category_rollup(months, categories, "user_id", "currency", "month").withColumn("month", F.col("month").cast("date"))
    both = leaves.select(*key, "month", "spent_paisa").unionByName(leaves.select("user_id", "currency", "side", "group_name", F.lit(None).cast("string").alias("leaf_name"), "month", "spent_paisa"))
    last = F.trunc(F.lit(until), "month")
    both = both.where(F.col("month") <= last).groupBy(*key, "month").agg(F.sum("spent_paisa").alias("spent_paisa"))
    span = both.groupBy(*key).agg(F.min("month").alias("_a"), F.least(F.add_months(F.max("month"), 1), last).alias("_b"))
    grid = span.select(*key, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL '1' MONTH"))).alias("month"), F.lit(0).cast("bigint").alias("spent_paisa"))
    dense = both.unionByName(grid).groupBy(*key, "month").agg(F.sum("spent_paisa").alias("spent_paisa"))
    previous = F.lag("spent_paisa", 1, 0).over(W.partitionBy(*key).orderBy("month"))
    spend = F.sum("spent_paisa").over(W.partitionBy("user_id", "currency", "month", "side", F.col("leaf_name").isNull()))
    share = F.when((F.col("side") == "spend") & (spend > 0), F.floor(F.col("spent_paisa").cast("decimal(20,0)") * 10000 / spend).cast("bigint"))
    rows = dense.withColumns({"previous_paisa": previous, "share_bp": share})
    return rows.select("user_id", "currency", "month", "side", "group_name", "leaf_name", "spent_paisa", "previous_paisa", (F.col("spent_paisa") - F.col("previous_paisa")).alias("change_paisa"), "share_bp")
