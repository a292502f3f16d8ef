"""Spend views, roll-ups, totals, day sections, named rows (AG1-AG9, JN4-JN6, SRT4, WIN5-WIN7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.functions.clock import local_day, local_month
from pursebook.functions.money import signed

PRIMARY = "NPR"
UNCATEGORIZED = "Uncategorized"
HEATMAP_DAYS = 371

is_debit, is_credit = (lambda: F.col("direction") == "DEBIT"), (lambda: F.col("direction") == "CREDIT")


def is_transfer() -> Column:
    return F.col("transfer_group_id").isNotNull() | F.col("excluded_from_spend")


def monthly_spend(txns: DataFrame) -> DataFrame:
    """Sums are null, not 0, where no row qualifies."""
    return (
        txns.where(~F.col("excluded_from_spend"))
        .groupBy("user_id", local_month(F.col("occurred_at")).alias("month"), "category_id", "currency")
        .agg(F.sum(F.when(is_debit(), F.col("amount_paisa"))).alias("spent_paisa"), F.sum(F.when(is_credit(), F.col("amount_paisa"))).alias("received_paisa"), F.count("*").alias("txn_count"))
    )


def daily_spend(txns: DataFrame) -> DataFrame:
    return (
        txns.where(~F.col("excluded_from_spend"))
        .groupBy("user_id", local_day(F.col("occurred_at")).alias("day"), "currency")
        .agg(F.sum(F.when(is_debit(), F.col("amount_paisa"))).alias("spent_paisa"), F.count_if(is_debit()).alias("txn_count"))
    )


def month_totals(months: DataFrame) -> DataFrame:
    """Spent and received of the primary currency; here null counts as 0."""
    return months.where(F.col("currency") == PRIMARY).groupBy("user_id", "month").agg(
        F.sum(F.coalesce("spent_paisa", F.lit(0))).alias("spent_paisa"), F.sum(F.coalesce("received_paisa", F.lit(0))).alias("received_paisa")
    )


def with_names(txns: DataFrame, accounts: DataFrame, categories: DataFrame) -> DataFrame:
    a = accounts.select(F.col("id").alias("account_id"), F.col("display_name").alias("account_name"))
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return txns.join(a, "account_id", "left").join(c, "category_id", "left")


def category_rollup(months: DataFrame, categories: DataFrame, *by: str) -> DataFrame:
    """(.., side, group_name, leaf_name, spent, txns): spend by leaf under its group, for each ``by``.

    A category without a parent is its own group; one missing from the dimension is
    uncategorised and counts as spend."""
    c = categories.alias("c").join(categories.alias("p"), F.col("c.parent_id") == F.col("p.id"), "left").select(
        F.col("c.id").alias("category_id"), F.col("c.name").alias("leaf_name"), F.coalesce("p.name", "c.name").alias("group_name"),
        F.coalesce("p.is_spend", "c.is_spend", F.lit(True)).alias("is_spend"),
    )
    rows = months.where(F.col("spent_paisa") > 0).join(c, "category_id", "left")
    side = F.when(F.coalesce("is_spend", F.lit(True)), "spend").otherwise("excluded")
    named = lambda x: F.coalesce(x, F.lit(UNCATEGORIZED))
    return rows.groupBy(*by, side.alias("side"), named(F.col("group_name")).alias("group_name"), named(F.col("leaf_name")).alias("leaf_name")).agg(
        F.sum("spent_paisa").alias("spent_paisa"), F.sum("txn_count").alias("txn_count")
    )


def group_shares(leaves: DataFrame) -> DataFrame:
    """Groups with their rank and share; shares are of spend only."""
    groups = leaves.groupBy("side", "group_name").agg(F.sum("spent_paisa").alias("spent_paisa"), F.sum("txn_count").alias("txn_count"))
    side = W.partitionBy("side")
    percent = F.col("spent_paisa") * 100 / F.sum("spent_paisa").over(side)
    text = F.when((percent > 0) & (percent < 1), "<1%").otherwise(F.concat(F.round(percent, 0).cast("int").cast("string"), F.lit("%")))
    return groups.withColumns({
        "rank": F.row_number().over(side.orderBy(F.desc("spent_paisa"), "group_name")),
        "share": F.when(F.col("side") == "spend", text),
    })


def page_totals(rows: DataFrame) -> DataFrame:
    out = lambda d: F.coalesce(F.sum(F.when((F.col("direction") == d) & ~is_transfer(), F.col("amount_paisa"))), F.lit(0))
    return rows.agg(out("DEBIT").alias("out_paisa"), out("CREDIT").alias("in_paisa"))


def day_sections(rows: DataFrame, *by: str) -> DataFrame:
    """Local days of a sorted list with their net, transfers left out; of one list for each ``by``."""
    net = F.when(~is_transfer(), signed(F.col("amount_paisa"), F.col("direction"))).otherwise(0)
    return rows.groupBy(*by, local_day(F.col("occurred_at")).alias("day")).agg(F.count("*").alias("n"), F.sum(net).alias("net_paisa"))


def quartile_cuts(days: DataFrame, amount: str = "spent_paisa") -> DataFrame:
    """Per user q1..q3 of the non-zero days: the element at floor(n*k/4), 0-based, clamped.

    By rank, so that no list of days is collected; a user has at most a day per day."""
    w = W.partitionBy("user_id").orderBy(amount, "day")
    ranked = days.where(F.col(amount) > 0).select("user_id", F.col(amount).alias("v"), (F.row_number().over(w) - 1).alias("r"), F.count("*").over(W.partitionBy("user_id")).alias("n"))
    at = lambda k: F.least(F.floor(F.col("n") * k / 4), F.col("n") - 1)
    return ranked.groupBy("user_id").agg(*[F.max(F.when(F.col("r") == at(k), F.col("v"))).alias(f"q{k}") for k in (1, 2, 3)])


def bucket(amount: Column) -> Column:
    return F.when(F.coalesce(amount, F.lit(0)) <= 0, 0).when(amount <= F.col("q1"), 1).when(amount <= F.col("q2"), 2).when(amount <= F.col("q3"), 3).otherwise(4)


def heatmap(daily: DataFrame, gaps: DataFrame, last_day: str, days: int = HEATMAP_DAYS) -> DataFrame:
    """A calendar without holes per user: beforeData, uncertainGap or spend, with a bucket.

    daily: (user_id, day, spent_paisa); gaps: (user_id, after_day, before_day), both ends
    exclusive.  The calendar has ``days`` rows a user; gaps are expanded to their days, so
    the range join is an equi-join."""
    end = F.lit(last_day).cast("date")
    first = daily.groupBy("user_id").agg(F.min("day").alias("earliest"))
    calendar = first.select("user_id", "earliest", F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    inner = gaps.where(F.date_diff("before_day", "after_day") > 1).select("user_id", F.explode(F.sequence(F.date_add("after_day", 1), F.date_sub("before_day", 1))).alias("day")).distinct().withColumn("in_gap", F.lit(True))
    window = daily.where(F.col("day").between(F.date_sub(end, days - 1), end))
    cuts = quartile_cuts(window)
    rows = calendar.join(window.select("user_id", "day", "spent_paisa"), ["user_id", "day"], "left").join(inner, ["user_id", "day"], "left").join(cuts, "user_id", "left")
    kind = F.when(F.col("day") < F.col("earliest"), "beforeData").when(F.coalesce("in_gap", F.lit(False)), "uncertainGap").otherwise("spend")
    amount = F.coalesce("spent_paisa", F.lit(0))
    column = F.floor((F.date_diff(F.col("day"), F.date_sub(end, days - 1)) + F.dayofweek(F.date_sub(end, days - 1)) - 1) / 7).cast("int")
    return rows.select("user_id", "day", kind.alias("kind"), F.when(kind == "spend", amount).alias("spent_paisa"), F.when(kind == "spend", bucket(amount)).alias("bucket"), column.alias("week"), (F.dayofweek("day") - 1).alias("weekday"))
