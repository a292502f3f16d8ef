"""Balance chains: gaps, their life cycle and how to fill them (WIN1, JN2, SNK4, SNK5, PRJ2, WIN9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.functions.money import signed

GAP_KEY = ("account_id", "after_txn_id", "before_txn_id")
RECONCILER = "RECONCILER"


#: What a gap found now knows of its two ends; a stored gap has to look it up.
ENDS = ("after_occurred_at", "before_occurred_at", "after_balance_paisa", "before_balance_paisa")


def gaps_with_ends(rows: DataFrame, bucket: str = "month") -> DataFrame:
    """Neighbours in an account's chain whose balances do not add up, with times and balances.

    Rows without a balance leave first, with their amount: what they moved is a gap.
    An account may be very large, so its chain is sorted in pieces of a month.  Only the first
    and the last row of each piece, and rows that follow a gap, go on to a second window: there
    the first row of a piece finds its predecessor among the account's first and last rows,
    and the others are sent by piece again and left alone."""
    order = ("occurred_at", "id")
    own = F.struct(F.col("id").alias("p"), F.col("balance_after_paisa").alias("b"), F.col("occurred_at").alias("t"))
    chain = rows.where(F.col("balance_after_paisa").isNotNull()).select("account_id", *order, "direction", "amount_paisa", "balance_after_paisa").withColumn("_piece", F.date_trunc(bucket, "occurred_at"))
    piece = W.partitionBy("account_id", "_piece").orderBy(*order)
    missing = F.col("balance_after_paisa") - F.col("_prev.b") - signed(F.col("amount_paisa"), F.col("direction"))
    inner = chain.withColumns({"_prev": F.lag(own).over(piece), "_last": F.lead("id").over(piece).isNull()}).withColumn("_missing", missing)
    edge = F.col("_prev").isNull() | F.col("_last")
    kept = inner.where(edge | (F.col("_missing") != 0)).withColumn("_run", F.when(~edge, F.col("_piece")))
    account = W.partitionBy("account_id", "_run").orderBy(*order)
    linked = kept.withColumn("_prev", F.coalesce("_prev", F.lag(own).over(account))).withColumn("_missing", missing)
    return linked.where("_missing <> 0").select(
        "account_id", F.col("_prev.p").alias("after_txn_id"), F.col("id").alias("before_txn_id"), F.col("_missing").alias("missing_paisa"),
        F.col("_prev.t").alias("after_occurred_at"), F.col("occurred_at").alias("before_occurred_at"), F.col("_prev.b").alias("after_balance_paisa"), F.col("balance_after_paisa").alias("before_balance_paisa"),
    )


def find_gaps(rows: DataFrame, bucket: str = "month") -> DataFrame:
    """(account_id, after_txn_id, before_txn_id, missing_paisa) of every gap."""
    return gaps_with_ends(rows, bucket).drop(*ENDS)


def record_gaps(known: DataFrame, found: DataFrame) -> DataFrame:
    """known gaps with ``resolved`` brought up to date, and the new ones.

    An open gap that is not found again is resolved; a key that is known is not inserted.
    Both sides meet in one grouping by key."""
    other = [c for c in known.columns if c not in GAP_KEY]
    mine = known.select(*GAP_KEY, F.struct(*other).alias("_known"), F.lit(None).cast("bigint").alias("_missing"))
    new = found.select(*GAP_KEY, F.lit(None).cast(mine.schema["_known"].dataType).alias("_known"), F.col("missing_paisa").cast("bigint").alias("_missing"))
    rows = mine.unionByName(new).groupBy(*GAP_KEY).agg(F.first("_known", ignorenulls=True).alias("_known"), F.max("_missing").alias("_missing"))
    old = F.col("_known").isNotNull()
    closed = old & ~F.col("_known.resolved") & F.col("_missing").isNull()
    value = {c: F.col(f"_known.{c}") for c in other}
    value["missing_paisa"] = F.when(old, value["missing_paisa"]).otherwise(F.col("_missing"))
    value["resolved"] = F.when(old, value["resolved"] | closed).otherwise(F.lit(False))
    value["resolved_by"] = F.when(closed, F.lit(RECONCILER)).otherwise(value["resolved_by"])
    return rows.select(*GAP_KEY, *(value[c].alias(c) for c in other)).select(*known.columns)


def open_gaps(gaps: DataFrame, accounts: DataFrame, txns: DataFrame) -> DataFrame:
    """Open gaps with the account's name and what is known of their two ends.

    Gaps that were found just now bring that along.  For stored ones the rows of their ends
    are looked up by id, once, and both ends of a gap are put together again."""
    a = accounts.select(F.col("id").alias("account_id"), F.col("display_name").alias("account_display_name"))
    still = gaps.where(~F.col("resolved"))
    if not set(ENDS) <= set(gaps.columns):
        ends = still.select(*GAP_KEY, F.explode(F.array(F.struct(F.lit("after").alias("side"), F.col("after_txn_id").alias("end_id")), F.struct(F.lit("before").alias("side"), F.col("before_txn_id").alias("end_id")))).alias("_e")).select(*GAP_KEY, "_e.*")
        rows = txns.select(F.col("id").alias("end_id"), "occurred_at", "balance_after_paisa")
        of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
        known = ends.join(rows, "end_id").groupBy(*GAP_KEY).agg(
            F.count_distinct("side").alias("_sides"), *(of(s, c).alias(f"{s}_{n}") for c, n in (("occurred_at", "occurred_at"), ("balance_after_paisa", "balance_paisa")) for s in ("after", "before"))
        )
        still = still.join(known.where("_sides = 2").drop("_sides"), list(GAP_KEY))
    return still.join(a, "account_id")


def gap_state(gaps: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted gap (GAP_KEY): 'open', or 'gone' if it has been closed or never was."""
    still = gaps.where(~F.col("resolved")).select(*GAP_KEY, F.lit("open").alias("state"))
    return wanted.select(*GAP_KEY).join(still, list(GAP_KEY), "left").withColumn("state", F.coalesce("state", F.lit("gone")))


def fill_suggestions(gaps: DataFrame) -> DataFrame:
    """What entry would close an open gap: direction, amount, midpoint in time, balance."""
    seconds = F.timestamp_diff("SECOND", F.col("after_occurred_at"), F.col("before_occurred_at"))
    return gaps.select(
        *GAP_KEY,
        F.when(F.col("missing_paisa") < 0, "DEBIT").otherwise("CREDIT").alias("missing_direction"),
        F.abs("missing_paisa").alias("missing_amount"),
        (seconds >= 2).alias("has_room"),
        F.timestamp_add("SECOND", F.floor(seconds / 2), F.col("after_occurred_at")).alias("midpoint"),
        (F.col("after_balance_paisa") + F.col("missing_paisa")).alias("chained_balance"),
    )


def fill_remainder(gaps: DataFrame, entered: DataFrame) -> DataFrame:
    """What is still missing once an amount has been entered against a gap."""
    sums = entered.groupBy(*GAP_KEY).agg(F.sum(signed(F.col("amount_paisa"), F.col("direction"))).alias("entered_paisa"))
    return gaps.join(sums, list(GAP_KEY), "left").withColumn("remainder_paisa", F.col("missing_paisa") - F.coalesce("entered_paisa", F.lit(0)))
