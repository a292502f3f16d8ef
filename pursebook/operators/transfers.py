"""Transfers between a person's own accounts (JN1, AG10, FN19, SNK10, FLT8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.functions.keys import row_id
from pursebook.functions.remarks import mentions

WINDOW_S, TIGHT_S = 1800, 300
AUTO_LINK = 0.8


#: How far back a run looks for the other side of a transfer.
LOOK_BACK_DAYS = 60


def in_look_back(now: Column, days: int = LOOK_BACK_DAYS) -> Column:
    return F.col("occurred_at") >= now - F.make_interval(days=F.lit(days))


def within_look_back(txns: DataFrame, now: Column, days: int = LOOK_BACK_DAYS) -> DataFrame:
    return txns.where(in_look_back(now, days))


def candidate_pairs(legs: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Debit and credit of one user, equal amount, different accounts, close in time.

    The join key holds a time bucket as wide as the window, and credits are put into
    three neighbouring buckets, so one frequent amount does not meet itself over all
    time; the exact window is a residual."""
    bucket = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("occurred_at")) / window_s)
    cols = ("id", "account_id", "institution", "occurred_at", "description_raw", "counterparty")
    side = lambda d, p: legs.where(F.col("direction") == d).select("user_id", "amount_paisa", bucket.alias("b"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    credits = side("CREDIT", "c").withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    apart = F.abs(F.timestamp_diff("SECOND", F.col("d_occurred_at"), F.col("c_occurred_at")))
    exact = F.abs(F.timestamp_diff("MICROSECOND", F.col("d_occurred_at"), F.col("c_occurred_at")))
    pairs = side("DEBIT", "d").join(credits, ["user_id", "amount_paisa", "b"]).where((F.col("d_account_id") != F.col("c_account_id")) & (exact <= window_s * 1_000_000))
    return pairs.withColumns({"apart_s": apart, "apart_us": exact}).drop("b")


def scored(pairs: DataFrame) -> DataFrame:
    """0.5, +0.3 if a side names the other's institution, +0.2 if tight, -0.3 if ambiguous."""
    n = lambda leg: F.count("*").over(W.partitionBy(leg))
    named = mentions(F.col("c_institution"), F.col("d_description_raw"), F.col("d_counterparty")) | mentions(F.col("d_institution"), F.col("c_description_raw"), F.col("c_counterparty"))
    tenth = lambda x: F.lit(x).cast("decimal(4,3)")
    points = lambda when, x: F.when(when, tenth(x)).otherwise(tenth("0"))
    marked = pairs.withColumns({"ambiguous": (n("d_id") > 1) | (n("c_id") > 1), "mentioned": named})
    score = tenth("0.5") + points(F.col("mentioned"), "0.3") + points(F.col("apart_us") <= TIGHT_S * 1_000_000, "0.2") - points(F.col("ambiguous"), "0.3")
    return marked.withColumn("confidence", score.cast("decimal(4,3)")).withColumn("auto_link", F.col("confidence") >= tenth(str(AUTO_LINK)))


def linked_legs(matches: DataFrame) -> DataFrame:
    """(id, transfer_group_id, excluded_from_spend): each leg's best match, one row a leg."""
    group = row_id(F.lit("transfer"), F.col("d_id"), F.col("c_id"))
    legs = matches.select(F.explode(F.array("d_id", "c_id")).alias("id"), "confidence", "d_id", "c_id", "auto_link", group.alias("g"))
    best = F.struct(-F.col("confidence"), "d_id", "c_id")
    return legs.groupBy("id").agg(F.min_by("g", best).alias("transfer_group_id"), F.bool_or("auto_link").alias("excluded_from_spend"))


def link(txns: DataFrame, matches: DataFrame) -> DataFrame:
    """Transactions with what linking changes; a leg's flag is only ever raised."""
    new = linked_legs(matches).select("id", F.col("transfer_group_id").alias("g"), F.col("excluded_from_spend").alias("x"))
    return txns.join(new, "id", "left").withColumns({
        "transfer_group_id": F.coalesce(F.col("transfer_group_id").cast("string"), "g"),
        "excluded_from_spend": F.col("excluded_from_spend") | F.coalesce("x", F.lit(False)),
    }).drop("g", "x")
