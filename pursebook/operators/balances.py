"""Balance of an account at any instant.

The last known balance at or before the instant, rolled forward by the movements since then
whose rows have no balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.functions.clock import local_month, utc_of
from pursebook.functions.money import signed


def at_instants(rows: DataFrame, instants: DataFrame, piece: str = "day") -> DataFrame:
    """(account_id, instant, balance_paisa, known_at, rolled) for each row of ``instants``
    (account_id, instant).

    Balance null: none is known so early.  ``known_at`` is when the balance was stated, and
    ``rolled`` counts the movements since then.  Of rows at one time the greatest id is the last.

    An account is never sorted as a whole: rows and instants meet in pieces of a day; what a
    piece hands on (its last balance, and what has moved since) is one row, and only those
    are carried along the account.  Repeated instants give repeated rows."""
    at = lambda c: F.date_trunc(piece, c).cast("timestamp_ntz")
    moved = F.when(F.col("balance_after_paisa").isNull(), signed(F.col("amount_paisa"), F.col("direction")))
    none = F.lit(None)
    movements = rows.where("occurred_at is not null").select("account_id", F.col("occurred_at").alias("_at"), F.lit(0).alias("_kind"), "id", F.col("balance_after_paisa").alias("_balance"), moved.alias("_moved"), none.cast("timestamp_ntz").alias("instant"))
    asked = instants.select("account_id", F.col("instant").cast("timestamp_ntz").alias("_at"), F.lit(1).alias("_kind"), none.cast(rows.schema["id"].dataType).alias("id"), none.cast("bigint").alias("_balance"), none.cast("bigint").alias("_moved"), F.col("instant").cast("timestamp_ntz").alias("instant"))
    both = movements.unionByName(asked).withColumn("_piece", at("_at"))
    here, so_far = W.partitionBy("account_id", "_piece").orderBy("_at", "_kind", "id"), (W.unboundedPreceding, 0)
    stated = F.when(F.col("_balance").isNotNull(), F.struct(F.col("_balance").alias("balance"), F.col("_at").alias("at")))
    both = both.withColumns({"_anchor": F.last(stated, ignorenulls=True).over(here.rowsBetween(*so_far)), "_n": F.count("_balance").over(here.rowsBetween(*so_far))})
    since = W.partitionBy("account_id", "_piece", "_n").orderBy("_at", "_kind", "id").rowsBetween(*so_far)
    both = both.withColumns({"_since": F.coalesce(F.sum("_moved").over(since), F.lit(0)), "_rolled": F.count("_moved").over(since)})
    # What each piece hands on, and then what all pieces before a piece hand on to it.
    ends = both.groupBy("account_id", "_piece").agg(F.max_by(F.struct("_anchor", "_since", "_rolled"), F.struct("_at", "_kind", "id")).alias("_end"))
    chain = W.partitionBy("account_id").orderBy("_piece")
    before = chain.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumns({"_carried": F.last("_end._anchor", ignorenulls=True).over(before), "_m": F.count("_end._anchor").over(chain.rowsBetween(*so_far))})
    run = W.partitionBy("account_id", "_m").orderBy("_piece").rowsBetween(*so_far)
    ends = ends.withColumns({"_run": F.sum("_end._since").over(run), "_run_n": F.sum("_end._rolled").over(run)})
    carried = ends.select("account_id", "_piece", "_carried", F.coalesce(F.lag("_run").over(chain), F.lit(0)).alias("_run"), F.coalesce(F.lag("_run_n").over(chain), F.lit(0)).alias("_run_n"))
    wanted = both.where("_kind = 1").join(carried.withColumnsRenamed({"account_id": "_a", "_piece": "_p"}), F.col("account_id").eqNullSafe(F.col("_a")) & F.col("_piece").eqNullSafe(F.col("_p")))
    own = F.col("_anchor").isNotNull()
    anchor = F.coalesce("_anchor", "_carried")
    since_then = F.when(own, F.col("_since")).otherwise(F.col("_run") + F.col("_since"))
    n = F.when(own, F.col("_rolled")).otherwise(F.col("_run_n") + F.col("_rolled"))
    return wanted.select("account_id", "instant", (anchor["balance"] + since_then).alias("balance_paisa"), anchor["at"].alias("known_at"), F.when(anchor.isNotNull(), n).alias("rolled"))


def month_ends(rows: DataFrame) -> DataFrame:
    """(account_id, instant): the last microsecond of every local month from an account's first
    movement to its last, as UTC."""
    span = rows.where("occurred_at is not null").groupBy("account_id").agg(F.min("occurred_at").alias("_a"), F.max("occurred_at").alias("_b"))
    months = F.sequence(local_month(F.col("_a")).cast("date"), local_month(F.col("_b")).cast("date"), F.expr("INTERVAL '1' MONTH"))
    after = F.add_months(F.col("_month"), 1).cast("timestamp_ntz")
    return span.select("account_id", F.explode(months).alias("_month")).select("account_id", (utc_of(after) - F.expr("INTERVAL '1' MICROSECOND")).alias("instant"))
