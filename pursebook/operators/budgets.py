"""Budgets: a recurring default that changes over time, and overrides of single months.

A budget row is (user_id, category_id, currency, month, valid_from, limit_paisa, id).  With a
``month`` it holds in that month alone.  Without one it is the default from the month
``valid_from`` on (from the beginning, if that is null) until the next default; a default
without a limit ends the one before it.  Of rows for the same month the greatest id counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("user_id", "category_id", "currency")
BEGINNING = "0001-01-01"


def report(months: DataFrame, budgets: DataFrame, until: date) -> DataFrame:
    """(user_id, category_id, currency, month, spent_paisa, limit_paisa, is_override,
    rest_paisa) for every month from a key's first spend or budget to that of ``until``.

    The budget in force is an as-of lookup without a range join: changes and months are
    one table, one row for each key and month, and the last change is carried down it.  Null
    categories are a key like others.  Spend without a budget has a null limit and rest."""
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    last = F.trunc(F.lit(until), "month")
    none = F.lit(None)
    latest = F.max_by(F.struct("limit_paisa"), F.struct("id"))
    overrides = budgets.where("month is not null").groupBy(*KEY, month("month").alias("month")).agg(latest.alias("_override"))
    defaults = budgets.where("month is null").groupBy(*KEY, F.coalesce(month("valid_from"), F.lit(BEGINNING).cast("date")).alias("month")).agg(latest.alias("_default"))
    spent = months.where("spent_paisa is not null").groupBy(*KEY, month("month").alias("month")).agg(F.sum("spent_paisa").alias("_spent"))
    shape = {"_spent": "bigint", "_override": "struct<limit_paisa: bigint>", "_default": "struct<limit_paisa: bigint>"}
    same = lambda df: df.select(*KEY, "month", *((F.col(c) if c in df.columns else none).cast(t).alias(c) for c, t in shape.items()))
    facts = same(spent).unionByName(same(overrides)).unionByName(same(defaults))
    begun = facts.groupBy(*KEY).agg(F.coalesce(F.min(F.when(F.col("month") > F.lit(BEGINNING).cast("date"), F.col("month"))), last).alias("_first"))
    shown = F.when(F.col("_first") <= last, F.sequence(F.col("_first"), last, F.expr("INTERVAL '1' MONTH")))
    every = same(begun.select(*KEY, F.explode(shown).alias("month"))).withColumn("_shown", F.lit(True))
    rows = facts.withColumn("_shown", none.cast("boolean")).unionByName(every)
    # A key has a row for each month at most, so a window over a key is small.
    merged = rows.groupBy(*KEY, "month").agg(*(F.max(c).alias(c) for c in (*shape, "_shown")))
    force = F.last("_default", ignorenulls=True).over(W.partitionBy(*KEY).orderBy("month").rowsBetween(W.unboundedPreceding, 0))
    asof = merged.withColumn("_force", force).where("_shown")
    limit = F.when(F.col("_override").isNotNull(), F.col("_override.limit_paisa")).otherwise(F.col("_force.limit_paisa"))
    spent_paisa = F.coalesce("_spent", F.lit(0))
    return asof.select(*KEY, "month", spent_paisa.alias("spent_paisa"), limit.alias("limit_paisa"), F.col("_override").isNotNull().alias("is_override"), (limit - spent_paisa).alias("rest_paisa"))
