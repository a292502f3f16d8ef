"""Money: integers of the smallest unit; decimals only while parsing (FN1-FN3, FN22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_subunit(text: Column, decimals: int = 2) -> Column:
    """'10,000.00' -> 1000000, half-even below the smallest unit; null if not a number."""
    number = F.trim(F.regexp_replace(text, ",", "")).try_cast("decimal(30,10)")
    return F.bround(number * F.lit(10**decimals).cast("decimal(10,0)"), 0).cast("long")


def parse_paisa(text: Column) -> Column:
    """What a person types: optional currency, commas, at most two decimals; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), ",", ""), r"^(?:Rs\.?|NPR)\s*", "")
    return F.when(bare.rlike(r"^\d+(\.\d{1,2})?$"), (bare.try_cast("decimal(20,2)") * 100).cast("long"))


def format_paisa(paisa: Column, currency: Column) -> Column:
    mark = F.when(currency == "NPR", F.lit("Rs.")).otherwise(currency)
    return F.concat_ws(" ", mark, F.format_number((paisa.cast("decimal(20,0)") / 100).cast("decimal(20,2)"), 2))


def editable(paisa: Column) -> Column:
    """Plain decimal text of an amount, two places."""
    return (paisa.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def signed(amount: Column, direction: Column) -> Column:
    return F.when(direction == "CREDIT", amount).otherwise(-amount)
