"""Recurring payments: series of payments to one merchant, 28 to 31 days apart.

A merchant's payments of one local day are one occurrence, with their sum.  The occurrence that follows
another is the first one 28 to 31 days later whose amount is within ``tolerance`` percent
of it; where several would be followed by the same one, the latest of them is.  So every
occurrence has at most one before it and one after it, and what hangs together is a series."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pursebook.functions.clock import local_day

APART = (28, 31)
LEAST = 3
TOLERANCE = 25
SERIES = "array<struct<first_day: date, last_day: date, n: bigint, median_paisa: bigint>>"
_SERIES = pa.list_(pa.struct([("first_day", pa.date32()), ("last_day", pa.date32()), ("n", pa.int64()), ("median_paisa", pa.int64())]))


def chains(days: list[int], amounts: list[int], apart: tuple[int, int] = APART, tolerance: int = TOLERANCE) -> list[list[int]]:
    """Places of the occurrences of every chain; days rise."""
    before: dict[int, int] = {}
    low = 0
    for i, day in enumerate(days):
        low = max(low, i + 1)
        while low < len(days) and days[low] < day + apart[0]:
            low += 1
        for j in range(low, len(days)):
            if days[j] > day + apart[1]:
                break
            if 100 * abs(amounts[j] - amounts[i]) <= tolerance * amounts[i]:
                before[j] = i  # a later one replaces an earlier one
                break
    after = {i: j for j, i in before.items()}
    found = []
    for i in range(len(days)):
        if i not in before:
            chain = [i]
            while chain[-1] in after:
                chain.append(after[chain[-1]])
            found.append(chain)
    return found


def recurring_series(txns: DataFrame, by: tuple[str, ...] = ("user_id", "merchant", "currency"), least: int = LEAST, apart: tuple[int, int] = APART, tolerance: int = TOLERANCE) -> DataFrame:
    """(.., first_day, last_day, n, median_paisa) of every series of at least ``least`` occurrences.

    Payments are summed by day before anything else, with map-side combine, so that even a
    merchant with a third of all rows is a row for each day of the history; only those are
    brought together.  Payments without a merchant, a time or an amount, and transfers, are in
    no series; the median of an even number of amounts is the lower one."""
    known = F.lit(True)
    for c in (*(b for b in by if b != "user_id"), "occurred_at", "amount_paisa"):
        known = known & F.col(c).isNotNull()
    paid = txns.where((F.col("direction") == "DEBIT") & ~F.col("excluded_from_spend") & known)
    daily = paid.groupBy(*by, local_day(F.col("occurred_at")).alias("_day")).agg(F.sum("amount_paisa").alias("_paisa"))
    of_key = daily.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.unix_date("_day").alias("day"), F.col("_paisa").alias("paisa")))).alias("_days"))

    def series(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            days, paisa = [r["day"] for r in row], [r["paisa"] for r in row]
            long = [c for c in chains(days, paisa, apart, tolerance) if len(c) >= least]
            out.append([{"first_day": days[c[0]], "last_day": days[c[-1]], "n": len(c), "median_paisa": sorted(paisa[i] for i in c)[(len(c) - 1) // 2]} for c in long])
        return pa.array(out, pa.list_(pa.struct([("first_day", pa.int32()), ("last_day", pa.int32()), ("n", pa.int64()), ("median_paisa", pa.int64())]))).cast(_SERIES)

    return of_key.where(F.size("_days") >= least).select(*by, F.explode(arrow_udf(series, SERIES)("_days")).alias("_s")).select(*by, "_s.*")
