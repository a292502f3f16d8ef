"""The merchants on which most was spent, by mergeable heavy-hitter summaries and an exact count.

A summary holds at most ``counters`` merchants of a group with a lower bound of their sums,
and an error: no merchant's sum exceeds its bound (0, if it is not held) by more.  Where a
summary has one merchant too many, the smallest bound is taken off all of them and added to
the error (Misra and Gries, with weights).  Summaries of parts add up to one of the whole,
bounds with bounds and errors with errors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.functions.clock import local_month

TOP = 20
COUNTERS = 256
#: Bounds that a task holds before it hands its summaries on and begins new ones.
HELD = 1 << 20


class Summary:
    """Bounds of the heaviest items of one group."""

    __slots__ = ("low", "error", "size")

    def __init__(self, size: int):
        self.low: dict = {}
        self.error, self.size = 0, size

    def add(self, item, weight: int) -> None:
        self.low[item] = self.low.get(item, 0) + weight
        if len(self.low) > 2 * self.size:
            self.prune()

    def prune(self) -> None:
        if len(self.low) > self.size:
            off = sorted(self.low.values(), reverse=True)[self.size]
            self.low = {i: w - off for i, w in self.low.items() if w > off}
            self.error += off


def summaries(rows: DataFrame, by: list[str], item: str, weight: str, counters: int = COUNTERS) -> DataFrame:
    """(.., item, _low, _error): of each task's summaries the bounds, and their error with a
    null item.  Nothing is shuffled."""
    groups = rows.select(*by, item, weight)
    names = [*by, item]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Summary] = {}
        held = 0

        def rest() -> pa.RecordBatch:
            out = []
            for key, s in found.items():
                s.prune()
                out += [(*key, i, w, 0) for i, w in s.low.items()]
                if s.error:
                    out.append((*key, None, 0, s.error))
            columns = list(zip(*out)) or [[]] * (len(names) + 2)
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(columns, names)] + [pa.array(c, pa.int64()) for c in columns[-2:]], names=[*names, "_low", "_error"])

        schema = None
        for batch in batches:
            schema = batch.schema
            sums = pa.Table.from_batches([batch]).group_by(names).aggregate([(weight, "sum")])
            for *key, i, w in zip(*(sums[c].to_pylist() for c in (*names, f"{weight}_sum"))):
                s = found.get(tuple(key)) or found.setdefault(tuple(key), Summary(counters))
                held -= len(s.low)
                s.add(i, w)
                held += len(s.low)
            if held > HELD:
                yield rest()
                found, held = {}, 0
        if schema is not None:
            yield rest()

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema if f.name in names)
    return groups.mapInArrow(summarise, shape + ", _low long, _error long")


def heaviest(rows: DataFrame, by: list[str], item: str, weight: str, top: int = TOP, counters: int = COUNTERS) -> DataFrame:
    """(.., item, total, n, rank): the ``top`` items of each group by their sum, exactly, and all that
    tie with the last of them.  Items and weights must be there, weights above 0.

    Rows are summarised where they are read.  An item whose bound and error together do not
    reach the ``top``-th highest bound of its group is out; the sums of the others are then counted in
    a second pass over the rows, which sends those items' rows alone.  Where the error reaches
    that bound, an item that no summary holds might belong to the group's best: such a group is
    counted whole."""
    own = summaries(rows, by, item, weight, counters).groupBy(*by, item).agg(F.sum("_low").alias("_low"), F.sum("_error").alias("_error"))
    # A group's error and the bound of its top-th item: no more than top rows of each task go on.
    error = own.where(F.col(item).isNull()).select(F.struct(*by).alias("_g"), "_error")
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_low"), item))
    best = own.where(F.col(item).isNotNull()).withColumn("_place", place).where(F.col("_place") <= top)
    bound = best.groupBy(F.struct(*by).alias("_g")).agg(F.when(F.count("*") == top, F.min("_low")).otherwise(0).alias("_bound"))
    limits = bound.join(error, "_g", "left").select("_g", "_bound", F.coalesce("_error", F.lit(0)).alias("_error")).withColumn("_whole", F.col("_error") >= F.col("_bound"))
    limits = limits.withColumn("_whole", F.col("_whole") & (F.col("_error") > 0))
    held = own.where(F.col(item).isNotNull()).select(F.struct(*by).alias("_g"), F.col(item).alias("_i"), "_low").join(limits, "_g")
    wanted = held.where(~F.col("_whole") & (F.col("_low") + F.col("_error") >= F.col("_bound"))).select("_g", "_i")
    whole = limits.where("_whole").select("_g")
    facts = rows.select(F.struct(*by).alias("_g"), F.col(item).alias("_i"), F.col(weight).cast("long").alias("_w"))
    counted = facts.join(wanted, ["_g", "_i"], "left_semi").unionByName(facts.join(whole, "_g", "left_semi"))
    totals = counted.groupBy("_g", "_i").agg(F.sum("_w").alias("total"), F.count("*").alias("n"))
    ranked = totals.withColumn("rank", F.rank().over(W.partitionBy("_g").orderBy(F.desc("total")))).where(F.col("rank") <= top)
    return ranked.select("_g.*", F.col("_i").alias(item), "total", "n", "rank")


def top_merchants(txns: DataFrame, top: int = TOP, counters: int = COUNTERS) -> DataFrame:
    """(user_id, currency, month, merchant, spent_paisa, txn_count, rank) of each local month;
    credits, transfers and payments without a merchant do not count."""
    paid = txns.where((F.col("direction") == "DEBIT") & ~F.col("excluded_from_spend") & F.col("merchant").isNotNull() & F.col("occurred_at").isNotNull() & (F.col("amount_paisa") > 0))
    rows = paid.select("user_id", "currency", local_month(F.col("occurred_at")).cast("date").alias("month"), "merchant", "amount_paisa")
    found = heaviest(rows, ["user_id", "currency", "month"], "merchant", "amount_paisa", top, counters)
    return found.withColumnsRenamed({"total": "spent_paisa", "n": "txn_count"})
