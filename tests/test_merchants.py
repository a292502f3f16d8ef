import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pursebook.operators import merchants


@pytest.mark.parametrize("seed", range(3))
def test_a_summary_keeps_its_bounds(seed):
    rng = random.Random(seed)
    size, true, parts = 10, Counter(), []
    for _ in range(4):
        s = merchants.Summary(size)
        for _ in range(2000):
            item, weight = int(rng.paretovariate(0.7)) % 500, rng.randint(1, 50)
            true[item] += weight
            s.add(item, weight)
        s.prune()
        parts.append(s)
        assert len(s.low) <= size
    low, error = Counter(), sum(s.error for s in parts)
    for s in parts:
        low.update(s.low)
    assert all(low[i] <= n <= low[i] + error for i, n in true.items()) and error * (size + 1) <= sum(true.values())


def brute(rows, top):
    groups = defaultdict(lambda: defaultdict(list))
    for g, i, w in rows:
        groups[g][i].append(w)
    out = []
    for g, items in groups.items():
        sums = {i: sum(w) for i, w in items.items()}
        out += [(g, i, s, len(items[i]), r) for i, s in sums.items() if (r := 1 + sum(x > s for x in sums.values())) <= top]
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [1, 3, 8, 1000])
def test_exact_whatever_the_summaries_hold(spark, counters):
    rng = random.Random(counters)
    # A group with heavy merchants, one that is flat (no summary can tell), one that is small, one without a name.
    rows = [("skew", f"m{int(rng.paretovariate(0.9)) % 60}", rng.randint(1, 9)) for _ in range(1500)] + [("flat", f"m{k % 70}", 5) for k in range(700)] + [("few", "a", 2), ("few", "b", 2), ("few", "c", 1)] + [(None, "x", 3)]
    df = spark.createDataFrame(rows, "user string, merchant string, paisa long").repartition(4, F.rand(1))
    got = merchants.heaviest(df, ["user"], "merchant", "paisa", 4, counters).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4)


def test_summaries_that_are_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(merchants, "HELD", 5)
    rows = [(k % 3, f"m{k % 11}", 1 + k % 5) for k in range(400)]
    df = spark.createDataFrame(rows, "user long, merchant string, paisa long").repartition(2)
    assert sorted(map(tuple, merchants.heaviest(df, ["user"], "merchant", "paisa", 2, 3).collect()), key=repr) == brute(rows, 2)


def test_what_counts(spark):
    at = datetime(2024, 1, 31, 18, 20)  # February in Kathmandu
    rows = [(at, "DEBIT", 5, "m", False), (at, "CREDIT", 7, "m", False), (at, "DEBIT", 7, "m", True), (at, "DEBIT", 7, None, False), (None, "DEBIT", 7, "m", False), (at, "DEBIT", None, "m", False)]
    df = spark.createDataFrame([("u", "NPR", *r) for r in rows], "user_id string, currency string, occurred_at timestamp_ntz, direction string, amount_paisa long, merchant string, excluded_from_spend boolean")
    r = merchants.top_merchants(df).collect()
    assert len(r) == 1 and (r[0].month.month, r[0].spent_paisa, r[0].txn_count, r[0].rank) == (2, 5, 1, 1)
    assert merchants.top_merchants(df.where("false")).count() == 0


def test_only_candidates_are_sent_by_merchant(spark):
    rows = spark.range(200_000).select(F.lit("u").alias("user"), F.when(F.col("id") % 2 == 0, F.col("id") % 20).otherwise(F.col("id")).cast("string").alias("merchant"), F.lit(1).cast("long").alias("paisa"))
    own = merchants.summaries(rows, ["user"], "merchant", "paisa", 64)
    assert own.count() <= 65 * rows.rdd.getNumPartitions() and merchants.heaviest(rows, ["user"], "merchant", "paisa", 5, 64).count() == 10
