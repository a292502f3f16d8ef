"""How often the gap queries read and send the ledger, and that one pass finds what a plain walk finds."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pursebook.operators import reconcile
from pursebook.plans.catalog import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda name: queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString(), lambda name: queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name,exchanges,scans", [("open_gap_detection", 7, 2), ("gap_resolution", 14, 4), ("open_gaps_view", 9, 3), ("merged_transactions", 14, 4), ("heatmap_days", 24, 8)])
def test_exchanges_and_scans(plan, name, exchanges, scans):
    """With broadcasts and adaptive execution switched off, as if every table were large."""
    executed = plan[1](name)
    assert executed.count("Exchange hashpartitioning") <= exchanges and executed.count("FileScan parquet") <= scans, (executed.count("Exchange hashpartitioning"), executed.count("FileScan parquet"))


ROW = "id long, account_id long, occurred_at timestamp_ntz, direction string, amount_paisa long, balance_after_paisa long"


def ledger(seed, n=300):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 1, 2, 3]), datetime(2024, 1, 1) + timedelta(hours=12 * rng.randint(0, 300)), rng.choice(["CREDIT", "DEBIT"]), rng.randint(1, 3), rng.choice([None, 100, 101, 102])) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("bucket", ["day", "month"])
def test_gaps_equal_a_plain_walk(spark, seed, bucket):
    rows, want = ledger(seed), []
    for account in (1, 2, 3):
        own = sorted((r for r in rows if r[1] == account and r[5] is not None), key=lambda r: (r[2], r[0]))
        for a, b in zip(own, own[1:]):
            missing = b[5] - a[5] - (b[4] if b[3] == "CREDIT" else -b[4])
            if missing:
                want.append((account, a[0], b[0], missing, a[2], b[2], a[5], b[5]))
    got = reconcile.gaps_with_ends(spark.createDataFrame(rows, ROW), bucket).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stored_gaps_find_their_ends(spark):
    rows = spark.createDataFrame(ledger(5), ROW)
    accounts = spark.createDataFrame([(1, "one"), (2, "two")], "id long, display_name string")
    found = reconcile.gaps_with_ends(rows).withColumn("resolved", F.col("after_txn_id") % 4 == 0)
    stored = found.drop(*reconcile.ENDS).unionByName(spark.createDataFrame([(1, 1, 99_999, 5, False)], found.drop(*reconcile.ENDS).schema))
    same = lambda df: sorted(repr(sorted(r.asDict().items())) for r in df.collect())
    assert same(reconcile.open_gaps(stored, accounts, rows)) == same(reconcile.open_gaps(found, accounts, rows)) != []
