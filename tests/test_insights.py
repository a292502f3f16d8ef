"""Series, budgets, balances, trends and splits on small tables, against plain Python."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pursebook.operators import balances, budgets, recurring, splits, trends, views
from pursebook.plans import insight_queries
from pursebook.sources import adapters

DATA = "/root/testdata/sf0.001"
TXN = "id long, user_id string, account_id long, occurred_at timestamp_ntz, direction string, amount_paisa long, currency string, merchant string, category_id int, excluded_from_spend boolean"


def txn(i, when, paisa, user="u", merchant="m", direction="DEBIT", currency="NPR", category=1, excluded=False, account=1):
    return (i, user, account, when, direction, paisa, currency, merchant, category, excluded)


def noon(year, month, day):
    return datetime(year, month, day, 6)


def series(spark, rows):
    return sorted((tuple(r) for r in recurring.recurring_series(spark.createDataFrame(rows, TXN)).collect()), key=repr)


def test_series_of_28_to_31_days(spark):
    monthly = [txn(k, noon(2024, m, 5), 1000 + m) for k, m in enumerate((1, 2, 3, 4))]
    assert series(spark, monthly) == [("u", "m", "NPR", date(2024, 1, 5), date(2024, 4, 5), 4, 1002)]
    assert series(spark, monthly[:2]) == []
    assert series(spark, [txn(k, noon(2024, 1, 1) + timedelta(27 * k), 100) for k in range(5)]) == []
    assert series(spark, [txn(k, noon(2024, 1, 1) + timedelta(32 * k), 100) for k in range(5)]) == []
    # An amount too different, a credit, a transfer, a missing merchant or time: not of the series.
    odd = [txn(1, noon(2024, 1, 5), 100), txn(2, noon(2024, 2, 5), 130), txn(3, noon(2024, 3, 5), 100), txn(4, noon(2024, 2, 5), 100, merchant=None), txn(5, noon(2024, 2, 4), 100, direction="CREDIT"), txn(6, noon(2024, 2, 3), 100, excluded=True), txn(7, None, 100)]
    assert series(spark, odd) == []


def test_payments_that_compete(spark):
    rows = [txn(1, noon(2024, 1, 1), 100), txn(2, noon(2024, 1, 3), 100), txn(3, noon(2024, 1, 31), 100), txn(4, noon(2024, 3, 1), 100), txn(5, noon(2024, 3, 31), 100)]
    # Both of January are followed by that of the 31st; the later one is of the series.
    assert series(spark, rows) == [("u", "m", "NPR", date(2024, 1, 3), date(2024, 3, 31), 4, 100)]
    same_day = [txn(k, noon(2024, m, 9) + timedelta(hours=h), 50) for k, (m, h) in enumerate(((1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)))]
    assert series(spark, same_day + same_day[:0]) == [("u", "m", "NPR", date(2024, 1, 9), date(2024, 3, 9), 3, 100)]


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(200):
        days = sorted(rng.sample(range(200), rng.randint(0, 60)))
        paisa = [rng.randint(80, 130) for _ in days]
        after = {}
        for i, d in enumerate(days):
            fits = [j for j in range(len(days)) if 28 <= days[j] - d <= 31 and 100 * abs(paisa[j] - paisa[i]) <= 25 * paisa[i]]
            if fits:
                after[i] = min(fits)
        before = {j: max(i for i in after if after[i] == j) for j in after.values()}
        want = []
        for i in range(len(days)):
            if i not in before:
                chain = [i]
                while (nxt := next((j for j, b in before.items() if b == chain[-1]), None)) is not None:
                    chain.append(nxt)
                want.append(chain)
        assert recurring.chains(days, paisa) == want


def test_a_hot_merchant_is_summed_by_day_before_it_is_brought_together(spark):
    rows = spark.range(200_000).select("id", F.lit("u").alias("user_id"), F.lit(1).alias("account_id"), F.timestamp_add("HOUR", F.col("id") % 2400, F.lit("2024-01-01").cast("timestamp_ntz")).alias("occurred_at"), F.lit("DEBIT").alias("direction"), F.lit(100).cast("long").alias("amount_paisa"), F.lit("NPR").alias("currency"), F.lit("m").alias("merchant"), F.lit(False).alias("excluded_from_spend"))
    found = recurring.recurring_series(rows)
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    last_exchange = [x for x in plan.split("Exchange hashpartitioning")[1:]]
    assert len(last_exchange) >= 2 and "partial_sum" in plan


BUDGET = "id long, user_id string, category_id int, currency string, month date, valid_from date, limit_paisa long"


def test_defaults_go_on_and_overrides_end(spark):
    spent = [txn(1, noon(2024, 2, 10), 500), txn(2, noon(2024, 4, 10), 700), txn(3, noon(2024, 3, 1), 50, category=None), txn(4, noon(2024, 3, 1), 9, direction="CREDIT", category=3)]
    rows = [
        (1, "u", 1, "NPR", None, date(2024, 1, 20), 600), (2, "u", 1, "NPR", None, date(2024, 4, 1), 900), (3, "u", 1, "NPR", None, date(2024, 4, 30), 800), (4, "u", 1, "NPR", date(2024, 3, 15), None, 50),
        (5, "u", 1, "NPR", None, date(2024, 6, 1), None), (6, "u", None, "NPR", None, None, 40), (7, "u", 2, "USD", date(2024, 5, 1), None, 10), (8, "w", 1, "NPR", None, None, 1),
    ]
    months = views.monthly_spend(spark.createDataFrame(spent, TXN))
    got = {(r.user_id, r.category_id, r.currency, r.month.month): (r.spent_paisa, r.limit_paisa, r.is_override, r.rest_paisa) for r in budgets.report(months, spark.createDataFrame(rows, BUDGET), date(2024, 6, 5)).collect()}
    own = {m: got.pop(("u", 1, "NPR", m)) for m in range(1, 7)}
    assert own == {1: (0, 600, False, 600), 2: (500, 600, False, 100), 3: (0, 50, True, 50), 4: (700, 800, False, 100), 5: (0, 800, False, 800), 6: (0, None, False, None)}
    assert got == {("u", None, "NPR", m): (50 if m == 3 else 0, 40, False, -10 if m == 3 else 40) for m in range(3, 7)} | {("u", 2, "USD", 5): (0, 10, True, 10), ("u", 2, "USD", 6): (0, None, False, None), ("w", 1, "NPR", 6): (0, 1, False, 1)}
    assert budgets.report(months.where("false"), spark.createDataFrame([], BUDGET), date(2024, 6, 5)).count() == 0


ROW = "id long, account_id long, occurred_at timestamp_ntz, direction string, amount_paisa long, balance_after_paisa long"


@pytest.mark.parametrize("piece", ["day", "month"])
def test_balances_equal_a_plain_walk(spark, piece):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), start + timedelta(minutes=30 * rng.randint(0, 3000)), rng.choice(["CREDIT", "DEBIT"]), rng.randint(1, 99), rng.choice([None, None, rng.randint(0, 9999)])) for i in range(400)]
    rows = [r if r[1] != 3 else (*r[:5], None) for r in rows] + [(900, None, start, "DEBIT", 5, 70)]
    asked = [(a, start + timedelta(minutes=30 * rng.randint(-50, 3100))) for a in (1, 1, 2, 3, None) for _ in range(40)] + [(9, start)]
    asked += asked[:3]

    def walk(account, instant):
        known = None
        for r in sorted((r for r in rows if r[1] == account and r[2] <= instant), key=lambda r: (r[2], r[0])):
            if r[5] is not None:
                known = [r[5], r[2], 0]
            elif known:
                known = [known[0] + (r[4] if r[3] == "CREDIT" else -r[4]), known[1], known[2] + 1]
        return tuple(known or (None, None, None))

    got = balances.at_instants(spark.createDataFrame(rows, ROW), spark.createDataFrame(asked, "account_id long, instant timestamp_ntz"), piece).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((a, t, *walk(a, t)) for a, t in asked), key=repr)


def test_month_ends_are_local(spark):
    rows = spark.createDataFrame([(1, 1, datetime(2024, 1, 31, 18, 30), "DEBIT", 5, 70), (2, 1, datetime(2024, 4, 1), "DEBIT", 5, 65)], ROW)
    # 18:30 UTC is February in Kathmandu.
    assert [r.instant for r in balances.month_ends(rows).orderBy("instant").collect()] == [datetime(2024, m, d, 18, 14, 59, 999999) for m, d in ((2, 29), (3, 31), (4, 30))]


def test_burn_is_aligned_by_day_of_month(spark):
    rows = [txn(1, noon(2023, 12, 30), 10), txn(2, noon(2024, 1, 28), 100), txn(3, noon(2024, 1, 31), 7), txn(4, noon(2024, 2, 29), 1), txn(5, noon(2024, 3, 2), 5), txn(6, noon(2024, 3, 31), 50), txn(7, noon(2024, 4, 9), 1)]
    got = {r.day: (r.spent_paisa, r.last_month_paisa, r.difference_paisa) for r in trends.cumulative_burn(spark.createDataFrame(rows, TXN), date(2024, 3, 31)).collect()}
    assert len(got) == 31 + 31 + 29 + 31 and got[date(2023, 12, 31)] == (10, None, None)
    assert got[date(2024, 1, 29)] == (100, 0, 100) and got[date(2024, 1, 30)] == (100, 10, 90) and got[date(2024, 1, 31)] == (107, 10, 97)
    assert got[date(2024, 2, 28)] == (0, 100, -100) and got[date(2024, 2, 29)] == (1, 100, -99)
    assert got[date(2024, 3, 28)] == (5, 0, 5) and got[date(2024, 3, 29)] == (5, 1, 4) and got[date(2024, 3, 30)] == (5, 1, 4) and got[date(2024, 3, 31)] == (55, 1, 54)


def test_categories_that_start_pause_and_end(spark):
    tree = spark.createDataFrame([(1, "Tea", 10, None), (2, "Bus", 11, None), (10, "Food", None, True), (11, "Way", None, False)], "id int, name string, parent_id int, is_spend boolean")
    rows = [txn(1, noon(2024, 1, 5), 300), txn(2, noon(2024, 3, 5), 100), txn(3, noon(2024, 3, 6), 100, category=99), txn(4, noon(2024, 4, 6), 40, category=2), txn(5, noon(2024, 5, 6), 5, category=2)]
    changes = trends.category_changes(views.monthly_spend(spark.createDataFrame(rows, TXN)), tree, date(2024, 5, 9))
    got = {(r.group_name, r.leaf_name, r.month.month): (r.spent_paisa, r.previous_paisa, r.change_paisa, r.share_bp) for r in changes.collect()}
    tea = {1: (300, 0, 300, 10000), 2: (0, 300, -300, None), 3: (100, 0, 100, 5000), 4: (0, 100, -100, None)}
    assert {m: got["Food", "Tea", m] for m in tea} == tea == {m: got["Food", None, m] for m in tea}
    assert got["Uncategorized", "Uncategorized", 3] == (100, 0, 100, 5000) and got["Uncategorized", None, 4] == (0, 100, -100, None)
    assert got["Way", "Bus", 4] == (40, 0, 40, None) and got["Way", "Bus", 5] == (5, 40, -35, None) and ("Way", "Bus", 6) not in got and len(got) == 2 * (4 + 2 + 2)


@pytest.fixture(scope="module")
def tables():
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


def test_changes_agree_with_the_breakdown(spark, tables):
    book, tree = adapters.book(spark, tables), adapters.categories(spark, tables)
    leaves = {(r.side, r.group_name, r.leaf_name): r.spent_paisa for r in views.category_rollup(views.monthly_spend(book), tree).collect()}
    rows = insight_queries.category_changes(spark, tables).groupBy("side", "group_name", "leaf_name").agg(F.sum("spent_paisa").alias("s")).collect()
    assert {(r.side, r.group_name, r.leaf_name): r.s for r in rows if r.leaf_name is not None} == leaves
    groups = defaultdict(int)
    for (side, group, _), s in leaves.items():
        groups[side, group] += s
    assert {(r.side, r.group_name): r.s for r in rows if r.leaf_name is None} == groups


def shared(amount, parts):
    """parts: (no, category, weight) -> {no: paisa} by largest remainder."""
    weights = [max(w or 0, 0) for *_, w in parts]
    weights = weights if sum(weights) else [1] * len(parts)
    base = [amount * w // sum(weights) for w in weights]
    order = sorted(range(len(parts)), key=lambda k: (-(amount * weights[k] % sum(weights)), parts[k][0], parts[k][1]))
    for k in order[: amount - sum(base)]:
        base[k] += 1
    return {(no, c): b for (no, c, _), b in zip(parts, base) if b}


def test_parts_add_up(spark):
    rng = random.Random(3)
    rows = [txn(i, noon(2024, 1, 5), rng.choice([1, 2, 99, 100, 10**15 + 7])) for i in range(80)]
    parts = {i: [(no, no % 3, rng.choice([None, -5, 0, 1, 1, 3, 10**9])) for no in range(rng.randint(1, 6))] for i in range(0, 80, 2)}
    table = spark.createDataFrame([(i, *p) for i, ps in parts.items() for p in ps] + [(777, 1, 1, 1)], "txn_id long, part_no int, category_id int, weight long")
    whole = spark.createDataFrame(rows, TXN)
    split = splits.with_splits(whole, table)
    assert split.columns == [*whole.columns, "part_no"]
    got = defaultdict(dict)
    for r in split.collect():
        got[r.id][r.part_no, r.category_id] = r.amount_paisa
    assert got == {r[0]: shared(r[5], parts[r[0]]) if r[0] in parts else {(None, 1): r[5]} for r in rows}
    assert splits.unbalanced(whole, split).count() == 0
    assert {(r.id, r.amount_paisa, r.parts_paisa) for r in splits.unbalanced(whole, split.where("id <> 1")).collect()} == {(1, rows[1][5], None)}
    assert splits.with_splits(whole, table.where("false")).count() == 80 and splits.with_splits(whole.where("false"), table).count() == 0


def test_views_see_the_parts(spark):
    whole = spark.createDataFrame([txn(1, noon(2024, 1, 5), 101)], TXN)
    parts = spark.createDataFrame([(1, 1, 7, 1), (1, 2, 8, 1)], "txn_id long, part_no int, category_id int, weight long")
    assert {(r.category_id, r.spent_paisa) for r in views.monthly_spend(splits.with_splits(whole, parts)).collect()} == {(7, 51), (8, 50)}
