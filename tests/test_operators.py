from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pursebook.operators import audit, categorize, filters, merge, reconcile, transfers, views

#: (occurred_at local, direction, amount, balance): fixed values of a real, sparse chain.
CHAIN = """2026-02-25T14:40 DEBIT 500 18543055|2026-03-15T15:19 DEBIT 1250000 17067555|2026-03-31T18:54 CREDIT 5250000 23617992|2026-04-10T15:31 DEBIT 500 24530992|2026-04-17T13:29 DEBIT 50000 24306249
2026-04-30T14:37 CREDIT 5250000 29756249|2026-05-03T10:55 DEBIT 1500000 28155749|2026-05-07T15:23 DEBIT 500 26655249|2026-05-15T07:53 DEBIT 100000 26204749|2026-05-18T19:09 DEBIT 250000 25954749
2026-05-22T16:38 DEBIT 500 25954249|2026-05-24T20:14 DEBIT 149900 25401349|2026-05-28T17:09 CREDIT 5250000 30751349|2026-05-29T08:41 DEBIT 1500000 29078349|2026-06-03T10:41 DEBIT 320000 28497549
2026-06-04T08:31 DEBIT 125000 28272049|2026-06-07T18:06 DEBIT 600000 27672049|2026-06-08T18:34 DEBIT 500 24770549|2026-06-14T13:13 DEBIT 500 24770049|2026-06-24T09:26 DEBIT 400000 24469549
2026-07-03T17:53 DEBIT 1800000 29715449|2026-07-23T19:07 DEBIT 25000 29019971|2026-08-02T15:03 DEBIT 8500000 20519971|2026-08-03T19:11 CREDIT 5480000 14697971|2026-08-10T17:33 DEBIT 800000 10297971"""
BALANCE = "id int, account_id string, occurred_at timestamp_ntz, direction string, amount_paisa long, balance_after_paisa long"


def chain(spark, rows):
    return spark.createDataFrame([(i, a, datetime.fromisoformat(t), d, int(m), b) for i, a, t, d, m, b in rows], BALANCE)


def test_golden_gaps(spark):
    rows = [x.split() for x in CHAIN.replace("\n", "|").split("|")]
    gaps = reconcile.find_gaps(chain(spark, [(i, "a", t, d, int(m), int(b)) for i, (t, d, m, b) in enumerate(rows, 1)])).orderBy("before_txn_id").collect()
    assert len(gaps) == 19
    assert (gaps[0].after_txn_id, gaps[0].before_txn_id, gaps[0].missing_paisa) == (1, 2, -225500)


def test_gaps_small_cases(spark):
    clean = [(1, "a", "2026-01-01", "CREDIT", 5, 105), (2, "a", "2026-01-02", "DEBIT", 5, 100)]
    assert reconcile.find_gaps(chain(spark, clean)).count() == 0
    assert reconcile.find_gaps(chain(spark, [*clean, (3, "b", "2026-01-01T12:00", "DEBIT", 9, None)])).count() == 0
    missing = reconcile.find_gaps(chain(spark, [*clean, (3, "a", "2026-01-03", "DEBIT", 1000, 100 - 5000)])).collect()
    assert [g.missing_paisa for g in missing] == [-4000]
    blank = reconcile.find_gaps(chain(spark, [clean[0], (3, "a", "2026-01-03", "DEBIT", 7, None), (4, "a", "2026-01-04", "DEBIT", 1, 97)])).collect()
    assert [g.missing_paisa for g in blank] == [-7]
    assert reconcile.find_gaps(chain(spark, [])).count() == 0


def test_gap_life_cycle_is_idempotent(spark):
    rows = [(1, "a", "2026-01-01", "CREDIT", 5, 105), (3, "a", "2026-01-03", "DEBIT", 1000, -4900)]
    found = reconcile.find_gaps(chain(spark, rows))
    empty = spark.createDataFrame([], "account_id string, after_txn_id int, before_txn_id int, missing_paisa long, resolved boolean, resolved_by string")
    first = reconcile.record_gaps(empty, found)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, reconcile.record_gaps(first, found).collect()))
    filled = chain(spark, [*rows, (2, "a", "2026-01-02", "DEBIT", 4005, -3900)])
    after = {(r.after_txn_id, r.before_txn_id): (r.resolved, r.resolved_by) for r in reconcile.record_gaps(first, reconcile.find_gaps(filled)).collect()}
    assert after[(1, 3)] == (True, "RECONCILER")
    assert after == {(1, 3): (True, "RECONCILER")}


LEGS = "id int, user_id string, account_id string, institution string, direction string, amount_paisa long, occurred_at timestamp_ntz, description_raw string, counterparty string"


def legs(spark, *rows):
    t = datetime(2026, 1, 1, 12)
    return spark.createDataFrame([(i, "u", a, n, d, 1000, t + timedelta(minutes=m), text, None) for i, a, n, d, m, text in rows], LEGS)


def score(spark, *rows):
    found = transfers.scored(transfers.candidate_pairs(legs(spark, *rows))).collect()
    return sorted((float(r.confidence), r.auto_link) for r in found)


def test_transfer_scores(spark):
    debit = (1, "a", "NABIL", "DEBIT", 0, "to esewa")
    assert score(spark, debit, (2, "b", "ESEWA", "CREDIT", 2, "x")) == [(1.0, True)]
    assert score(spark, (1, "a", "NABIL", "DEBIT", 0, "x"), (2, "b", "ESEWA", "CREDIT", 20, "x")) == [(0.5, False)]
    assert score(spark, debit, (2, "b", "ESEWA", "CREDIT", 30, "x")) == [(0.8, True)]
    assert score(spark, debit, (2, "b", "ESEWA", "CREDIT", 31, "x")) == []
    assert score(spark, debit, (2, "a", "NABIL", "CREDIT", 1, "x")) == []
    assert score(spark, debit, (2, "b", "ESEWA", "CREDIT", 2, "x"), (3, "b", "ESEWA", "CREDIT", 1, "x")) == [(0.7, False), (0.7, False)]


def test_linking_keeps_one_row_per_leg(spark):
    rows = legs(spark, (1, "a", "NABIL", "DEBIT", 0, "to esewa"), (2, "b", "ESEWA", "CREDIT", 2, "x"), (3, "b", "ESEWA", "CREDIT", 1, "x")).withColumns({"transfer_group_id": F.lit(None).cast("string"), "excluded_from_spend": F.lit(False)})
    out = transfers.link(rows, transfers.scored(transfers.candidate_pairs(rows))).collect()
    assert len(out) == 3 and not any(r.excluded_from_spend for r in out) and all(r.transfer_group_id for r in out)


ARRIVAL = "user_id string, dedupe_key string, arrival int, id int, amount_paisa long, description_raw string, balance_after_paisa long, reference string, counterparty string, channel string"


def arrivals(spark, *rows):
    return spark.createDataFrame(rows, ARRIVAL)


def test_cross_transport_merge(spark):
    sms = ("u", "k", 1, 1, 100, "OWCLG CHQ", None, None, None, "X")
    mail = ("u", "k", 2, 2, 100, "OWCLG CHQ 2280", 5000, "r", None, "Y")
    for first, second in ((sms, mail), ((*mail[:2], 1, *mail[3:]), (*sms[:2], 2, *sms[3:]))):
        out = merge.upsert(arrivals(spark, first), arrivals(spark, second)).collect()
        assert len(out) == 1 and out[0].balance_after_paisa == 5000 and out[0].description_raw == "OWCLG CHQ 2280" and out[0].channel == first[-1]


def test_upsert_is_idempotent(spark):
    rows = arrivals(spark, ("u", "k", 1, 1, 100, "a", None, None, None, None), ("u", "k", 2, 2, 100, "b", 7, None, None, None), ("u", "k", 3, 3, 100, "ab", None, "r", None, None), ("v", "k", 1, 4, 1, None, None, None, None, None))
    once = merge.upsert(arrivals(spark), rows)
    assert sorted(map(str, once.collect())) == sorted(map(str, merge.upsert(once, rows).collect()))
    assert {(r.user_id, r.description_raw, r.balance_after_paisa, r.reference) for r in once.collect()} == {("u", "ab", 7, "r"), ("v", None, None, None)}


def test_insert_ignore_and_last_writer(spark):
    old, new = arrivals(spark, ("u", "k", 1, 1, 1, "a", None, None, None, None)), arrivals(spark, ("u", "k", 2, 2, 1, "b", None, None, None, None), ("u", "m", 2, 3, 1, "c", None, None, None, None), ("u", "m", 1, 4, 1, "d", None, None, None, None))
    assert [r.id for r in merge.insert_ignore(old, new, ("user_id", "dedupe_key"), ("arrival", "id")).collect()] == [4]
    out = merge.last_writer(new, "dedupe_key", "arrival", ("user_id",)).orderBy("dedupe_key").collect()
    assert [(r.dedupe_key, r.id) for r in out] == [("k", 2), ("m", 3)]


def test_bag_difference(spark):
    line = spark.createDataFrame([("d", 5, 1), ("d", 5, 2), ("d", 5, 3), ("e", 1, 4)], "day string, amount int, n int")
    have = spark.createDataFrame([("d", 5), ("d", 5)], "day string, amount int")
    assert sorted(r.n for r in audit.missing_from(line, have, ("day", "amount"), ("n",)).collect()) == [3, 4]


def test_filter_counts_and_presets():
    f = filters.TransactionFilter(search=" x ", min_paisa=1, max_paisa=2, transfers="only", uncategorized_only=True)
    assert f.active_count == 4 and filters.TransactionFilter().active_count == 0
    now = datetime(2026, 1, 15)
    start, end = filters.preset_range("last3Months", now)
    assert (start + timedelta(minutes=345), end + timedelta(minutes=345)) == (datetime(2025, 11, 1), datetime(2026, 2, 1))
    assert filters.preset_range("lastMonth", now)[0] + timedelta(minutes=345) == datetime(2025, 12, 1)
    assert filters.preset_range("all", now) == (None, None)


def test_search_escapes_and_empty(spark):
    assert filters.search_predicate(" ,()%_ ") is None
    df = spark.createDataFrame([("a (b) 50%", None, None), (None, "A B", None)], "description_raw string, counterparty string, user_note string")
    assert df.where(filters.search_predicate("A (B")).count() == 0
    assert df.where(filters.search_predicate("a b")).count() == 1


def test_filter_pushes_down(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime(2026, 1, 1), 5)], "id int, occurred_at timestamp_ntz, amount_paisa long")
    rows.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = filters.TransactionFilter(start=datetime(2026, 1, 1), end=datetime(2026, 2, 1), min_paisa=3).apply(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(occurred_at" in plan and "LessThan(occurred_at" in plan and "GreaterThanOrEqual(amount_paisa" in plan


def test_exactly_one(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert filters.exactly_one(df, "id", 1).count() == 1
    for bad in (2, 3):
        with pytest.raises(LookupError):
            filters.exactly_one(df, "id", bad)


def test_quartiles_share_buckets(spark):
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate([0, 1, 1, 1, 2, 3, 4, 9])], "user_id string, day int, spent_paisa long")
    cuts = views.quartile_cuts(df).first()
    assert (cuts.q1, cuts.q2, cuts.q3) == (1, 2, 4)


def test_seed_taxonomy(spark):
    rows = categorize.seed_rows("u")
    assert sum(r[3] is None for r in rows) == 14 and sum(r[3] is not None for r in rows) == 51 and len(categorize.SEED_RULES) == 12
    seeded = categorize.seed_for_users(spark.createDataFrame([("a",), ("a",), ("b",)], "user_id string"))
    assert seeded.count() == 130 and seeded.where("parent_id is null").count() == 28
    again = categorize.reparent(seeded, seeded)
    assert again.exceptAll(seeded).count() == 0 and seeded.exceptAll(again).count() == 0


def test_rules_first_match_and_bad_pattern(spark):
    rules = spark.createDataFrame([(1, 50, "shop", 7), (2, 10, "SHOP A", 8)], "id int, priority int, pattern string, category_id int")
    df = spark.createDataFrame([("Shop A",), ("shop b",), ("x",), (None,)], "description_raw string")
    assert [r.c for r in df.select(categorize.rule_column(rules)["category_id"].alias("c")).collect()] == [8, 7, None, None]
    with pytest.raises(Exception):
        categorize.rule_column(spark.createDataFrame([(1, 1, "(", 1)], rules.schema))


def test_classifier_is_believed_from_threshold_and_spend_flag_stays(spark):
    rules = spark.createDataFrame([], "id int, priority int, pattern string, category_id int")
    df = spark.createDataFrame([(1, "a", None, 5, "DEBIT", "NEEDS_REVIEW", None, None, True), (2, "b", None, 5, "DEBIT", "NEEDS_REVIEW", None, None, False)], "id int, description_raw string, counterparty string, amount_paisa long, direction string, status string, category_id int, category_source string, excluded_from_spend boolean")
    answer = lambda label, amount, direction: F.struct(F.lit(9).alias("category_id"), F.when(label == "a", 0.85).otherwise(0.84).alias("confidence"))
    out = {r.id: (r.category_id, r.status, r.excluded_from_spend) for r in categorize.decide(df, rules, answer).collect()}
    assert out == {1: (9, "CATEGORIZED", True), 2: (None, "NEEDS_REVIEW", False)}


def test_balance_chain_sorts_months_not_accounts(spark):
    from pursebook.sources import adapters

    t = [datetime(2026, 1, 31, 23), datetime(2026, 2, 1), datetime(2026, 2, 1), datetime(2026, 4, 9), None, datetime(2025, 12, 2)]
    rows = [(i, a, t[i % 6], "CREDIT" if i % 3 else "DEBIT", i * 7 if i % 8 else None) for i in range(1, 90) for a in [i % 4 or None]]
    txns = spark.createDataFrame(rows, "id long, account_id long, occurred_at timestamp_ntz, direction string, amount_paisa long")
    want, sums = {}, {}
    for i, a, at, d, m in sorted(rows, key=lambda r: (r[2] is not None, r[2] or t[0], r[0])):
        if m is not None:
            sums[a] = sums.get(a, 0) + (m if d == "CREDIT" else -m)
        want[i] = sums[a] + adapters.OPENING_PAISA if i % 5 and a in sums else None
    out = adapters.balance_chain(txns)
    assert {r.id: r.balance_after_paisa for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_piece" in x.split("], [")[1] or "_total" in x for x in plan.splitlines() if "Window [" in x), plan
