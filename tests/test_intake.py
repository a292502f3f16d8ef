"""Statement branches of the run, reparsing, the whole merge, and what a run cannot use."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pursebook.operators import categorize, edits, merge, transfers
from pursebook.plans import sync

SMS = "content_hash string, sender string, body string"
TEXT = "Dear Customer, Your 001##34567 has been withdrawn by NPR 5.00 on 15/09/2026 18:16:13, Remarks: tea"
HEAD = ["S.N", "Txn Date", "Particulars", "Withdraw", "Deposit", "Balance"]


def test_statements_are_parsed_and_those_without_cells_stay_pending(spark):
    inbox = spark.createDataFrame([("s", "NABIL_ALERT", TEXT), ("f", "NABIL_STATEMENT", "x"), ("w", "ESEWA_STATEMENT", "y"), ("p", "PROMO", "z")], SMS)
    grid = spark.createDataFrame([("f", "NABIL", "00112345678901", 0, i, r) for i, r in enumerate([HEAD, ["1", "02/01/2026", "ATM", "5.00", "-", "5.00"]])], "file_id string, institution string, account_mask string, page int, row_no int, cells array<string>")
    rows, outcomes = sync.parse_messages(inbox, statements=grid)
    assert sorted(r.template_key for r in rows.collect()) == ["bank.statement_row", "nabil.sms_alert"]
    assert {r.content_hash: r.status for r in outcomes.collect()} == {"s": "PARSED", "f": "PARSED", "p": "IGNORED"}
    one, done = sync.reparse(inbox, "nabil.sms_alert")
    assert [r.message_id for r in one.collect()] == ["s"] and [r.content_hash for r in done.collect()] == ["s"]


def test_unusable_rows_and_drafts_come_back_with_a_reason(spark):
    rows, _ = sync.parse_messages(spark.createDataFrame([("s", "NABIL_ALERT", TEXT)], SMS))
    bad = rows.withColumn("amount_paisa", F.lit(0).cast("bigint")).unionByName(rows.withColumn("occurred_at", F.lit(None).cast("timestamp_ntz")))
    rules = spark.createDataFrame([], "id int, priority int, pattern string, category_id string")
    out = sync.sync(sync.Ledger(spark.createDataFrame([], sync.TXN_DDL), spark.createDataFrame([], sync.ACCOUNT_DDL), spark.createDataFrame([], sync.GAP_DDL), rules), rows.unionByName(bad), "u", "2026-09-20")
    assert out.transactions.count() == 1 and sorted(r.reason for r in out.rejected.collect()) == ["no positive amount could be read", "no time could be read"]


def test_more_rules_than_one_expression_holds(spark):
    rules = spark.createDataFrame([(i, i, f"word{i}x", i) for i in range(2500)] + [(9000, 9000, "word", 1)], "id int, priority int, pattern string, category_id int")
    rows = spark.createDataFrame([("word7x",), ("WORD2499x",), ("word",), ("none",), (None,)], "description_raw string").select(categorize.rule_column(rules)["rule_id"].alias("r")).collect()
    assert [r.r for r in rows] == [7, 2499, 9000, None, None]


def test_patterns_are_checked_by_the_engine_that_runs_them(spark):
    rules = lambda p: spark.createDataFrame([(1, 1, p, 1)], "id int, priority int, pattern string, category_id int")
    with pytest.raises(ValueError):
        categorize.rule_list(rules("(?P<x>a)"))
    assert categorize.rule_list(rules(r"\p{L}++(?<x>a)")) == [(1, r"\p{L}++(?<x>a)", 1)]


def test_the_merge_keeps_fills_repoints_and_drops(spark):
    at = datetime(2026, 1, 1, 6)
    cols = "id long, user_id string, account_id string, occurred_at timestamp_ntz, direction string, amount_paisa long, balance_after_paisa long, description_raw string, reference string, counterparty string, channel string, user_note string, transfer_group_id string, excluded_from_spend boolean, category_id int, category_source string, status string, dedupe_key string, created_at timestamp_ntz"
    row = lambda i, acc, bal, text, note, cat, status, day: (i, "u", acc, at, "DEBIT", 500, bal, text, None, None, None, note, None, False, cat, "user" if cat else None, status, f"old{i}", datetime(2026, 1, day))
    rows = spark.createDataFrame([
        row(1, "a", None, "PAYMENT TO TEA SHOP IN THE OLD TOWN", "note", 7, "CONFIRMED", 1), row(2, "b", 900, "PAYMENT TO TEA SHOP", None, None, "NEEDS_REVIEW", 2), row(3, "b", None, "SOMETHING ELSE", None, None, "NEEDS_REVIEW", 3),
        row(4, "b", 100, "SOMETHING ELSE Activate bit.ly/x", None, None, "NEEDS_REVIEW", 4),
    ], cols)
    accounts = spark.createDataFrame([("a", "NABIL", "001#####234567"), ("b", "NABIL", "00134567")], "id string, institution string, mask string")
    gaps = spark.createDataFrame([("b", 1, 2, 5), ("b", 1, 4, 6), ("b", 3, 2, 7)], "account_id string, after_txn_id long, before_txn_id long, missing_paisa long")
    out, kept, left = merge.merge_transactions(rows, accounts, gaps)
    got = {r.id: r for r in out.collect()}
    assert set(got) == {2, 4} and {r.id for r in kept.collect()} == {"b"}
    r = got[2]
    assert (r.balance_after_paisa, r.description_raw, r.user_note, r.category_id, r.category_source, r.status, r.account_id) == (900, "PAYMENT TO TEA SHOP IN THE OLD TOWN", "note", 7, "user", "CONFIRMED", "b")
    assert r.dedupe_key.startswith("nabil:00134567:2026-01-01T11:45:DEBIT:500:") and got[4].description_raw == "SOMETHING ELSE"
    assert sorted((g.after_txn_id, g.before_txn_id) for g in left.collect()) == [(2, 4), (4, 2)]


def test_a_longer_text_that_goes_on_otherwise_is_not_taken(spark):
    rows = [(1, "u", "k", 5, "abc", datetime(2026, 1, 2)), (2, "u", "k", None, "xyzzy longer", datetime(2026, 1, 1)), (3, "u", "m", 5, "abc", datetime(2026, 1, 2)), (4, "u", "m", None, "abcd", datetime(2026, 1, 1))]
    df = spark.createDataFrame(rows, "id int, user_id string, new_key string, balance_after_paisa long, description_raw string, created_at timestamp_ntz")
    none = F.lit(None).cast("string")
    df = df.withColumns({"counterparty": none, "user_note": none, "transfer_group_id": none, "excluded_from_spend": F.lit(False), "status": F.lit("CONFIRMED")})
    assert {r.new_key: r.description_raw for r in merge.merge_fold(df).collect()} == {"k": "abc", "m": "abcd"}


def test_long_notes_close_gaps_whole(spark):
    gaps = spark.createDataFrame([("a", 1, 2, 5, False, None, None, None)], "account_id string, after_txn_id int, before_txn_id int, missing_paisa long, resolved boolean, resolved_by string, resolved_at timestamp_ntz, resolution_note string")
    out = edits.close_gaps(gaps, gaps.select("account_id", "after_txn_id", "before_txn_id", F.lit("n" * 900).alias("note")), F.lit("2026-01-01").cast("timestamp_ntz")).first()
    assert len(out.resolution_note) == 900


def test_look_back_is_inclusive(spark):
    df = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, datetime(2025, 12, 31, 23))], "id int, occurred_at timestamp_ntz")
    assert [r.id for r in transfers.within_look_back(df, F.lit("2026-03-02").cast("timestamp_ntz")).collect()] == [1]
