from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pursebook.operators import categorize, edits
from pursebook.plans.sync import ACCOUNT_DDL, GAP_DDL, TXN_DDL, Ledger, parse_messages, sync

BODY = "Dear Customer, Your {m} has been {v} by NPR {a} on {t}, Remarks: {r}"


@pytest.fixture
def empty(spark):
    rules = spark.createDataFrame([(1, 10, "^ATM WDL", "cash"), (2, 20, "rent", "home")], "id int, priority int, pattern string, category_id string")
    return Ledger(spark.createDataFrame([], TXN_DDL), spark.createDataFrame([], ACCOUNT_DDL), spark.createDataFrame([], GAP_DDL), rules)


def inbox(spark):
    texts = [BODY.format(m="001##34567", v="withdrawn", a="1,000.00", t="15/09/2026 18:16:13", r="to esewa"), BODY.format(m="001##34567", v="withdrawn", a="500.00", t="16/09/2026 10:00:00", r="ATM WDL 1"), "Win", BODY.format(m="002##99999", v="deposited", a="1,000.00", t="15/09/2026 18:18:00", r="from nabil")]
    return spark.createDataFrame([(f"h{i}", "NABIL_ALERT", t) for i, t in enumerate(texts)], "content_hash string, sender string, body string")


def cached(ledger, spark):
    return Ledger(*(spark.createDataFrame(df.collect(), df.schema) for df in (ledger.transactions, ledger.accounts, ledger.gaps, ledger.rules)))


def test_second_run_changes_nothing(spark, empty):
    rows, outcome = parse_messages(inbox(spark))
    assert sorted(r.status for r in outcome.collect()) == ["IGNORED", "PARSED", "PARSED", "PARSED"]
    one = cached(sync(empty, rows, "u", "2026-09-20"), spark)
    txns = {r.source_message_id: r for r in one.transactions.collect()}
    assert len(txns) == 3 and one.accounts.count() == 2
    assert txns["h0"].excluded_from_spend and txns["h3"].excluded_from_spend and txns["h0"].transfer_group_id == txns["h3"].transfer_group_id
    assert (txns["h1"].category_id, txns["h1"].status, txns["h1"].excluded_from_spend) == ("cash", "CATEGORIZED", False)
    two = sync(one, rows, "u", "2026-09-21")
    for a, b in ((one.transactions, two.transactions), (one.accounts, two.accounts), (one.gaps, two.gaps)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_kept_tables_are_not_folded_again(spark, empty, tmp_path):
    rows, _ = parse_messages(inbox(spark))

    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    key, before = "spark.sql.adaptive.enabled", spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set(key, "false")
    try:
        # A look-back that h0 and h3, of 15 September, are outside of: they are no transfer for this run.
        plain, kept = sync(empty, rows, "u", "2026-09-20", 4), sync(empty, rows, "u", "2026-09-20", 4, keep=keep)
        sent = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (kept.transactions, kept.gaps)]
    finally:
        spark.conf.set(key, before)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["added", "folded"]
    for a, b in ((plain.transactions, kept.transactions), (plain.accounts, kept.accounts), (plain.gaps, kept.gaps)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {r.source_message_id: (r.transfer_group_id, r.category_id) for r in kept.transactions.collect()} == {"h0": (None, None), "h1": (None, "cash"), "h3": (None, None)}
    assert sent[0] <= 6 and sent[1] <= 4, sent


def test_rules_in_place_are_decisions_written_back(spark, empty):
    status, texts = ("NEEDS_REVIEW", "CATEGORIZED", "CONFIRMED", None), ("ATM WDL 1", "rent", "tea", None)
    rows = [(i, texts[i // 4 % 4], "old" if i % 3 else None, "user", Decimal("0.500"), status[i % 4], 5, "DEBIT") for i in range(48)]
    df = spark.createDataFrame(rows, "id int, description_raw string, category_id string, category_source string, category_confidence decimal(4,3), status string, amount_paisa long, direction string")
    want = edits.apply_decisions(df, categorize.decide(df, empty.rules)).select(*df.columns)
    got = categorize.apply_rules(df, empty.rules)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    none = empty.rules.where("false")
    assert sorted(map(str, categorize.apply_rules(df, none).collect())) == sorted(map(str, edits.apply_decisions(df, categorize.decide(df, none)).select(*df.columns).collect()))


def test_statement_adds_only_what_is_missing(spark, empty):
    rows, _ = parse_messages(inbox(spark))
    one = cached(sync(empty, rows, "u", "2026-09-20"), spark)
    line = rows.where("message_id = 'h1'").withColumns({"dedupe_key": F.lit("nabil_stmt:f:0"), "occurred_at": F.lit("2026-09-15 18:15:00").cast("timestamp_ntz")})
    extra = line.withColumns({"dedupe_key": F.lit("nabil_stmt:f:1"), "description_raw": F.lit("rent")})
    two = sync(one, line.unionByName(extra), "u", "2026-09-21").transactions
    assert two.count() == 4
    assert [(r.description_raw, r.category_id) for r in two.where("dedupe_key = 'nabil_stmt:f:1'").collect()] == [("rent", "home")]


def test_manual_entries_and_gap_closing(spark, empty):
    draft = (("u", "a", datetime(2026, 1, 2), "DEBIT", 500, "tea", "NPR", None, None, " with x "), ("u", "a", datetime(2026, 1, 2), "DEBIT", 0, "bad", "NPR", None, None, None))
    drafts = spark.createDataFrame(draft, "user_id string, account_id string, occurred_at timestamp_ntz, direction string, amount_paisa long, description string, currency string, balance_after_paisa long, category_id string, note string")
    txns, dup = edits.record_manual(empty.transactions, drafts)
    r = txns.collect()
    assert len(r) == 1 and r[0].dedupe_key.startswith("manual:") and r[0].parser_version == 0 and r[0].user_note == "with x" and dup.count() == 0
    again, dup = edits.record_manual(spark.createDataFrame(r, txns.schema), drafts)
    assert again.count() == 1 and dup.count() == 1
    gaps = spark.createDataFrame([("a", "1", "2", -500, False, None, None, None), ("a", "2", "3", 7, True, "RECONCILER", None, None)], GAP_DDL + ", resolved_at timestamp_ntz, resolution_note string")
    closed = edits.close_gaps(gaps, gaps.select("account_id", "after_txn_id", "before_txn_id", F.lit("found it").alias("note")), F.lit("2026-01-03").cast("timestamp_ntz")).orderBy("after_txn_id").collect()
    assert [(g.resolved, g.resolved_by, g.resolution_note) for g in closed] == [(True, "USER", "found it"), (True, "RECONCILER", None)]


def test_run_log_and_rule_edits(spark):
    runs = spark.createDataFrame([], "id string, user_id string, machine string, started_at timestamp_ntz, completed_at timestamp_ntz, since timestamp_ntz, fetched int, parsed int, failed int, txns_inserted int, error string")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    runs = edits.start_run(edits.start_run(runs, "r0", "u", "m", at("2026-01-01"), at("2025-12-01")), "r1", "u", "m", at("2026-01-02"), at("2025-12-01"))
    done = edits.finish_run(runs, "r1", spark.createDataFrame([(4, 3, 1, 2)], "fetched int, parsed int, failed int, txns_inserted int"), at("2026-01-03"), "boom")
    got = {r.id: (r.fetched, r.error, r.completed_at) for r in done.collect()}
    assert got == {"r0": (None, None, None), "r1": (4, "boom", datetime(2026, 1, 3))}
    rules = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 5), (3, "c", "z", 5)], "id int, pattern string, category_id string, priority int")
    out = edits.edit_rules(rules, spark.createDataFrame([(2, None, "w", 1)], "id int, pattern string, category_id string, priority int"), spark.createDataFrame([(3,)], "id int")).orderBy("id").collect()
    assert [tuple(r[c] for c in rules.columns) for r in out] == [(1, "a", "x", 5), (2, "b", "w", 1)]
    m = spark.createDataFrame([("h", "PENDING", None, 0), ("g", "PENDING", None, 0)], "content_hash string, status string, error string, txn_count int")
    o = spark.createDataFrame([("h", "FAILED", "bad", 0)], m.schema)
    assert {r.content_hash: (r.status, r.error) for r in edits.mark_messages(m, o).collect()} == {"h": ("FAILED", "bad"), "g": ("PENDING", None)}
