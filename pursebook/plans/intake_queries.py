"""Queries over what comes in and what people enter: statements, mails, manual entries,
edits, run logs, labels and the merge of a ledger.  Inputs are made from ``events``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursebook.functions import clock, keys, money
from pursebook.operators import audit, categorize, edits, filters, merge, parsing, reconcile, transfers
from pursebook.plans import sync
from pursebook.plans.ledger_queries import _chain, _known_gaps, _messages, _txns
from pursebook.sources import adapters as src
from pursebook.sources import messages as inbox

NOW = datetime(2024, 1, 20)


def _at(text):
    return F.lit(text).cast("timestamp_ntz")


def card_keys(spark, d):
    t = _txns(spark, d)
    return t.select("id", keys.card_key(F.format_string("4321XX%02d", "account_id"), clock.local(F.col("occurred_at")), F.col("amount_paisa"), F.col("description_raw")).alias("dedupe_key"))


def archive_paths(spark, d):
    return _txns(spark, d).select("id", keys.archive_path(F.col("id").cast("string"), F.col("occurred_at")).alias("path"))


def time_ago_labels(spark, d):
    return _txns(spark, d).select("id", clock.time_ago(F.col("occurred_at"), _at("2024-03-05 12:00:00")).alias("label"))


def day_labels(spark, d):
    return _txns(spark, d).select("id", clock.day_label(clock.local_day(F.col("occurred_at")), F.lit("2024-01-20").cast("date")).alias("label"))


def span_labels(spark, d):
    orders = src.table(spark, d, "orders")
    return orders.select("o_orderkey", clock.span_label(F.col("o_orderdate"), F.lit("1999-01-01").cast("timestamp_ntz")).alias("label"))


def editable_amounts(spark, d):
    return _txns(spark, d).select("id", money.editable(F.col("amount_paisa") * 7).alias("text"))


def preset_totals(spark, d):
    """The named ranges of the filter screen."""
    rows = []
    for preset in ("thisMonth", "lastMonth", "last3Months", "thisYear", "all"):
        start, end = filters.preset_range(preset, NOW)
        found = filters.TransactionFilter(start=start, end=end).apply(_txns(spark, d))
        rows.append(found.agg(F.lit(preset).alias("preset"), F.count("*").alias("n"), F.coalesce(F.sum("amount_paisa"), F.lit(0)).alias("total_paisa")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def active_filter_counts(spark, d):
    made = [
        filters.TransactionFilter(), filters.TransactionFilter(search=" "), filters.TransactionFilter(min_paisa=1, max_paisa=2),
        filters.TransactionFilter(search="x", start=NOW, category_ids=frozenset([1]), account_ids=frozenset([1]), direction="DEBIT", status="CONFIRMED", transfers="only", min_paisa=0, uncategorized_only=True),
    ]
    return spark.createDataFrame([(i, f.active_count) for i, f in enumerate(made)], "filter int, active int")


def one_transaction(spark, d):
    return filters.exactly_one(_txns(spark, d), "id", 42).select("id", "amount_paisa", "direction")


def oldest_in_review(spark, d):
    return filters.oldest_by_status(_txns(spark, d), "NEEDS_REVIEW").select("id", "occurred_at")


def account_range(spark, d):
    return filters.in_account_range(_txns(spark, d), 3, datetime(2024, 1, 3), datetime(2024, 1, 9)).select("id", "occurred_at")


def look_back(spark, d):
    return transfers.within_look_back(_txns(spark, d), _at("2024-03-12 00:00:00")).select("id")


def earliest_transaction(spark, d):
    return audit.earliest(_txns(spark, d))


def attention_counts(spark, d):
    return audit.attention_counts(_messages(spark, d), _known_gaps(reconcile.find_gaps(_chain(spark, d))))


def gap_states(spark, d):
    found = reconcile.find_gaps(_chain(spark, d))
    return reconcile.gap_state(_known_gaps(found), found)


def audit_ranges(spark, d):
    return audit.audit_range(_txns(spark, d))


def expired_files(spark, d):
    txns = _txns(spark, d).withColumn("message_no", F.col("id"))
    return audit.expired_files(_messages(spark, d), txns, _at("2025-01-08 00:00:00"))


def _staged(spark, d):
    """Staged uploads: a sender, a body and a content hash for each event."""
    names = F.array(*[F.lit(x) for x in ("ESEWA_STATEMENT", "NABIL_STATEMENT", "LAXMI_STATEMENT", "BANK_STATEMENT", "NABIL_ALERT", "laxmi", "promo")])
    return src.table(spark, d, "events").select(
        "event_id", F.get(names, (F.col("event_id") % 7).cast("int")).alias("sender"), F.col("props").alias("body"), F.col("ts").alias("received_at"),
        F.concat(F.lit("h"), (F.col("event_id") % 4001).cast("string")).alias("content_hash"), F.when(F.col("event_id") % 5 == 0, "PENDING").otherwise("PARSED").alias("status"),
        F.when(F.col("event_id") % 2 == 0, "SMS").otherwise("FILE").alias("channel"),
    )


def uploaded_statements(spark, d):
    rows = _staged(spark, d).withColumn("content_hash", F.format_string("%012d", "event_id"))
    return filters.uploaded_statements(rows).select("content_hash", "display_name", "received_at")


def pending_queue(spark, d):
    rows = _staged(spark, d).withColumn("content_hash", F.format_string("%012d", "event_id"))
    return inbox.pending(rows).select("content_hash", "received_at")


def message_dedupe(spark, d):
    return inbox.dedupe_messages(_staged(spark, d), "content_hash", "event_id").select("content_hash", "event_id")


def sms_scan(spark, d):
    rows = inbox.scan_sms(_staged(spark, d).select("event_id", "sender", "body", "received_at"), _at("2024-01-05 00:00:00"), ["nabil_alert", "LAXMI"])
    return rows.select("event_id", "content_hash")


def sms_since(spark, d):
    return inbox.sms_watermark(_staged(spark, d), _at("2024-03-01 00:00:00"))


def statement_senders(spark, d):
    name = F.element_at(F.array(F.lit("My_Laxmi.pdf"), F.lit("sunrise-jan.pdf"), F.lit("NABIL 2024.pdf"), F.lit("scan.pdf")), (F.col("event_id") % 4 + 1).cast("int"))
    return src.table(spark, d, "events").groupBy(inbox.statement_sender(name).alias("sender")).agg(F.count("*").alias("n"))


def _mails(spark, d):
    sender = F.element_at(F.array(F.lit("b@x"), F.lit("a@x"), F.lit("C@x")), (F.col("event_id") % 3 + 1).cast("int"))
    return src.table(spark, d, "events").select(F.format_string("%012d", "event_id").alias("message_id"), sender.alias("from_addr"), F.col("ts").alias("received_at"))


def mail_fetch(spark, d):
    return inbox.fetch_since(_mails(spark, d), _at("2024-01-10 13:00:00"), ["a@x", "b@x"], 300).select("message_id", "from_addr")


def mail_counts(spark, d):
    return inbox.count_since(_mails(spark, d), _at("2024-01-10 13:00:00"), ["a@x", "c@x"])


def _grid(spark, d, columns):
    """Rows of made files: 50 events each, behind a header row."""
    e = _txns(spark, d).withColumns({"file_id": F.concat(F.lit("f"), F.floor(F.col("id") / 50).cast("string")), "row_no": (F.col("id") % 50 + 1).cast("int")})
    return e, e.select("file_id").distinct().select("file_id", F.lit(0).alias("row_no"), F.array(*[F.lit(c) for c in columns]).alias("cells"))


def wallet_statement(spark, d):
    """Wallet sheets: PAR14, SRC5."""
    e, head = _grid(spark, d, parsing.SHEET_HEADER)
    amount, debit = F.format_number((F.col("amount_paisa") / 100).cast("decimal(18,2)"), 2), F.col("direction") == "DEBIT"
    cells = F.array(
        F.concat(F.lit("R"), F.col("id").cast("string")), F.date_format(clock.local(F.col("occurred_at")), "yyyy-MM-dd HH:mm:ss.S"), F.lit("Paid for Tea Shop"), F.when(debit | (F.col("id") % 10 == 3), amount).otherwise("0"),
        F.when(~debit | (F.col("id") % 10 == 3), amount).otherwise("0"), F.when(F.col("id") % 10 == 4, "PENDING").otherwise("COMPLETE"), F.lit("1,000.50"), F.lit("App"),
    )
    rows = parsing.parse_wallet_rows(parsing.sheet_rows(head.unionByName(e.select("file_id", "row_no", cells.alias("cells")))))
    return rows.select("message_id", "dedupe_key", "occurred_at", "direction", "amount_paisa", "balance_after_paisa", "counterparty", "channel")


def _bank_grid(spark, d):
    e, head = _grid(spark, d, ("S.N", "Txn Date", "Particulars", "Withdraw", "Deposit", "Balance"))
    amount, debit = F.format_number((F.col("amount_paisa") / 100).cast("decimal(18,2)"), 2), F.col("direction") == "DEBIT"
    cells = F.array(
        F.col("row_no").cast("string"), F.date_format(F.col("occurred_at"), "dd/MM/yyyy"), F.when(F.col("id") % 10 == 3, "Opening Balance").otherwise(F.col("description_raw")), F.when(debit, amount).otherwise("-"),
        F.when(debit, "").otherwise(amount), F.when(F.col("id") % 10 == 4, "-").otherwise("2,000.00"),
    )
    grid = head.unionByName(e.select("file_id", "row_no", cells.alias("cells")))
    return grid.select("file_id", F.lit("NABIL").alias("institution"), F.lit("00112345678901").alias("account_mask"), F.lit(0).alias("page"), "row_no", "cells")


def bank_statement(spark, d):
    """Bank statements: PAR10, SRC6."""
    rows = parsing.bank_statement_rows(_bank_grid(spark, d))
    return rows.select("message_id", "account_mask", "occurred_at", "direction", "amount_paisa", "balance_after_paisa", "description_raw")


def reparse_statements(spark, d):
    """STR5, FLT18: one template of the archive, with today's parsers."""
    grid = _bank_grid(spark, d)
    staged = grid.select(F.col("file_id").alias("content_hash")).distinct().select("content_hash", F.lit("NABIL_STATEMENT").alias("sender"), F.lit("cells").alias("body"))
    sms = _staged(spark, d).select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("content_hash"), F.lit("PROMO").alias("sender"), "body")
    _, outcomes = sync.reparse(staged.unionByName(sms), "bank.statement_row", statements=grid)
    return outcomes.groupBy("status").agg(F.count("*").alias("n"), F.sum("txn_count").alias("txns"))


def mail_alerts(spark, d):
    """Bank alerts and wallet loads out of the tables of HTML mails: PAR1, PAR3, PAR5, PAR6."""
    t = _txns(spark, d)
    amount = F.format_number((F.col("amount_paisa") / 100).cast("decimal(18,2)"), 2)
    cell = lambda tag, *cs: F.concat(F.lit("<tr>"), *[x for c in cs for x in (F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))], F.lit("</tr>"))
    at = clock.local(F.col("occurred_at"))
    bank = F.concat(
        F.lit('<p>Transaction Alert</p><table border="1">'), cell("th", *[F.lit(x) for x in ("Transaction Date", "Transaction Type", "Transaction Amount", "Available Balance", "Remarks")]),
        cell("td", F.date_format(at, "yyyy-MM-dd HH:mm"), F.initcap("direction"), amount, F.lit("1,000.50"), F.col("description_raw")), F.lit("</table>"),
    )
    load = F.concat(
        F.lit('Your fund load from bank details<table border="1">'), cell("th", *[F.lit(x) for x in ("Transaction Date", "Transaction Amount", "Reference Code", "Bank Name")]),
        cell("td", F.date_format(at, "yyyy-MM-dd HH:mm:ss"), amount, F.concat(F.lit("R"), F.col("id").cast("string")), F.lit("Some Bank")), F.lit("</table>"),
    )
    even = F.col("id") % 2 == 0
    mails = t.select(
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), F.when(even, "alert@nabilbank.com").otherwise("no-reply@esewa.com.np").alias("from_addr"), F.lit("x").alias("subject"),
        F.when(even, "Transaction Alert").otherwise("").alias("text"), F.when(even, bank).otherwise(load).alias("html"),
    )
    rows, _ = sync.parse_mails(mails, "00134567")
    return rows.select("message_id", "template_key", "occurred_at", "occurred_precision", "direction", "amount_paisa", "balance_after_paisa", "reference", "description_raw", "channel")


def card_mails(spark, d):
    """Card alerts: PAR4."""
    amount = F.format_number((F.col("amount_paisa") / 100).cast("decimal(18,2)"), 2)
    text = F.concat(F.lit("Dear, Your Debit Card 4321XX was used at SHOP "), (F.col("id") % 9).cast("string"), F.lit("; CITY for Purchase of USD "), amount, F.lit(" on "), F.upper(F.date_format("occurred_at", "dd-MMM-yy")))
    rows = parsing.parse_card_mail(_txns(spark, d).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), text.alias("text")))
    return rows.select("message_id", "occurred_at", "amount_paisa", "currency", "counterparty", "description_raw")


def _drafts(spark, d):
    t = _txns(spark, d)
    note = F.when(F.col("id") % 4 == 0, " with tea ").when(F.col("id") % 4 == 1, F.repeat(F.lit("x"), 501))
    return t.select(
        "id", "user_id", "account_id", "occurred_at", F.when(F.col("id") % 6 == 5, "SIDEWAYS").otherwise(F.col("direction")).alias("direction"), F.when(F.col("id") % 9 == 0, 0).otherwise(F.col("amount_paisa")).alias("amount_paisa"),
        F.col("description_raw").alias("description"), "currency", F.lit(None).cast("bigint").alias("balance_after_paisa"), "category_id", note.alias("note"),
    )


def manual_entries(spark, d):
    """SNK16, FN8."""
    rows = edits.manual_entries(_drafts(spark, d))
    return rows.select("dedupe_key", "amount_paisa", "category_source", "status", "user_note", "entry_source", "parser_version")


def rejected_drafts(spark, d):
    return edits.rejected_drafts(_drafts(spark, d)).select("id", "reason")


def closed_gaps(spark, d):
    known = _known_gaps(reconcile.find_gaps(_chain(spark, d))).withColumns({"resolved_at": F.lit(None).cast("timestamp_ntz"), "resolution_note": F.lit(None).cast("string")})
    closed = known.where("before_txn_id % 2 = 0").select(*reconcile.GAP_KEY, F.repeat(F.lit("n"), 600).alias("note"))
    rows = edits.close_gaps(known, closed, _at("2024-02-01 00:00:00"))
    return rows.select(*reconcile.GAP_KEY, "resolved", "resolved_by", F.length("resolution_note").alias("note_chars"))


def marked_messages(spark, d):
    m = _messages(spark, d).select(F.col("message_id").alias("content_hash"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("txn_count"))
    done = m.where("content_hash % 3 = 0").select("content_hash", F.when(F.col("content_hash") % 2 == 0, "FAILED").otherwise("PARSED").alias("status"), F.when(F.col("content_hash") % 2 == 0, "bad").alias("error"), F.lit(2).alias("txn_count"))
    return edits.mark_messages(m, done)


def run_log(spark, d):
    """SNK7: a run that starts and ends."""
    runs = spark.createDataFrame([], "id string, user_id string, machine string, started_at timestamp_ntz, completed_at timestamp_ntz, since timestamp_ntz, fetched int, parsed int, failed int, txns_inserted int, error string")
    runs = edits.start_run(runs, "r1", "u", "m", _at("2024-01-20 00:00:00"), _at("2024-01-17 00:00:00"))
    counts = _messages(spark, d).agg(F.count("*").alias("fetched"), F.count_if(F.col("status") == "PARSED").alias("parsed"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.sum("txn_count").alias("txns_inserted"))
    return edits.finish_run(runs, "r1", counts, _at("2024-01-20 00:05:00"))


def edited_rules(spark, d):
    rules = src.rules(spark)
    updates = rules.where("id % 3 = 0").select("id", F.lit(None).cast("string").alias("pattern"), F.lit(77).alias("category_id"), F.lit(None).cast("int").alias("priority"))
    return edits.edit_rules(rules, updates, rules.where("id % 4 = 1").select("id"))


def seeded_categories(spark, d):
    return categorize.seed_for_users(_txns(spark, d)).select("id", "user_id", "name", "parent_id", "is_spend")


def reparented(spark, d):
    c = src.categories(spark, d).select(F.col("id").cast("string").alias("id"), F.lit("u").alias("user_id"), "name", F.col("parent_id").cast("string").alias("parent_id"), "is_spend")
    wanted = c.where("id in ('1', '2')").select(F.lit("new").alias("id"), "user_id", "name", F.lit("999").alias("parent_id"), F.lit(True).alias("is_spend")).unionByName(spark.createDataFrame([("n", "u", "Brand new", "999", False)], "id string, user_id string, name string, parent_id string, is_spend boolean"))
    return categorize.rename(categorize.reparent(c, wanted), {"KENYA": "Kenya (moved)"})


def repointed_rules(spark, d):
    moves = spark.createDataFrame([("MPAY", 55), ("no such", 1)], "pattern string, category_id int")
    return categorize.repoint_rules(src.rules(spark), moves)


def last_written(spark, d):
    """SNK2: the newest row of a key, with the first arrival's time."""
    rows = _txns(spark, d).select(F.concat(F.lit("k"), (F.col("id") % 700).cast("string")).alias("key"), "id", "amount_paisa", F.col("occurred_at").alias("first_seen"))
    return merge.last_writer(rows, "key", "id", ("first_seen",))


def merged_ledger(spark, d):
    """MRG4 over accounts that are written in two ways, rows that two transports report."""
    t = _chain(spark, d)
    two = F.when(F.col("id") % 2 == 0, F.format_string("001#####23%05d", "account_id")).otherwise(F.format_string("001##%05d", "account_id"))
    rows = t.select(
        "id", "user_id", two.alias("account_id"), F.date_trunc("hour", "occurred_at").cast("timestamp_ntz").alias("occurred_at"), "direction",
        (F.col("amount_paisa") % 5 * 100 + 100).alias("amount_paisa"), "balance_after_paisa", F.lit("shop").alias("description_raw"), F.lit(None).cast("string").alias("reference"), "counterparty", F.lit(None).cast("string").alias("channel"), "user_note",
        "transfer_group_id", "excluded_from_spend", "category_id", "category_source", "status", F.lit("old").alias("dedupe_key"), F.col("occurred_at").alias("created_at"),
    )
    accounts = rows.select(F.col("account_id").alias("id"), F.lit("NABIL").alias("institution"), F.col("account_id").alias("mask")).distinct()
    gaps = spark.createDataFrame([], "account_id string, after_txn_id long, before_txn_id long, missing_paisa long")
    out, _, _ = merge.merge_transactions(rows, accounts, gaps)
    return out.select("id", "account_id", "dedupe_key", "balance_after_paisa", "counterparty", "user_note", "transfer_group_id", "excluded_from_spend", "category_id", "category_source", "status")


#: What the reports of a transaction call it, by id % 6: whole, cut, with an advert, an advert alone.
TEXTS = ("PAYMENT TO TEA SHOP IN THE OLD TOWN", "PAYMENT TO TEA SHOP", "PAYMENT TO TEA SHOP Activate bit.ly/x", "RENT", "Activate bit.ly/y", "PAYMENT TO TEA SHELF")


def _reports(spark, d):
    """(rows, accounts, gaps): minutes with several reports of one amount, under accounts that
    are written in two ways, some at another bank; gaps between rows that may become one."""
    t = _chain(spark, d)
    bank = F.when(F.col("account_id") == 7, "LAXMI").otherwise("NABIL")
    mask = F.when(F.col("account_id") == 7, F.format_string("77###%05d", "account_id")).when(F.col("id") % 2 == 0, F.format_string("001#####23%05d", "account_id")).otherwise(F.format_string("001%05d", "account_id"))
    text = F.get(F.array(*map(F.lit, TEXTS)), (F.col("id") % 6).cast("int"))
    rows = t.select(
        "id", "user_id", F.concat_ws("/", "user_id", mask).alias("account_id"), F.date_trunc("day", "occurred_at").cast("timestamp_ntz").alias("occurred_at"), "direction", (F.col("amount_paisa") % 3 + 1).alias("amount_paisa"),
        "balance_after_paisa", text.alias("description_raw"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("r"), F.col("id").cast("string"))).alias("reference"), F.nullif("counterparty", F.lit("")).alias("counterparty"),
        F.when(F.col("id") % 5 == 0, "SMS").alias("channel"), "user_note", "transfer_group_id", "excluded_from_spend", "category_id", "category_source", "status", F.concat(F.lit("old"), F.col("id").cast("string")).alias("dedupe_key"), F.col("occurred_at").alias("created_at"),
    )
    accounts = t.select("user_id", mask.alias("mask"), bank.alias("institution")).distinct().select(F.concat_ws("/", "user_id", "mask").alias("id"), "user_id", "institution", "mask")
    gaps = rows.select("account_id", F.col("id").alias("after_txn_id"), (F.col("id") + 1 + F.col("id") % 2 * 150).alias("before_txn_id"), F.col("amount_paisa").alias("missing_paisa")).where("after_txn_id % 3 = 0")
    return rows, accounts, gaps


def merged_transactions(spark, d):
    return merge.merge_transactions(*_reports(spark, d))[0].drop("created_at", "occurred_at")


def merged_accounts(spark, d):
    return merge.merge_transactions(*_reports(spark, d))[1].select("id", "user_id", "institution", "mask")


def merged_gaps(spark, d):
    """Gaps that have become the same one differ in the amount; their number is what counts."""
    return merge.merge_transactions(*_reports(spark, d))[2].select("account_id", "after_txn_id", "before_txn_id")


QUERIES = {f.__name__: f for f in (
    merged_transactions, merged_accounts, merged_gaps, card_keys, archive_paths, time_ago_labels, day_labels, span_labels, editable_amounts, preset_totals, active_filter_counts, one_transaction, oldest_in_review, account_range, look_back, earliest_transaction,
    attention_counts, gap_states, audit_ranges, expired_files, uploaded_statements, pending_queue, message_dedupe, sms_scan, sms_since, statement_senders, mail_fetch, mail_counts, wallet_statement, bank_statement,
    reparse_statements, mail_alerts, card_mails, manual_entries, rejected_drafts, closed_gaps, marked_messages, run_log, edited_rules, seeded_categories, reparented, repointed_rules, last_written, merged_ledger,
)}
