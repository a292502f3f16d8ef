"""The ledger queries over the driver's tables, each a composition of operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook import schema
from pursebook.functions import clock, keys, money, remarks
from pursebook.operators import audit, categorize, filters, merge, parsing, reconcile, transfers, views
from pursebook.sources import adapters as src

NOW = "2024-01-20"


def _txns(spark, d):
    return src.transactions(spark, d)


def _chain(spark, d):
    return src.balance_chain(_txns(spark, d))


def monthly_spend(spark: SparkSession, d: str) -> DataFrame:
    return views.monthly_spend(_txns(spark, d))


def monthly_totals_npr(spark, d):
    return views.month_totals(views.monthly_spend(_txns(spark, d)))


def orders_monthly_spend(spark, d):
    ledger = src.orders_ledger(spark, d).withColumns({"user_id": F.lit("u"), "currency": F.lit("NPR"), "excluded_from_spend": F.lit(False)})
    return views.monthly_spend(ledger)


def daily_spend(spark, d):
    return views.daily_spend(_txns(spark, d))


def category_leaves(spark, d):
    return views.category_rollup(views.monthly_spend(_txns(spark, d)), src.categories(spark, d))


def category_breakdown(spark, d):
    return views.group_shares(category_leaves(spark, d))


def open_gap_detection(spark, d):
    return reconcile.find_gaps(_chain(spark, d))


def _known_gaps(found: DataFrame) -> DataFrame:
    """A past run's table: two of three gaps known, some with another end, a few resolved."""
    rows = found.where("before_txn_id % 3 <> 0").withColumn("before_txn_id", F.when(F.col("before_txn_id") % 7 == 0, F.col("before_txn_id") + 1_000_000_000).otherwise(F.col("before_txn_id")))
    return rows.withColumns({"resolved": F.col("before_txn_id") % 5 == 0, "resolved_by": F.when(F.col("before_txn_id") % 5 == 0, "USER")})


def gap_resolution(spark, d):
    found = reconcile.find_gaps(_chain(spark, d))
    return reconcile.record_gaps(_known_gaps(found), found)


def _open(spark, d):
    chain = _chain(spark, d)
    gaps = reconcile.gaps_with_ends(chain).withColumn("resolved", F.col("before_txn_id") % 5 == 0)
    return reconcile.open_gaps(gaps, src.accounts(spark, d), chain)


def open_gaps_view(spark, d):
    return _open(spark, d).select("account_id", "account_display_name", "after_txn_id", "before_txn_id", "missing_paisa", "after_occurred_at", "before_occurred_at", "after_balance_paisa", "before_balance_paisa")


def gap_fill_suggestions(spark, d):
    return reconcile.fill_suggestions(_open(spark, d))


def _heat_inputs(spark, d):
    txns = _txns(spark, d)
    days = views.daily_spend(txns).where("currency = 'NPR'").drop("currency")
    return days, _gap_spans(_chain(spark, d), src.accounts(spark, d), txns)


def _gap_spans(chain, accounts, txns):
    """Days around each open gap of the whole chain, for every user with rows in its account."""
    gaps = reconcile.open_gaps(reconcile.gaps_with_ends(chain).withColumn("resolved", F.lit(False)), accounts, chain)
    users = txns.select("account_id", "user_id").distinct()
    return gaps.join(users, "account_id").select("user_id", clock.local_day(F.col("after_occurred_at")).alias("after_day"), clock.local_day(F.col("before_occurred_at")).alias("before_day"))


def all_heatmap_days(spark, d):
    txns = _txns(spark, d)
    days = views.daily_spend(txns).where("currency = 'NPR'").drop("currency")
    return views.heatmap(days, _gap_spans(_chain(spark, d), src.accounts(spark, d), txns), NOW).drop("week", "weekday")


def heatmap_days(spark, d):
    days, spans = _heat_inputs(spark, d)
    return views.heatmap(days, spans, NOW).drop("week", "weekday")


def week_grid(spark, d):
    days, spans = _heat_inputs(spark, d)
    return views.heatmap(days, spans, NOW).select("user_id", "day", "week", "weekday")


def spend_quartiles(spark, d):
    return views.quartile_cuts(_heat_inputs(spark, d)[0])


def transfer_pairs(spark, d):
    return transfers.candidate_pairs(_txns(spark, d)).select("d_id", "c_id", "amount_paisa", "apart_us")


def transfer_scores(spark, d):
    scored = transfers.scored(transfers.candidate_pairs(_txns(spark, d)))
    return scored.select("d_id", "c_id", "ambiguous", "mentioned", F.col("confidence").cast("double").alias("confidence"), "auto_link")


def transfer_linked_monthly(spark, d):
    txns = _txns(spark, d)
    return views.monthly_spend(transfers.link(txns, transfers.scored(transfers.candidate_pairs(txns))))


COLUMNS = ("id", "account_id", "occurred_at", "direction", "amount_paisa", "status", "category_id")


def filter_range_amount(spark, d):
    f = filters.TransactionFilter(start=datetime(2024, 1, 5), end=datetime(2024, 1, 15), direction="DEBIT", min_paisa=2000, max_paisa=9000, account_ids=frozenset({1, 3, 7}))
    return f.apply(_txns(spark, d)).select(*COLUMNS)


def filter_uncategorized(spark, d):
    return filters.TransactionFilter(uncategorized_only=True, category_ids=frozenset({1}), status="CONFIRMED").apply(_txns(spark, d)).select(*COLUMNS)


def filter_transfer_modes(spark, d):
    parts = [filters.TransactionFilter(transfers=m, category_ids=frozenset({2, 4})).apply(_txns(spark, d)).agg(F.lit(m).alias("mode"), F.count("*").alias("n"), F.sum("amount_paisa").alias("total_paisa")) for m in ("shown", "hidden", "only")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def search_text(spark, d):
    return filters.TransactionFilter(search=" 50%_OFF ").apply(_txns(spark, d)).unionByName(filters.TransactionFilter(search="Lunch With").apply(_txns(spark, d))).select("id", "description_raw", "counterparty", "user_note")


def search_documents(spark, d):
    docs = src.table(spark, d, "documents")
    return docs.where(filters.search_predicate("Tion of", ("text",))).select("doc_id")


def page_2(spark, d):
    return filters.page(_txns(spark, d), 2).select("id", "occurred_at")


def recent_by_status(spark, d):
    return filters.by_status(_txns(spark, d), "NEEDS_REVIEW").select("id", "occurred_at")


def on_day(spark, d):
    return filters.on_local_day(_txns(spark, d), datetime(2024, 1, 10)).select("id", "occurred_at")


def day_sections(spark, d):
    return views.day_sections(_txns(spark, d), "user_id")


def all_day_sections(spark, d):
    return views.day_sections(_txns(spark, d), "user_id")


def page_totals(spark, d):
    return views.page_totals(filters.page(_txns(spark, d), 0))


def _named(spark, d):
    return views.with_names(_txns(spark, d), src.accounts(spark, d), src.categories(spark, d))


def txn_with_names(spark, d):
    return _named(spark, d).select("id", "account_name", "category_name", remarks.title_of(F.col("counterparty"), F.col("description_raw")).alias("title"), views.is_transfer().alias("is_transfer"))


def rule_match_first(spark, d):
    return _txns(spark, d).select("id", categorize.rule_column(src.rules(spark)).alias("r")).select("id", "r.rule_id", F.col("r.category_id").alias("rule_category"))


def categorize_decisions(spark, d):
    return categorize.decide(_txns(spark, d), src.rules(spark)).select("id", "category_id", "category_source", "confidence", "status")


def recategorize_decisions(spark, d):
    return categorize.redecide(_txns(spark, d).withColumn("category_id", F.when(F.col("id") % 17 == 0, F.lit(101)).otherwise(F.col("category_id"))), src.rules(spark), src.categories(spark, d))


def recategorize_counts(spark, d):
    return recategorize_decisions(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


def leaf_categories(spark, d):
    return categorize.leaves(src.categories(spark, d)).select("id", "name")


def category_choices(spark, d):
    return categorize.choices(src.categories(spark, d)).select("group_name", F.array_join("names", "|").alias("names"))


def rule_coverage(spark, d):
    return categorize.coverage(_txns(spark, d), src.rules(spark))


def learned_rules(spark, d):
    edits = _txns(spark, d).where("category_source = 'user'").withColumn("new_category_id", F.col("account_id").cast("int"))
    return categorize.learned_rules(edits)


def merchant_labels(spark, d):
    return _txns(spark, d).select("id", remarks.merchant_label(F.col("description_raw"), F.col("counterparty")).alias("label"))


def remark_channel(spark, d):
    return _txns(spark, d).groupBy(remarks.channel_of(F.col("description_raw")).alias("channel")).agg(F.count("*").alias("n"))


def _masked(spark, d):
    mask = F.when(F.col("id") % 2 == 0, F.concat(F.lit("001#####2345"), F.format_string("%02d", "account_id"))).otherwise(F.concat(F.lit("001##345"), F.format_string("%02d", "account_id")))
    return _txns(spark, d).withColumn("mask", F.when(F.col("id") % 7 == 0, "XXXX4321").otherwise(mask))


def canonical_mask(spark, d):
    return _masked(spark, d).select("id", keys.canonical_mask(F.col("mask")).alias("canonical"))


def dedupe_keys(spark, d):
    c = F.col
    return _masked(spark, d).select("id", keys.account_key(c("mask"), clock.local(c("occurred_at")), c("direction"), c("amount_paisa"), c("description_raw")).alias("dedupe_key"), keys.content_hash(c("institution"), c("id"), c("description_raw")).alias("content_hash"))


def _arrivals(spark, d):
    """Each transaction by two transports: an early one without balance, a later fuller one."""
    base = _txns(spark, d).select("user_id", F.concat(F.lit("k"), (F.col("id") % 3000).cast("string")).alias("dedupe_key"), "id", F.col("occurred_at").alias("arrival"), "amount_paisa", "direction",
                                  F.substring(F.col("description_raw"), 1, 5 + F.col("id").cast("int") % 20).alias("description_raw"), F.when(F.col("id") % 2 == 0, F.col("id") * 10).alias("balance_after_paisa"),
                                  F.when(F.col("id") % 3 == 0, F.concat(F.lit("ref"), F.col("id").cast("string"))).alias("reference"), F.nullif("counterparty", F.lit("")).alias("counterparty"), F.lit(None).cast("string").alias("channel"))
    return base


def upsert_collapse(spark, d):
    rows = _arrivals(spark, d)
    return merge.upsert(rows.where("id % 10 < 3"), rows.where("id % 10 >= 3"))


def insert_ignore(spark, d):
    rows = _arrivals(spark, d)
    return merge.insert_ignore(rows.where("id % 10 < 2"), rows.where("id % 10 >= 2"), ("user_id", "dedupe_key"), ("arrival", "id")).select("user_id", "dedupe_key", "id")


def _rekeyed(spark, d):
    return _chain(spark, d).withColumns({"new_key": F.concat(F.lit("k"), (F.col("id") % 2500).cast("string")), "created_at": F.col("occurred_at")})


def survivor_rank(spark, d):
    return merge.survivor_rank(_rekeyed(spark, d)).select("id", "rank")


def survivor_category(spark, d):
    return merge.survivor_category(_rekeyed(spark, d))


def merge_fold(spark, d):
    return merge.merge_fold(_rekeyed(spark, d))


def account_survivor(spark, d):
    accounts = _masked(spark, d).select("institution", "mask").distinct().withColumn("id", F.concat_ws("/", "institution", "mask"))
    return merge.account_survivors(accounts)


def new_accounts(spark, d):
    keys_ = _masked(spark, d).select("user_id", "institution", F.when(F.col("id") % 3 > 0, F.col("mask")).alias("mask"))
    known = keys_.where("mask like '001##3%'").distinct().withColumns({"id": F.concat_ws("/", "user_id", "mask"), "display_name": F.lit("known")})
    return merge.get_or_create_accounts(known, keys_).groupBy("user_id", "institution", "mask", "display_name").agg(F.count("*").alias("n"))


def statement_audit_missing(spark, d):
    """lineitem as the statement of a bank, orders as the ledger: lines by day, amount, flag."""
    day = F.col("l_shipdate").cast("date").alias("day")
    lines = src.table(spark, d, "lineitem").select(day, F.col("l_quantity").cast("bigint").alias("amount_paisa"), F.col("l_returnflag").alias("direction"), "l_orderkey", "l_linenumber")
    ledger = lines.where("l_orderkey % 3 <> 0").select("day", "amount_paisa", "direction")
    return audit.missing_from(lines, ledger, ("day", "amount_paisa", "direction"), ("l_orderkey", "l_linenumber")).select("day", "amount_paisa", "direction", "l_orderkey", "l_linenumber")


def _messages(spark, d):
    """One message for every event; all but the failed and the ignored ones have a transaction."""
    events = src.table(spark, d, "events")
    return events.selectExpr("event_id AS message_id", "ts AS received_at", "CASE WHEN event_id % 17 = 0 THEN 'FAILED' WHEN event_id % 19 = 0 THEN 'IGNORED' ELSE 'PARSED' END AS status",
                             "CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0 THEN 1 ELSE 0 END AS txn_count", "CASE WHEN event_id % 2 = 0 THEN 'SMS' ELSE 'EMAIL' END AS channel",
                             "concat(props, '-----------------------------------------------------------------------') AS body")


def all_retention_candidates(spark, d):
    txns = _txns(spark, d).withColumn("message_no", F.col("id")).withColumn("status", F.when(F.col("message_no") % 2 == 0, "CONFIRMED").otherwise(F.col("status")))
    return audit.retention_candidates(_messages(spark, d), txns, F.lit("2024-01-09").cast("timestamp_ntz")).select("message_id")


def all_status_counts(spark, d):
    return audit.status_counts(_messages(spark, d))


def all_message_issues(spark, d):
    return audit.issues(_messages(spark, d)).select("message_id", "status", "preview")


def all_run_summary(spark, d):
    return audit.run_summary(_messages(spark, d))


def retention_candidates(spark, d):
    return all_retention_candidates(spark, d)


def status_counts(spark, d):
    return audit.status_counts(_messages(spark, d))


def message_issues(spark, d):
    return audit.issues(_messages(spark, d)).select("message_id", "status", "preview")


def run_summary(spark, d):
    return audit.run_summary(_messages(spark, d))


def last_success(spark, d):
    runs = src.table(spark, d, "events").selectExpr("ts AS started_at", "CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL '5' MINUTE END AS completed_at", "CASE WHEN event_id % 3 = 0 THEN 'boom' END AS error")
    return audit.last_runs(runs).withColumn("next_since", clock.watermark(F.col("last_success"), F.lit("2023-01-01").cast("timestamp_ntz")))


def export_rows(spark, d):
    return audit.export_rows(_named(spark, d))


def constraint_violations(spark, d):
    rows = _txns(spark, d).withColumns({
        "amount_paisa": F.when(F.col("id") % 31 == 0, F.lit(0)).otherwise(F.col("amount_paisa")), "entry_source": F.when(F.col("id") % 10 == 0, "MANUAL").otherwise("PARSED"),
        "parser_version": F.when(F.col("id") % 20 == 0, 0).otherwise(1), "dedupe_key": F.when(F.col("id") % 30 == 0, "manual:x").otherwise("k"),
    })
    return schema.violations(rows, schema.transaction_checks())


def duplicate_keys(spark, d):
    return schema.duplicate_keys(_arrivals(spark, d), ("user_id", "dedupe_key"))


def parse_amounts(spark, d):
    text = F.format_number((F.col("l_extendedprice") * 10).cast("decimal(18,3)"), 3)
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", money.parse_subunit(text).alias("paisa"), money.parse_paisa(F.concat(F.lit("Rs. "), F.format_number(F.col("l_quantity").cast("decimal(10,1)"), 1))).alias("typed"))


def format_amounts(spark, d):
    return _txns(spark, d).select("id", money.format_paisa(F.col("amount_paisa") * 137, F.col("currency")).alias("text"))


def statement_dates(spark, d):
    day = F.col("o_orderdate")
    text = F.element_at(F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "dd-MM-yyyy"), F.date_format(day, "dd MMM yyyy"), F.lit("junk")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return src.table(spark, d, "orders").select("o_orderkey", clock.parse_statement_date(text).alias("parsed"))


def _sms(spark, d):
    at = clock.local(F.col("occurred_at"))
    amount = F.format_number((F.col("amount_paisa") / 100).cast("decimal(18,2)"), 2)
    nabil = F.concat(F.lit("Dear Customer, Your 001##345"), F.format_string("%02d", "account_id"), F.lit(" has been "), F.when(F.col("direction") == "CREDIT", "deposited").otherwise("withdrawn"), F.lit(" by NPR "), amount,
                     F.lit(" on "), F.date_format(at, "dd/MM/yyyy HH:mm:ss"), F.lit(", Remarks: "), F.col("description_raw"), F.lit(" Activate bit.ly/x for a/c balance"))
    laxmi = F.concat(F.lit("Dear Customer, Your #98765 has been "), F.when(F.col("direction") == "CREDIT", "credited").otherwise("debited"), F.lit(" by NPR "), amount, F.lit(" on "), F.date_format(at, "dd/MM/yy"),
                     F.lit(". Remarks:QR-Pay,CMPAY,44700000D4T4/KK Store,Sales;Sales\n-Laxmi Sunrise"))
    return _txns(spark, d).select("id", F.concat(F.lit("h"), F.col("id").cast("string")).alias("content_hash"), F.when(F.col("id") % 3 == 0, "LAXMI_SUN").when(F.col("id") % 3 == 1, "NABIL_ALERT").otherwise("PROMO").alias("sender"),
                                  F.when(F.col("id") % 3 == 0, laxmi).when(F.col("id") % 3 == 1, nabil).otherwise("Win a phone").alias("body"))


def sms_parse(spark, d):
    messages = _sms(spark, d)
    rows = parsing.parse_nabil_sms(messages).unionByName(parsing.parse_laxmi_sms(messages))
    return rows.select("message_id", "institution", "account_mask", "occurred_at", "occurred_precision", "direction", "amount_paisa", "currency", "reference", "description_raw", "counterparty", "channel")


def sms_outcomes(spark, d):
    routed = parsing.route_sms(_sms(spark, d))
    rows = parsing.parse_nabil_sms(routed).unionByName(parsing.parse_laxmi_sms(routed))
    return parsing.outcomes(routed, rows).groupBy("status").agg(F.count("*").alias("n"), F.sum("txn_count").alias("txns"))


def user_edits(spark, d):
    edits = _txns(spark, d).where("id % 9 = 0").select("id", F.when(F.col("id") % 2 == 0, F.lit(7)).alias("category_id"), F.when(F.col("id") % 27 == 0, " ").when(F.col("id") % 18 == 0, " tea ").alias("note"), (F.col("id") % 45 == 0).alias("confirm"))
    return audit.apply_edits(_txns(spark, d), edits).select("id", "category_id", "category_source", "user_note", "status")


QUERIES = {f.__name__: f for f in (
    monthly_spend, monthly_totals_npr, orders_monthly_spend, daily_spend, category_leaves, category_breakdown, open_gap_detection, gap_resolution, open_gaps_view, gap_fill_suggestions,
    heatmap_days, week_grid, spend_quartiles, transfer_pairs, transfer_scores, transfer_linked_monthly, filter_range_amount, filter_uncategorized, filter_transfer_modes, search_text, search_documents,
    page_2, recent_by_status, on_day, day_sections, page_totals, txn_with_names, rule_match_first, categorize_decisions, recategorize_decisions, recategorize_counts, leaf_categories, category_choices,
    rule_coverage, learned_rules, merchant_labels, remark_channel, canonical_mask, dedupe_keys, upsert_collapse, insert_ignore, survivor_rank, survivor_category, merge_fold, account_survivor, new_accounts,
    statement_audit_missing, retention_candidates, status_counts, message_issues, run_summary, last_success, export_rows, constraint_violations, duplicate_keys, parse_amounts, format_amounts,
    statement_dates, sms_parse, sms_outcomes, user_edits, all_retention_candidates, all_status_counts, all_message_issues, all_run_summary,
    all_heatmap_days, all_day_sections,
)}
