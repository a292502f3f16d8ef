"""Queries over several years of orders as a ledger: series, budgets, balances, trends, splits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.functions import clock
from pursebook.functions.keys import row_id
from pursebook.operators import balances, budgets, bulk, categorize, edits, filters, merchants, parsing, reconcile, recurring, splits, trends, views
from pursebook.plans import sync
from pursebook.plans.ledger_queries import _sms as sms
from pursebook.sources import adapters as src
from pursebook.streaming import ingest

TODAY = date.fromisoformat(src.BOOK_TODAY)


def recurring_series(spark: SparkSession, d: str) -> DataFrame:
    return recurring.recurring_series(src.book(spark, d))


def budget_report(spark, d):
    return budgets.report(views.monthly_spend(src.book(spark, d)), src.budgets(spark, d), TODAY)


def balances_at_month_ends(spark, d):
    rows = src.balance_chain(src.book(spark, d))
    return balances.at_instants(rows, balances.month_ends(rows))


def balances_now(spark, d):
    rows = src.balance_chain(src.book(spark, d))
    return balances.at_instants(rows, rows.select("account_id", F.lit(src.BOOK_TODAY).cast("timestamp_ntz").alias("instant")).distinct())


def cumulative_burn(spark, d):
    return trends.cumulative_burn(src.book(spark, d), TODAY)


def category_changes(spark, d):
    return trends.category_changes(views.monthly_spend(src.book(spark, d)), src.categories(spark, d), TODAY)


def _split(spark, d):
    return splits.with_splits(src.book(spark, d), src.split_parts(spark, d))


def split_transactions(spark, d):
    return _split(spark, d).select("id", "part_no", "category_id", "amount_paisa")


def split_monthly_spend(spark, d):
    return views.monthly_spend(_split(spark, d))


def split_violations(spark, d):
    """The constraint over the whole table, and over one from which parts were lost."""
    whole, split = src.book(spark, d), _split(spark, d)
    lost = splits.unbalanced(whole, split.where("coalesce(part_no, 0) <> 6"))
    return splits.unbalanced(whole, split).withColumn("of", F.lit("all")).unionByName(lost.withColumn("of", F.lit("lost")))


def top_merchants(spark, d):
    return merchants.top_merchants(src.sales(spark, d), counters=64)


def rule_match_bulk(spark, d):
    found = bulk.match_descriptions(src.transactions(spark, d), src.rules(spark))
    return found.select("id", "rule.rule_id", F.col("rule.category_id").alias("rule_category"))


def implied_rules(spark, d):
    changed = src.transactions(spark, d).where("id % 2 = 0").withColumn("new_category_id", F.when(F.col("id") % 5 != 0, (F.col("id") % 12).cast("int")))
    return bulk.implied_rules(changed, src.rules(spark)).drop("pattern")


def saved_filter_counts(spark, d):
    saved = src.saved_filters(spark, d)
    return saved.select("id", filters.active_count(saved).alias("active"))


def edited_supplier_rules(spark, d):
    customers = src.table(spark, d, "customer")
    updates = customers.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("pattern"), F.col("c_nationkey").alias("category_id"), F.lit(None).cast("int").alias("priority"))
    return edits.edit_rules(src.supplier_rules(spark, d), updates, customers.where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("id")))


def repointed_supplier_rules(spark, d):
    moves = src.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("pattern"), (F.col("n_regionkey") + 100).alias("category_id"))
    return categorize.repoint_rules(src.supplier_rules(spark, d), moves).select("id", "priority", "pattern", "category_id")


def span_labels_by_time(spark, d):
    """FN15 at times of day: 23 hours are no day, whatever midnight lies between."""
    at = F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate"))
    return src.table(spark, d, "orders").select("o_orderkey", clock.span_label(at, F.lit("1999-01-01 10:30:00").cast("timestamp_ntz")).alias("label"))


CURRENCIES = ("USD", "EUR", "INR", "JPY", "NPR")


def foreign_card_mails(spark, d):
    """PAR4 in any currency, routed among mails that are nobody's."""
    amount = F.format_number((F.col("amount_paisa") / 100).cast("decimal(18,2)"), 2)
    currency = F.get(F.array(*map(F.lit, CURRENCIES)), (F.col("id") % len(CURRENCIES)).cast("int"))
    text = F.concat(F.lit("Dear,\n Your Debit Card 4321XX was used at SHOP "), (F.col("id") % 9).cast("string"), F.lit("; CITY  for Purchase of "), currency, F.lit(" "), amount, F.lit(" on "), F.upper(F.date_format("occurred_at", "dd-MMM-yy")))
    mails = src.transactions(spark, d).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), F.when(F.col("id") % 4 != 0, "card-no-reply@nabilbank.com").otherwise("news@nabilbank.com").alias("from_addr"), F.lit("x").alias("subject"), text.alias("text"), F.lit("").alias("html"))
    rows, _ = parsing.mail_parsers().parse(mails)
    return rows.select("message_id", "template_key", "parser_version", "amount_paisa", "currency", "counterparty", "description_raw")


def _written(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def payment_mails(spark, d):
    """PAR6 and PAR11: wallet payments, some without a code, some whose amount cannot be read; with what became of each mail."""
    t = src.transactions(spark, d)
    cell = lambda tag, *cs: F.concat(F.lit("<tr>"), *[x for c in cs for x in (F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))], F.lit("</tr>"))
    amount = F.when(F.col("id") % 10 == 0, "as agreed").otherwise(F.concat(F.lit("Rs. "), F.format_number((F.col("amount_paisa") / 100).cast("decimal(18,2)"), 2)))
    html = F.concat(
        F.lit('Thank you for the payment<table border="1">'), cell("th", *[F.lit(x) for x in ("Transaction Date", "Transaction Amount", "Transaction Code", "Merchant Name")]),
        cell("td", F.date_format(clock.local(F.col("occurred_at")), "yyyy-MM-dd HH:mm:ss"), amount, F.concat(F.lit("P"), F.col("id").cast("string")), F.concat(F.lit("Shop "), (F.col("id") % 13).cast("string"))), F.lit("</table>"),
    )
    mails = t.select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), F.when(F.col("id") % 7 == 0, "x@example.org").otherwise("no-reply@esewa.com.np").alias("from_addr"), F.lit("x").alias("subject"), F.lit("").alias("text"), html.alias("html"))
    rows, outcomes = parsing.mail_parsers().parse(mails, keep=lambda made: _written(made, f"{ingest.shared_folder(spark, 'payments')}/rows"))
    rows = rows.withColumnRenamed("message_id", "_m").drop("template_key")
    return outcomes.join(rows, F.col("message_id") == F.col("_m"), "left").select("message_id", "status", "error", "occurred_at", "direction", "amount_paisa", "reference", "counterparty", "channel", "dedupe_key")


def events_streamed_twice(spark, d):
    """STR1, STR4, MRG7: every event as a message, streamed; then the same stream again, and one with a
    new checkpoint: (run, parsed, ledger_rows, new_rows, gaps, new_gaps).

    Two messages report one movement, the second with a balance; messages that come twice in
    the table are one."""
    folder = ingest.shared_folder(spark, "streamed")
    # A pattern, as a table that is one file cannot be the base folder of a stream.
    events = spark.readStream.schema(src.table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    none = F.lit(None).cast("string")

    def parse(batch):
        t = batch.selectExpr(*[f"{e} AS {c}" for c, e in src.TRANSACTION_COLUMNS.items()])
        return t.select(
            "user_id", F.concat(F.lit("k"), F.floor(F.col("id") / 2).cast("string")).alias("dedupe_key"), F.col("occurred_at").alias("arrival"), "id", "account_id", "occurred_at", "direction", "amount_paisa", "description_raw",
            F.when(F.col("id") % 2 == 1, F.col("id") * 7919 % 100_003).alias("balance_after_paisa"), none.alias("reference"), none.alias("counterparty"), none.alias("channel"),
        )

    shape = parse(src.table(spark, d, "events")).schema
    rows, gaps, out = None, None, []
    for run, checkpoint in enumerate(("first", "first", "fresh"), 1):
        before = set(ingest.deltas(spark, folder, {}))
        ingest.ingest(events, folder, f"{folder}-{checkpoint}", parse).awaitTermination()
        added = [f"{folder}/deltas/stream={s}/batch={n}" for s, n in set(ingest.deltas(spark, folder, {})) - before]
        parsed = spark.read.schema(shape).parquet(*added).count() if added else 0
        # Folded once: what is counted, and where gaps are looked for, is the new base.
        ingest.compact(spark, folder, shape)
        ledger = ingest.read_ledger(spark, folder, shape)
        found = _written(reconcile.record_gaps(gaps if gaps is not None else spark.createDataFrame([], GAPS), reconcile.find_gaps(ledger)), f"{folder}-gaps-{run}")
        now = (ledger.count(), found.count())
        out.append((run, parsed, now[0], now[0] - (rows or (0, 0))[0], now[1], now[1] - (rows or (0, 0))[1]))
        rows, gaps = now, found
    return spark.createDataFrame(out, "run int, parsed long, ledger_rows long, new_rows long, gaps long, new_gaps long")


GAPS = "account_id long, after_txn_id long, before_txn_id long, missing_paisa long, resolved boolean, resolved_by string"

def synced_twice(spark, d):
    """ORC1, STR4: the whole run over SMS and mails made of the events, and the same run again:
    (run, transactions, new_transactions, changed, accounts, gaps, new_gaps, rejected, balances)."""
    t = src.transactions(spark, d)
    amount = F.format_number((F.col("amount_paisa") / 100).cast("decimal(18,2)"), 2)
    cell = lambda tag, *cs: F.concat(F.lit("<tr>"), *[x for c in cs for x in (F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))], F.lit("</tr>"))
    html = F.concat(
        F.lit('<p>Transaction Alert</p><table border="1">'), cell("th", *[F.lit(x) for x in ("Transaction Date", "Transaction Type", "Transaction Amount", "Available Balance", "Remarks")]),
        cell("td", F.date_format(clock.local(F.col("occurred_at")), "yyyy-MM-dd HH:mm"), F.initcap("direction"), amount, F.lit("1,000.50"), F.col("description_raw")), F.lit("</table>"),
    )
    mails = t.where("account_id = 2 AND id % 3 > 0").select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), F.lit("alert@nabilbank.com").alias("from_addr"), F.lit("x").alias("subject"), F.lit("Transaction Alert").alias("text"), html.alias("html"))
    parsed = sync.parse_messages(sms(spark, d).drop("id"))[0].unionByName(sync.parse_mails(mails, "00134502")[0])
    empty = lambda ddl: spark.createDataFrame([], ddl)
    rules = src.rules(spark).withColumn("category_id", F.col("category_id").cast("string"))
    ledger, out = sync.Ledger(empty(sync.TXN_DDL), empty(sync.ACCOUNT_DDL), empty(sync.GAP_DDL), rules), []
    folder, count = ingest.shared_folder(spark, "synced"), lambda df: df.count()
    written = lambda df, name: _written(df, f"{folder}/{name}")

    def marks(df):
        """128-bit fingerprints of the id and of the whole row, columns in their order."""
        digest = lambda *cs: F.substring(F.unhex(row_id(*map(F.col, cs))), 1, 16)
        return df.select(digest("id").alias("id"), digest(*sync.TXN).alias("row"))

    parsed = written(parsed, "parsed")
    for run in (1, 2):
        made = sync.sync(ledger, parsed, "u", f"2026-01-0{run}", keep=lambda df, name: written(df, f"{name}-{run}"))  # noqa: B023
        now = sync.Ledger(*(written(getattr(made, name), f"{name}-{run}") for name in ("transactions", "accounts", "gaps")), rules)
        changed = marks(now.transactions).exceptAll(marks(ledger.transactions)).join(marks(ledger.transactions).select("id"), "id", "left_semi")
        new = [count(a) - count(b) for a, b in ((now.transactions, ledger.transactions), (now.gaps, ledger.gaps))]
        out.append((run, count(now.transactions), new[0], count(changed), count(now.accounts), count(now.gaps), new[1], count(made.rejected), count(now.transactions.where("balance_after_paisa is not null"))))
        ledger = now
    return spark.createDataFrame(out, "run int, transactions long, new_transactions long, changed long, accounts long, gaps long, new_gaps long, rejected long, balances long")


QUERIES = {
    f.__name__: f
    for f in (
        recurring_series, budget_report, balances_at_month_ends, balances_now, cumulative_burn, category_changes, split_transactions, split_monthly_spend, split_violations, top_merchants, rule_match_bulk, implied_rules,
        saved_filter_counts, edited_supplier_rules, repointed_supplier_rules, span_labels_by_time, foreign_card_mails, payment_mails, events_streamed_twice, synced_twice,
    )
}
