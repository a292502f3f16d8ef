"""The driver's benchmark tables seen as ledger relations.

The mapping is deterministic, so that any engine derives the same ledger.  All columns
come from one scan; balances need one window per account."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: SQL text that both engines understand: the ledger's columns over ``events``.
TRANSACTION_COLUMNS = {
    "id": "event_id",
    "user_id": "concat('u', cast(user_id % 3 as string))",
    "account_id": "user_id % 10",
    "occurred_at": "ts",
    "direction": "CASE WHEN event_type IN ('signup', 'click') THEN 'CREDIT' ELSE 'DEBIT' END",
    "amount_paisa": "cast(floor(cast(value as decimal(18,2))) * 100 + 100 as bigint)",
    "currency": "CASE WHEN event_type = 'error' THEN 'USD' ELSE 'NPR' END",
    "description_raw": "CASE event_id % 12 WHEN 0 THEN 'ATM WDL POKHARA 1234' WHEN 1 THEN concat('MPAY FPQR,3247383,MEGA MART ', cast(event_id % 7 as string), ',snacks') WHEN 2 THEN concat('eSewa Load 9800000002, ', cast(event_id as string)) "
    "WHEN 3 THEN 'salary for March, 2026' WHEN 4 THEN 'C-ASBA Fee - IPO - BRAVO' WHEN 5 THEN 'NABIL BANK LTD. transfer' WHEN 6 THEN 'OPENAI *CHATGPT SUBSCR' WHEN 7 THEN 'EXAMPLE PHARMACY 50%_off (new)' "
    "WHEN 8 THEN 'ESW DLA:998' WHEN 9 THEN 'NQR-123,lunch-KHAJA GHAR NQR-9' WHEN 10 THEN 'MPAY 12,ref,rent,77' ELSE 'Paid for Esewa topup' END",
    "counterparty": "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Himal Traders' WHEN 2 THEN '' ELSE 'esewa wallet' END",
    "user_note": "CASE WHEN event_id % 50 = 0 THEN 'lunch with team' END",
    "institution": "CASE user_id % 10 % 3 WHEN 0 THEN 'NABIL' WHEN 1 THEN 'ESEWA' ELSE 'LAXMI' END",
    "category_id": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(user_id % 25 as int) END",
    "category_source": "CASE event_id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'rule' WHEN 2 THEN 'llm' END",
    "status": "CASE event_id % 3 WHEN 0 THEN 'NEEDS_REVIEW' WHEN 1 THEN 'CATEGORIZED' ELSE 'CONFIRMED' END",
    "excluded_from_spend": "event_id % 13 = 0",
    "transfer_group_id": "CASE WHEN event_id % 13 IN (0, 1) THEN event_id % 1000 END",
    "message_no": "event_id % 4000",
}
OPENING_PAISA = 100_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in TRANSACTION_COLUMNS.items()])


def balance_chain(txns: DataFrame) -> DataFrame:
    """Bank rows with the balance after each, then some rows lost and some balances blank.

    Each month of an account is summed on its own; the total of the months before is added."""
    signed = F.when(F.col("direction") == "CREDIT", F.col("amount_paisa")).otherwise(-F.col("amount_paisa"))
    # One key, which is equal to itself even where account or time is null: the window and the join share its partitions.
    piece = F.struct("account_id", F.date_trunc("month", "occurred_at").alias("month"))
    rows = txns.withColumns({"_signed": signed, "_account_piece": piece})
    totals = rows.groupBy("_account_piece").agg(F.sum("_signed").alias("_total"))
    before = W.partitionBy("_account_piece.account_id").orderBy("_account_piece.month").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("_account_piece", F.sum("_total").over(before).alias("_carried"))
    order = W.partitionBy("_account_piece").orderBy("occurred_at", "id").rowsBetween(W.unboundedPreceding, 0)
    running = rows.withColumn("_own", F.sum("_signed").over(order)).join(carried, "_account_piece")
    balance = F.coalesce(F.col("_own") + F.col("_carried"), "_own", "_carried") + OPENING_PAISA
    return running.where("id % 97 <> 0").withColumn("balance_after_paisa", F.when(F.col("id") % 5 != 0, balance)).select(*txns.columns, "balance_after_paisa")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy(F.col("account_id").alias("id")).agg(F.max("institution").alias("institution")).withColumn("display_name", F.concat_ws(" ", "institution", F.format_string("%08d", "id")))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: nations under regions; the last region does not count as spend."""
    leaves = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 100).alias("parent_id"), F.lit(None).cast("boolean").alias("is_spend"))
    groups = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent_id"), (F.col("r_regionkey") != 4).alias("is_spend"))
    return leaves.unionByName(groups)


#: Starter rules: (priority, pattern, category).  Fixed values.
RULES = (
    (10, r"^ATM WDL", 1), (20, r"^C-ASBA Fee", 2), (20, r"^CASBA allot", 3), (30, r"^salary for", 4), (40, r"eSewa Load|^ESW DLA:", 5),
    (50, r"OPENAI \*CHATGPT", 6), (60, r"EXAMPLE PHARMACY", 7), (70, r"NABIL BANK LTD\.", 8), (80, r"mega mart", 9), (90, r"MPAY", 10),
)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, pattern, c) for i, (p, pattern, c) in enumerate(RULES)], "id int, priority int, pattern string, category_id int")


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second ledger over many months: orders of customers by nation."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey", "o_orderdate AS occurred_at", "CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS direction",
        "cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) AS amount_paisa", "o_orderpriority AS description_raw",
    )
    return orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("category_id")), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")


#: SQL text that both engines understand: orders as a ledger of several years.
BOOK_COLUMNS = {
    "id": "o_orderkey",
    "user_id": "concat('u', cast(o_custkey % 5 as string))",
    "account_id": "o_custkey % 40",
    "occurred_at": "CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL '19' HOUR WHEN 1 THEN o_orderdate + INTERVAL '6' HOUR ELSE o_orderdate END",
    "direction": "CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END",
    "amount_paisa": "cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint)",
    "currency": "CASE WHEN o_orderkey % 9 = 0 THEN 'USD' ELSE 'NPR' END",
    "merchant": "CASE WHEN o_orderkey % 31 <> 0 THEN o_orderpriority END",
    "description_raw": "concat(o_orderpriority, ' order of ', cast(o_custkey % 100 as string))",
    "category_id": "CASE WHEN o_orderkey % 29 <> 0 THEN cast(o_custkey % 27 as int) END",
    "excluded_from_spend": "o_orderkey % 13 = 0",
}
#: The day on which reports over that ledger are made.
BOOK_TODAY = "2001-08-20"


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in BOOK_COLUMNS.items()])


#: Budgets that the orders stand for: some set a default from their month on, some end one, some override a month.
BUDGET_COLUMNS = {
    "id": "o_orderkey",
    "user_id": BOOK_COLUMNS["user_id"],
    "category_id": BOOK_COLUMNS["category_id"],
    "currency": "CASE WHEN o_orderkey % 7 = 0 THEN 'USD' ELSE 'NPR' END",
    "month": "CASE WHEN o_orderkey % 40 IN (3, 4, 5) THEN cast(o_orderdate as date) END",
    "valid_from": "CASE WHEN o_orderkey % 200 <> 1 THEN cast(o_orderdate as date) END",
    "limit_paisa": "CASE WHEN o_orderkey % 40 <> 2 THEN cast(floor(cast(o_totalprice as decimal(18,2)) * 20) as bigint) END",
}


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 40 IN (1, 2, 3, 4, 5)").selectExpr(*[f"{e} AS {c}" for c, e in BUDGET_COLUMNS.items()])


#: SQL text that both engines understand: how lines of an order share its amount.
PART_COLUMNS = {"txn_id": "l_orderkey", "part_no": "l_linenumber", "category_id": "cast(l_suppkey % 25 as int)", "weight": "cast(l_quantity as bigint) - 1"}


def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three orders are split over their lines; some of the lines weigh nothing."""
    return table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").selectExpr(*[f"{e} AS {c}" for c, e in PART_COLUMNS.items()])


#: SQL text that both engines understand: lines of orders as payments to very many merchants.
SALES_COLUMNS = {
    "user_id": "concat('u', cast(l_suppkey % 5 as string))",
    "occurred_at": "CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate + INTERVAL '19' HOUR ELSE l_shipdate END",
    "direction": "CASE WHEN l_returnflag = 'R' THEN 'CREDIT' ELSE 'DEBIT' END",
    "amount_paisa": "cast(floor(l_quantity) as bigint) * 100",
    "currency": "CASE WHEN l_linenumber = 2 THEN 'USD' ELSE 'NPR' END",
    "merchant": "CASE WHEN l_partkey % 17 <> 0 THEN concat('m', cast(l_partkey % 700 as string)) END",
    "excluded_from_spend": "l_linenumber = 7",
}


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in SALES_COLUMNS.items()])


#: SQL text that both engines understand: a rule for each supplier's name.
SUPPLIER_RULES = {"id": "s_suppkey", "priority": "s_nationkey", "pattern": "concat('NATION_', cast(s_nationkey as string))", "category_id": "s_nationkey"}


def supplier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {c}" for c, e in SUPPLIER_RULES.items()])


#: SQL text that both engines understand: filters that users have saved, one for each order.
SAVED_FILTERS = {
    "id": "o_orderkey", "search": "CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'x' WHEN 2 THEN '' END", "start": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END", "end": "CASE WHEN o_orderkey % 6 < 3 THEN o_orderdate END",
    "category_ids": "CASE WHEN o_orderkey % 5 = 0 THEN array(o_custkey) WHEN o_orderkey % 5 = 1 THEN array() END", "account_ids": "CASE WHEN o_orderkey % 7 = 0 THEN array(o_custkey) END", "direction": "CASE WHEN o_orderstatus = 'F' THEN 'DEBIT' END",
    "status": "CASE WHEN o_orderstatus = 'P' THEN 'CONFIRMED' END", "transfers": "CASE o_orderkey % 11 WHEN 0 THEN 'only' WHEN 1 THEN 'shown' END", "min_paisa": "CASE WHEN o_orderkey % 13 = 0 THEN 0 END", "max_paisa": "CASE WHEN o_orderkey % 26 < 13 THEN o_custkey END",
    "uncategorized_only": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 = 0 END",
}


def saved_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS `{c}`" for c, e in SAVED_FILTERS.items()])
