from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pursebook.operators import bulk, categorize, parsing
from pursebook.operators.registry import Parser, Reader
from pursebook.plans import sync

SMS = "content_hash string, sender string, body string"
NABIL = "Dear Customer, Your 001##34502 has been withdrawn by NPR 1,250.00 on 03/01/2026 09:15:30, Remarks: MPAY lunch"


def read_club(messages):
    g = lambda n: F.regexp_extract("body", r"^(\w+) paid (\d+)$", n)
    columns = {c: F.lit(None).cast("string") for c in ("account_mask", "reference", "counterparty", "channel")} | {
        "template_key": F.col("template_key"), "institution": F.lit("CLUB"), "occurred_at": F.lit(datetime(2026, 1, 3)), "occurred_precision": F.lit("DAY"), "direction": F.lit("CREDIT"), "amount_paisa": F.nullif(g(2), F.lit("")).cast("long") * 100,
        "balance_after_paisa": F.lit(None).cast("long"), "currency": F.lit("NPR"), "description_raw": g(1), "message_id": F.col("content_hash"), "dedupe_key": F.concat(F.lit("club:"), F.col("content_hash")),
    }
    return messages.select(*[c.alias(n) for n, c in columns.items()])


CLUB = Parser("club.paid", 3, lambda: F.col("sender") == "CLUB", Reader(read_club))


def test_a_parser_of_ones_own(spark):
    inbox = spark.createDataFrame([("a", "NABIL_ALERT", NABIL), ("b", "CLUB", "Maya paid 40"), ("c", "CLUB", "hello"), ("d", "PROMO", "x"), ("e", None, None), ("f", "NABIL_STATEMENT", "cells")], SMS)
    mine = parsing.SMS_PARSERS.with_parser(CLUB)
    rows, outcomes = sync.parse_messages(inbox, parsers=mine)
    got = {r.message_id: (r.template_key, r.parser_version, r.institution, r.amount_paisa) for r in rows.collect()}
    assert got == {"a": ("nabil.sms_alert", 1, "NABIL", 125_000), "b": ("club.paid", 3, "CLUB", 4000), "c": ("club.paid", 3, "CLUB", None)}
    # The statement's cells were not given: it is pending and has no outcome.
    assert {r.content_hash: r.status for r in outcomes.collect()} == {"a": "PARSED", "b": "PARSED", "c": "FAILED", "d": "IGNORED", "e": "IGNORED"}
    plain, _ = sync.parse_messages(inbox)
    assert {r.message_id for r in plain.collect()} == {"a"} and len(parsing.SMS_PARSERS.parsers) == 4


def test_the_first_parser_that_fits_is_asked(spark):
    greedy = Parser("all", 1, lambda: F.col("body").isNotNull(), Reader(read_club))
    inbox = spark.createDataFrame([("a", "CLUB", "Maya paid 1"), ("b", "CLUB", None)], SMS)
    keys = lambda r: [x.template_key for x in r.route(inbox).orderBy("content_hash").collect()]
    mine = parsing.SMS_PARSERS.with_parser(CLUB)
    assert keys(mine.with_parser(greedy)) == ["club.paid", "club.paid"] and keys(mine.with_parser(greedy, first=True)) == ["all", "club.paid"]


def test_declarations_that_cannot_be(spark):
    with pytest.raises(ValueError, match="two parsers of one key: club.paid"):
        parsing.SMS_PARSERS.with_parser(CLUB).with_parser(CLUB)
    short = Parser("short", 1, lambda: F.lit(True), Reader(lambda m: read_club(m).drop("dedupe_key")))
    inbox = spark.createDataFrame([("a", "CLUB", "Maya paid 1")], SMS)
    with pytest.raises(ValueError, match="short: no column dedupe_key"):
        parsing.SMS_PARSERS.with_parser(short).parse(inbox)
    only_cells = parsing.SMS_PARSERS.__class__((parsing.SMS_PARSERS.parsers[3],), parsing.NORMALIZED, parsing.outcomes)
    with pytest.raises(ValueError, match="no parser can run"):
        only_cells.parse(inbox)


TXN = "id long, user_id string, description_raw string, category_id int, new_category_id int"


def rules(spark):
    return spark.createDataFrame([(1, 10, "tea", 5), (2, 20, "^rent", 6), (3, 30, "t", 7)], "id int, priority int, pattern string, category_id int")


def test_rules_run_once_for_each_description(spark, monkeypatch):
    monkeypatch.setattr(bulk, "HOT_SHARE", 1)
    texts = ["TEA", "rent", "other", None, "", "a tree", "tea"]
    rows = [(i, "u", "TEA" if i % 2 else texts[i % 7], None, None) for i in range(3000)]
    df, calls = spark.createDataFrame(rows, TXN).repartition(4), spark.sparkContext.accumulator(0)

    @F.udf("struct<rule_id:int,category_id:int>")
    def counted(text):
        calls.add(1)
        low = text.lower()
        return next(((i, c) for i, hit, c in ((1, "tea" in low, 5), (2, low.startswith("rent"), 6), (3, "t" in low, 7)) if hit), None)

    key = lambda r: (r.id, tuple(r.rule) if r.rule else None)
    got = sorted(map(key, bulk.match_descriptions(df, rules(spark), counted).collect()))
    # The two sides of the hot and the other descriptions each look at every distinct one.
    assert 0 < calls.value <= 2 * 6
    want = sorted(map(key, df.withColumn("rule", categorize.rule_column(rules(spark))).collect()))
    assert got == want == sorted(map(key, bulk.match_descriptions(df, rules(spark)).collect()))
    assert bulk.match_descriptions(df.where("false"), rules(spark)).count() == 0


def test_hot_descriptions_take_no_part_in_the_shuffled_join(spark):
    rows = [(i, "u", "hot tea" if i % 3 else f"x{i % 50}", None, None) for i in range(4000)]
    df = spark.createDataFrame(rows, TXN)
    out = bulk.match_descriptions(df, rules(spark))
    assert out.where("rule.rule_id = 1").count() == sum(i % 3 > 0 for i in range(4000)) and out.count() == 4000


def test_hot_rows_and_rows_without_a_description_are_not_sent(spark):
    """With broadcasts chosen by Spark switched off, as if the other descriptions were many."""
    text = F.expr("CASE id % 4 WHEN 0 THEN NULL WHEN 3 THEN concat('x', id % 50) ELSE 'hot tea' END")
    df = spark.range(0, 8000, 1, 8).select("id", F.lit("u").alias("user_id"), text.alias("description_raw"))
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        out = bulk.match_descriptions(df, rules(spark)).where("id % 4 < 3")
        moves = out.select(F.floor(F.col("id") / 1000).alias("was"), F.spark_partition_id().alias("now"), "rule").groupBy("was", "now").agg(F.count("*").alias("n"), F.count("rule.rule_id").alias("ruled")).collect()
    finally:
        spark.conf.set(key, before)
    # The rows of each of the eight partitions are still together, and apart from the others'.
    assert sorted((r.n, r.ruled) for r in moves) == [(750, 500)] * 8 and len({r.now for r in moves}) == 8


def test_one_rule_for_each_description(spark):
    edits = [(1, "u", " tea (1) ", None, 5), (2, "u", "tea (1)", 4, 8), (3, "u", "tea (1)", 8, 8), (4, "u", "rent", None, 6), (5, "w", "rent", None, 1), (6, "u", "  ", None, 1), (7, "u", None, None, 1), (8, "u", "bus", 2, None)]
    got = {(r.user_id, r.description_raw): (r.pattern, r.category_id, r.n_edits, r.n_categories, r.against_rule) for r in bulk.implied_rules(spark.createDataFrame(edits, TXN), rules(spark)).collect()}
    assert got == {("u", "tea (1)"): (r"tea\ \(1\)", 8, 2, 2, 1), ("u", "rent"): ("rent", 6, 1, 1, None), ("w", "rent"): ("rent", 1, 1, 1, 2)}
