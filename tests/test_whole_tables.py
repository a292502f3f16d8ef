"""Queries over whole tables, on tables that are larger than any fixed range of ids."""

import glob
import os
from datetime import date, datetime

import duckdb
import pytest

from pursebook.plans import ledger_queries
from pursebook.plans.catalog import oracle_sql, queries
from tests.test_parity import plain

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def from_sql(name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    return sorted(repr([plain(v) for _, v in sorted(zip(names, r))]) for r in cur.fetchall())


def from_spark(df):
    return sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("name", ["all_heatmap_days", "all_day_sections", "all_retention_candidates", "all_status_counts", "all_message_issues", "all_run_summary"])
def test_parity_beyond_the_first_ids(spark, name):
    assert from_spark(queries()[name](spark, DATA)) == from_sql(name)


def test_every_event_is_a_message(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    ids = [r.event_id for r in events.select("event_id").collect()]
    bad = {i for i in ids if i % 17 == 0 or i % 19 == 0}
    run = lambda name: queries()[name](spark, DATA).collect()
    assert max(ids) >= 5000 and sum(r.n for r in run("all_status_counts")) == sum(r.fetched for r in run("all_run_summary")) == len(ids)
    assert sum(r.txns for r in run("all_run_summary")) == len(ids) - len(bad)
    assert {r.message_id for r in run("all_message_issues")} == bad
    old = {r.event_id for r in events.where("ts < timestamp_ntz'2024-01-09'").collect()}
    assert {r.message_id for r in run("all_retention_candidates")} == {i for i in old - bad if i % 2 == 0 or i % 3 == 2}


def test_day_sections_of_every_user(spark):
    users = {r.user_id for r in queries()["monthly_spend"](spark, DATA).collect()}
    rows = queries()["all_day_sections"](spark, DATA).collect()
    assert {r.user_id for r in rows} == users and len(users) > 1
    assert sum(r.n for r in rows) == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_gap_spans_of_every_neighbour_and_user(spark):
    at = lambda day: datetime(2024, 1, day, 6)
    rows = [(2, 7, "u0", at(1), "CREDIT", 5, 100), (3, 7, "u0", at(4), "CREDIT", 5, 105), (4, 7, "u0", at(9), "DEBIT", 5, 300), (5, 8, "u2", at(2), "CREDIT", 5, 50), (6, 8, "u2", at(6), "DEBIT", 5, 50)]
    chain = spark.createDataFrame(rows, "id long, account_id long, user_id string, occurred_at timestamp_ntz, direction string, amount_paisa long, balance_after_paisa long")
    accounts = spark.createDataFrame([(7, "a"), (8, "b")], "id long, display_name string")
    got = sorted(map(tuple, ledger_queries._gap_spans(chain, accounts, chain).collect()))
    assert got == [("u0", date(2024, 1, 4), date(2024, 1, 9)), ("u2", date(2024, 1, 2), date(2024, 1, 6))]
