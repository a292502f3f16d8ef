from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pursebook.functions import clock, keys, money, remarks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,paisa", [("10,000.00", 1000000), ("1000.0", 100000), ("140000.0", 14000000), ("1.005", 100), ("1.015", 102), ("x", None), (None, None), ("", None)])
def test_parse_subunit(spark, text, paisa):
    assert one(spark, money.parse_subunit, text) == paisa


@pytest.mark.parametrize("text,paisa", [("Rs. 1,250.5", 125050), ("NPR 7", 700), ("3.333", None), ("-5", None), ("", None)])
def test_parse_paisa(spark, text, paisa):
    assert one(spark, money.parse_paisa, text) == paisa


@pytest.mark.parametrize("mask,out", [("001#####234567", "00134567"), ("001##34567", "00134567"), ("XXXX4321", "XXXX4321"), (None, None)])
def test_canonical_mask(spark, mask, out):
    assert one(spark, keys.canonical_mask, mask) == out


@pytest.mark.parametrize("remark,digest", [("salary for March, 2026 260331-10000001.1", "975f33cc"), ("C-ASBA Fee - IPO - BRAVO HYDROPOWER LIMITED", "1951e662"), ("eSewa Load 9800000002, 249135736", "90fd6946")])
def test_remark_fingerprint(spark, remark, digest):
    assert one(spark, keys.remark_fingerprint, remark) == digest


def test_card_digest(spark):
    assert one(spark, lambda c: F.substring(F.sha1(c), 1, 8), "OPENAI *CHATGPT SUBSCR; +14158799686 USA") == "b697db9a"


@pytest.mark.parametrize("template,text,when", [
    ("nabil.sms_alert", "15/09/2026 18:16:13", datetime(2026, 9, 15, 18, 16, 13)), ("laxmi.sms_alert", "11/09/26", datetime(2026, 9, 11)), ("nabil.card_txn", "18-Aug-26", datetime(2026, 8, 18)),
    ("esewa.fund_load", "31 Aug 2026, 09:45:53 AM", datetime(2026, 8, 31, 9, 45, 53)), ("nabil.txn_alert", "junk", None),
])
def test_template_dates(spark, template, text, when):
    assert one(spark, lambda c: clock.parse_local(c, template), text) == when


@pytest.mark.parametrize("text,when", [("2026-01-02", datetime(2026, 1, 2)), ("02/01/2026", datetime(2026, 1, 2)), ("02-Jan-2026", datetime(2026, 1, 2)), ("02/01/26", datetime(2026, 1, 2)), ("2026-01-02T10:00", datetime(2026, 1, 2)), ("?", None)])
def test_statement_dates(spark, text, when):
    assert one(spark, clock.parse_statement_date, text) == when


def test_local_day_differs_from_utc(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-31 18:15:00' AS x").select(clock.local_day(F.col("x")).alias("d"), clock.local_month(F.col("x")).alias("m")).first()
    assert str(row.d) == "2024-02-01" and row.m == datetime(2024, 2, 1)


def test_windows():
    now, start = datetime(2026, 9, 15, tzinfo=timezone.utc), datetime(2026, 1, 1, tzinfo=timezone.utc)
    for spec, days in (("3d", 3), ("2w", 14), ("3m", 93), ("1y", 366)):
        assert clock.parse_window(spec, account_start=start, now=now) == now - timedelta(days=days)
    assert clock.parse_window("all", account_start=start, now=now) == start
    assert clock.parse_window("2026-02-03", account_start=start, now=now) == datetime(2026, 2, 3, tzinfo=timezone.utc)
    for bad in ("0d", "x", "3q", ""):
        with pytest.raises(ValueError):
            clock.parse_window(bad, account_start=start, now=now)


def test_span_labels(spark):
    days = {0: "today", 1: "about 1 day back", 13: "about 13 days back", 14: "about 2 weeks back", 69: "about 10 weeks back", 75: "about 2 months back", 92: "about 3 months back", 399: "about 13 months back", 400: "about 1.1 years back"}
    now = F.lit("2026-09-15").cast("timestamp_ntz")
    rows = spark.createDataFrame([(n, datetime(2026, 9, 15) - timedelta(days=n)) for n in days], "n int, at timestamp_ntz").select("n", clock.span_label(F.col("at"), now).alias("x")).collect()
    assert {r.n: r.x[12:-1] for r in rows} == days
    assert next(r.x for r in rows if r.n == 92) == "2026-06-15 (about 3 months back)"


def test_every_trailing_advert_goes(spark):
    text = "paid rent" + " Activate bit.ly/x for a/c balance - Nabil Bank\nsee https://a.b/c" * 3
    rows = spark.createDataFrame([(text,), ("Activate plan of Nabil shop",), (None,), ("",)], "t string").select(remarks.strip_advert(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["paid rent", "Activate plan of Nabil shop", None, ""]


def test_labels(spark):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    ago = lambda x: clock.time_ago(t(x), t("2026-03-01 12:00:00"))
    day = lambda x: clock.day_label(F.lit(x).cast("date"), F.lit("2026-03-01").cast("date"))
    row = spark.range(1).select(ago("2026-03-01 11:59:30"), ago("2026-03-01 11:00:00"), ago("2026-02-27 12:00:00"), ago("2026-02-15 12:00:00"), ago("2025-12-01 12:00:00"), day("2026-03-01"), day("2026-02-28"), day("2026-02-25"), day("2026-02-01"), day("2025-12-31")).first()
    assert tuple(row) == ("just now", "1h ago", "2d ago", "2w ago", "3mo ago", "Today", "Yesterday", "Wednesday", "Sun 1 Feb", "Wed 31 Dec 2025")


@pytest.mark.parametrize("remark,channel", [("ATM WDL X", "ATM"), ("MPAY FPQR,1", "FONEPAY"), ("MPAY 12", "MOBILE_BANKING"), ("Salary for May", "SALARY"), ("atm wdl", None), ("ESW DLA:1", "ESEWA_LOAD")])
def test_channels(spark, remark, channel):
    assert one(spark, remarks.channel_of, remark) == channel


def test_adverts_are_stripped_to_the_end(spark):
    text = "OWCLG CHQ 22803558 Activate bit.ly/xxx for a/c balance\nDownload App: https://x.y/z\n- Nabil Bank"
    assert one(spark, remarks.strip_advert, text) == "OWCLG CHQ 22803558"


@pytest.mark.parametrize("text,label", [
    ("MPAY FPQR,3247383ChKlH,MEGA MART TINCHULI 2,Remar", "MEGA MART TINCHULI 2"), ("MPAY FPQR,1,SHOP,lunch;x", "SHOP (note: lunch)"), ("NQR-12,tea-CAFE X NQR-1", "CAFE X (note: tea)"),
    ("MPAY 1,2,rent,77", "mobile payment (rent)"), ("ESW DLA:1", "eSewa wallet load"), ("other", "other"),
])
def test_merchant_label(spark, text, label):
    assert one(spark, lambda c: remarks.merchant_label(c, F.lit(None).cast("string")), text) == label


@pytest.mark.parametrize("text,name,channel", [("Paid For Bill Split to Ram", "Ram", "WALLET_PAYMENT"), ("paid to Shop", "Shop", "WALLET_PAYMENT"), ("Fund Transferred by Sita", "Sita", "WALLET_TRANSFER"), ("Money transferred from Bank", "Bank", "WALLET_LOAD"), ("Else", None, None)])
def test_wallet_shapes(spark, text, name, channel):
    assert one(spark, remarks.wallet_counterparty, text) == name
    assert one(spark, remarks.wallet_channel, text) == channel


def test_learned_pattern_matches_its_text(spark):
    text = "A*B (c) [d] 1.5+ x|y^z$ \\q {e}?"
    assert spark.createDataFrame([(text,)], "x string").where(F.expr("1=1")).select(keys.escape_regex(F.col("x")).alias("p"), "x").selectExpr("regexp(x, p) AS ok").first().ok


def test_editable_and_format(spark):
    assert one(spark, lambda c: money.format_paisa(c, F.lit("NPR")), 123456789, "long") == "Rs. 1,234,567.89"
    assert one(spark, money.editable, 105, "long") == "1.05"
