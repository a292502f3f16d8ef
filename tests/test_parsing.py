import random
from datetime import datetime

from pyspark.sql import functions as F

from pursebook.operators import parsing
from pursebook.sources import messages

SMS = "content_hash string, sender string, body string"
NABIL = "Dear Customer, Your 001##34567 has been deposited by NPR 140000.0 on 15/09/2026 18:16:13, Remarks: OWCLG CHQ 22803558 Activate bit.ly/xxxxxxx for a/c balance"
LAXMI = "Dear Customer, Your #98765 has been debited by NPR 1,250.00 on 11/09/26. Remarks:QR-Pay,CMPAY,44700000D4T4/KK Store,Sales;Sales\n-Laxmi Sunrise"


def test_sms_templates_and_outcomes(spark):
    inbox = spark.createDataFrame([("a", "NABIL_ALERT", NABIL), ("b", "LAXMI", LAXMI), ("c", "X", "hello"), ("d", "ESEWA_STATEMENT", "AAAA")], SMS)
    routed = parsing.route_sms(inbox)
    rows = parsing.parse_nabil_sms(routed).unionByName(parsing.parse_laxmi_sms(routed))
    got = {r.message_id: r for r in rows.collect()}
    n, x = got["a"], got["b"]
    assert (n.account_mask, n.direction, n.amount_paisa, n.occurred_at, n.description_raw, n.balance_after_paisa) == ("00134567", "CREDIT", 14000000, datetime(2026, 9, 15, 12, 31, 13), "OWCLG CHQ 22803558", None)
    assert n.dedupe_key.startswith("nabil:00134567:2026-09-15T18:16:CREDIT:14000000:")
    assert (x.reference, x.counterparty, x.channel, x.amount_paisa, x.occurred_precision, x.dedupe_key) == ("44700000D4T4", "KK Store", "QR_PAY", 125000, "DAY", "laxmi:b")
    status = {r.content_hash: r.status for r in parsing.outcomes(routed, rows).collect()}
    assert status == {"a": "PARSED", "b": "PARSED", "c": "IGNORED", "d": "FAILED"}


MAIL = """From: Alerts <alert@nabilbank.com>\r\nSubject: Transaction Alert\r\nMessage-ID: <m1>\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Transaction Alert</p><table border="1"><tr><th>Transaction Date</th><th>Transaction Type</th><th>Transaction Amount</th><th>Available Balance</th><th>Remarks</th></tr>
<tr><td>2026-09-15 18:16</td><td>Credit</td><td>140,000.00</td><td>1,000.50</td><td>OWCLG CHQ 22803558</td></tr></table>"""


def test_mail_and_sms_share_a_key(spark, tmp_path):
    (tmp_path / "2026").mkdir()
    (tmp_path / "2026" / "x.eml").write_bytes(MAIL.encode())
    (tmp_path / "2026" / "y.txt").write_bytes(b"no mail")
    mails = parsing.route_email(parsing.read_mails(messages.mail_files(spark, str(tmp_path))))
    rows = parsing.parse_mail_tables(parsing.mail_tables(mails), "001#####234567").collect()
    assert len(rows) == 1
    sms = parsing.parse_nabil_sms(spark.createDataFrame([("a", "NABIL", NABIL)], SMS)).first()
    assert rows[0].dedupe_key == sms.dedupe_key and rows[0].balance_after_paisa == 100050 and rows[0].occurred_precision == "MINUTE"


def test_card_mail(spark):
    text = "Dear, Your Debit Card 4321XXXX  was used at\nOPENAI *CHATGPT SUBSCR; +14158799686 USA for Purchase of USD 20.00 on 18-AUG-26."
    r = parsing.parse_card_mail(spark.createDataFrame([("m", text)], "message_id string, text string")).first()
    assert r.dedupe_key == "nabil:4321XXXX:2026-08-18:DEBIT:2000:b697db9a" and r.counterparty == "OPENAI *CHATGPT SUBSCR" and r.currency == "USD"


def test_wallet_sheet(spark):
    head = ["Reference Code", "Date Time", "Description", "Dr.", "Cr.", "Status", "Balance (NPR)", "Channel"]
    grid = [["eSewa"], head, ["R1", "2026-01-02 10:00:00.0", "Paid to Shop", "5.00", "0", "COMPLETE", "95.00", "App"], ["R2", "2026-01-02 10:00:00.0", "x", "5.00", "5.00", "COMPLETE", "90.00", "App"],
            ["R3", "2026-01-02 10:00:00.0", "x", "5.00", "0", "PENDING", "90.00", "App"], ["Total"], ["R4", "2026-01-02 10:00:00.0", "x", "5.00", "0", "COMPLETE", "90.00", "App"]]
    df = spark.createDataFrame([("f", i, [*r, *[None] * (8 - len(r))]) for i, r in enumerate(grid)] + [("g", 0, ["nothing"])], "file_id string, row_no int, cells array<string>")
    rows = parsing.sheet_rows(df)
    assert [r.reference for r in rows.orderBy("row_no").collect()] == ["R1", "R2"]
    assert [r.reference for r in parsing.ambiguous_rows(rows).collect()] == ["R2"]
    t = parsing.parse_wallet_rows(rows).collect()
    assert [(x.dedupe_key, x.direction, x.amount_paisa, x.balance_after_paisa, x.counterparty) for x in t] == [("esewa:R1", "DEBIT", 500, 9500, "Shop")]
    assert [r.file_id for r in parsing.headerless_files(df).collect()] == ["g"]


def test_bank_statement(spark):
    grid = [["x"], ["S.N", "Txn Date", "Particulars", "Withdraw", "Deposit", "Balance"], ["", "2026-01-01", "Opening Balance", "", "", "10.00"], ["1", "02/01/2026", "ATM\nWDL", "5.00", "-", "5.00"], ["2", "03-Jan-2026", "Salary", "", "7.50", "12.50"], ["3", "junk", "x", "1.00", "", ""]]
    df = spark.createDataFrame([("f", "NABIL", "00112345678901", 0, i, r) for i, r in enumerate(grid)], "file_id string, institution string, account_mask string, page int, row_no int, cells array<string>")
    out = parsing.bank_statement_rows(df).orderBy("occurred_at").collect()
    assert [(r.direction, r.amount_paisa, r.balance_after_paisa, r.description_raw, r.account_mask, r.dedupe_key) for r in out] == [("DEBIT", 500, 500, "ATM WDL", "00178901", "nabil_stmt:f:0"), ("CREDIT", 750, 1250, "Salary", "00178901", "nabil_stmt:f:1")]


def test_statement_heads(spark):
    df = spark.createDataFrame([("f", "BANK_STATEMENT", "Laxmi Sunrise Bank A/C No.: 0123456789 x"), ("g", "LAXMI_STATEMENT", "nothing"), ("h", "X_STATEMENT", "Nabil Account Number 00112345678901")], "file_id string, sender string, text string")
    assert {tuple(r) for r in parsing.statement_heads(df).collect()} == {("f", "LAXMI", "0123456789"), ("g", "LAXMI", None), ("h", "NABIL", "00112345678901")}


def test_sources(spark):
    inbox = spark.createDataFrame([("NABIL_ALERT", "x", datetime(2026, 1, 2)), ("promo", "y", datetime(2026, 1, 3)), (None, "z", datetime(2026, 1, 3)), ("My_nabil", "w", datetime(2026, 1, 1))], "sender string, body string, received_at timestamp_ntz")
    assert [r.body for r in messages.scan_sms(inbox, F.lit("2025-12-31").cast("timestamp_ntz"), ["nabil"]).collect()] == ["w", "x"]
    up = spark.createDataFrame([("SMS", datetime(2026, 1, 2, 12)), ("FILE", datetime(2026, 2, 1))], "channel string, received_at timestamp_ntz")
    now = F.lit("2026-03-01").cast("timestamp_ntz")
    assert messages.sms_watermark(up, now).first().since == datetime(2026, 1, 2, 6)
    assert messages.sms_watermark(up.where("false"), now).first().since == datetime(2025, 12, 1)
    mails = spark.createDataFrame([("m1", "a@x", datetime(2026, 1, 1)), ("m2", "a@x", datetime(2026, 1, 2)), ("m3", "b@x", datetime(2026, 1, 3))], "message_id string, from_addr string, received_at timestamp_ntz")
    since = F.lit("2026-01-01 10:00").cast("timestamp_ntz")
    assert [r.message_id for r in messages.fetch_since(mails, since, ["a@x", "b@x"], 2).collect()] == ["m2", "m1"]
    assert {r.sender: r.n for r in messages.count_since(mails, since, ["a@x", "b@x"]).collect()} == {"a@x": 2, "b@x": 1, None: 3}


def test_config(tmp_path):
    (tmp_path / "config.toml").write_text('user_id = "u"\naccount_start = "2026-01-01"\n')
    assert messages.load_config(str(tmp_path), {}).user_id == "u"
    assert messages.load_config(str(tmp_path), {"PURSEBOOK_USER_ID": "v"}).user_id == "v"
    import pytest

    with pytest.raises(ValueError):
        messages.load_config(str(tmp_path / "none"), {})


def test_html_table_without_border_or_rows():
    assert parsing.table_of("<table><tr><td>x</td></tr></table>") == [] and parsing.table_of("") == []
    assert parsing.table_of('<table border="1"><tr><th>A<th>B</tr><tr><td>1<td>2</tr></table>') == [{"A": "1", "B": "2"}]


def parsed_table(html):
    """What the parser alone makes of a mail."""
    reader = parsing._Tables()
    reader.feed(html)
    rows = [[" ".join(c.split()) for c in r] for r in reader.rows if r]
    return [dict(zip(rows[0], r)) for r in rows[1:] if len(r) == len(rows[0])] if rows else []


def test_plain_tables_need_no_parser(monkeypatch):
    """Mails of random pieces read as the parser alone reads them; plain ones are read without it."""
    pieces = ["<p>", "</p>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", '<table border="1">', "</table>", "<table>", " a ", "b  c", "&amp;", "&", "<br>", "<!-- <tr> -->", "<TD>", "<script>", "\n", "<td class='x'>", "é<", ">"]
    rng = random.Random(7)
    cell = lambda: rng.choice(["<td>x</td>", "<th> y  z</th>", "<td></td>", "<td>1 &lt; 2</td>", "<td>a>b</th>", " <td>\n</td>", "<td><b>x</b></td>"])
    row = lambda: "<tr>" + "".join(cell() for _ in range(rng.randint(0, 3))) + "</tr>"
    for i in range(6000):
        html = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) if i % 2 else "Hi &amp <p>x</p>" + '<table border="1">' + "".join(row() for _ in range(rng.randint(0, 4))) + "</table>" + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
        assert parsing.table_of(html) == parsed_table(html), html
    monkeypatch.setattr(parsing, "_Tables", None)
    assert parsing.table_of('<p>Hi</p><table border="1"><tr><th>A</th><th>B</th></tr>\n<tr><td>1 </td><td>x  y</td></tr></table><b>') == [{"A": "1", "B": "x y"}]


def test_each_format_of_a_table_is_tried_once(spark):
    times = {"2026-01-02 10:30": datetime(2026, 1, 2, 4, 45), "2026-01-02 10:30:05": datetime(2026, 1, 2, 4, 45, 5), "2 Jan 2026, 10:30:05 PM": datetime(2026, 1, 2, 16, 45, 5), "2026-01-02": None, "1:2:3:4": None, "soon, 1": None, "": None, "2026-01-02T10:30": None}
    keys = ("nabil.txn_alert", "esewa.fund_load", "esewa.payment_success")
    rows = [(f"{i} {k}", k, {"Transaction Date": t, "Transaction Amount": "Rs. 5.00"}) for i, t in enumerate(times) for k in keys] + [("none", keys[0], {})]
    made = parsing.parse_mail_tables(spark.createDataFrame(rows, "message_id string, template_key string, cells map<string,string>"))
    want = {f"{i} {k}": t for i, t in enumerate(times.values()) for k in keys} | {"none": None}
    assert {r.message_id: r.occurred_at for r in made.collect()} == want
    assert made._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp") <= 3


def test_rows_that_are_kept_are_parsed_once(spark, tmp_path):
    def keep(made):
        made.write.parquet(str(tmp_path / "rows"))
        return spark.read.schema(made.schema).parquet(str(tmp_path / "rows"))

    table = '<p>Transaction Alert</p><table border="1"><tr><th>Transaction Date</th><th>Transaction Type</th><th>Transaction Amount</th></tr><tr><td>2026-01-02 10:30</td><td>Debit</td><td>5.00</td></tr></table>'
    mails = spark.createDataFrame([(f"m{i}", "a@nabilbank.com", "x", "Transaction Alert", table) for i in range(4)], "message_id string, from_addr string, subject string, text string, html string")
    rows, outcomes = parsing.mail_parsers("00134567").parse(mails, keep=keep)
    both = outcomes.join(rows, "message_id")
    assert sorted((r.message_id, r.status) for r in both.collect()) == [(f"m{i}", "PARSED") for i in range(4)]
    assert "MapInArrow" not in both._jdf.queryExecution().executedPlan().toString()
