"""Messages to normalised transactions (PAR1-PAR14, SRC5-SRC7, SRC12).

SMS, card mails and statement rows are parsed with built-in string functions.  HTML
tables and statement grids need a small Python step, run in Arrow batches.  Every message
ends as PARSED, FAILED with a reason, or IGNORED; none is dropped and none stops a run."""

from __future__ import annotations

import email
import email.policy
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.functions.clock import parse_local, parse_statement_date, utc_of
from pursebook.functions.keys import account_key, canonical_mask, card_key
from pursebook.functions.money import parse_subunit
from pursebook.functions.remarks import channel_of, strip_advert, wallet_channel, wallet_counterparty
from pursebook.operators.registry import Parser, Reader, Registry

#: Shapes of the messages.
NABIL_SMS = (
    r"(?is)Your\s+#?([0-9#]+)\s+has been\s+(deposited|credited|withdrawn|debited)\s+by\s+(NPR|USD)\s*([\d,]+(?:\.\d+)?)\s+on\s+"
    r"(\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2})\s*[,.]?\s*Remarks:\s*(.*?)\s*$"
)
LAXMI_SMS = r"(?is)Your #(\S+) has been (debited|credited) by NPR\s*([\d,]+\.\d{2}) on (\d{2}/\d{2}/\d{2})\.\s*Remarks:(.*?)\s*(?:-\s*Laxmi\b.*)?$"
QR_REFERENCE = r"([A-Z0-9]{6,})/([^,;]+)"
NABIL_CARD = r"(?s)Your Debit Card (\S+) was used at (.+?) for Purchase of ([A-Z]{3}) ([\d,]+\.\d{2}) on (\d{2}-[A-Z]{3}-\d{2})"
STATEMENT_SENDER = "ESEWA_STATEMENT"
STATEMENT_SUFFIX = "_STATEMENT"
WALLET_DOMAIN, LOAD_PHRASE, PAYMENT_PHRASE = "esewa.com.np", "Your fund load from bank details", "Thank you for the payment"
ACCOUNT_NUMBER = r"(?i)(?:Account\s*(?:Number|No\.?)|A/C\s*No\.?)\s*[:.]?\s*(\d{8,20})"
SHEET_HEADER = ("Reference Code", "Date Time", "Description", "Dr.", "Cr.", "Status", "Balance (NPR)", "Channel")
#: Remark lines of statements that are no transactions.
NOT_ROWS = ("opening balance", "closing balance", "total", "carried over")
EMPTY_AMOUNTS = ("", "-", "0", "0.00")


#: Columns of a normalised row.
NORMALIZED = (
    "template_key", "parser_version", "institution", "account_mask", "occurred_at", "occurred_precision", "direction", "amount_paisa", "balance_after_paisa", "currency", "reference", "description_raw", "counterparty", "channel", "message_id",
    "dedupe_key",
)


def route_sms(messages: DataFrame) -> DataFrame:
    """template_key by the first router that fits, in fixed order; null: nobody's."""
    return SMS_PARSERS.route(messages)


def route_email(mails: DataFrame) -> DataFrame:
    """mails (from_addr, subject, text, html): template_key of the first parser that fits."""
    return mail_parsers().route(mails)


def _normalized(rows: DataFrame, message_id: str, **columns: Column) -> DataFrame:
    base = {c: F.lit(None).cast(t) for c, t in (
        ("account_mask", "string"), ("balance_after_paisa", "bigint"), ("reference", "string"), ("counterparty", "string"), ("channel", "string"),
    )} | {"parser_version": F.lit(1), "currency": F.lit("NPR"), "message_id": F.col(message_id)}
    both = base | columns
    return rows.select(*[both[c].alias(c) for c in NORMALIZED])


def parse_nabil_sms(messages: DataFrame) -> DataFrame:
    g = lambda n: F.regexp_extract("body", NABIL_SMS, n)
    rows = messages.where(F.col("body").rlike(NABIL_SMS)).select(
        "content_hash", canonical_mask(g(1)).alias("mask"), F.when(F.lower(g(2)).isin("deposited", "credited"), "CREDIT").otherwise("DEBIT").alias("direction"), F.upper(g(3)).alias("currency"),
        parse_subunit(g(4)).alias("amount"), parse_local(F.regexp_replace(g(5), r"\s+", " "), "nabil.sms_alert").alias("at"), strip_advert(g(6)).alias("remarks"),
    )
    c = F.col
    return _normalized(
        rows, "content_hash", template_key=F.lit("nabil.sms_alert"), institution=F.lit("NABIL"), account_mask=c("mask"), occurred_at=utc_of(c("at")), occurred_precision=F.lit("SECOND"), direction=c("direction"),
        amount_paisa=c("amount"), currency=c("currency"), description_raw=c("remarks"), channel=channel_of(c("remarks")), dedupe_key=account_key(c("mask"), c("at"), c("direction"), c("amount"), c("remarks")),
    )


def parse_laxmi_sms(messages: DataFrame) -> DataFrame:
    g = lambda n: F.regexp_extract("body", LAXMI_SMS, n)
    text = F.trim(g(5))
    some = lambda n: F.nullif(F.trim(F.regexp_extract(text, QR_REFERENCE, n)), F.lit(""))
    rows = messages.where(F.col("body").rlike(LAXMI_SMS))
    return _normalized(
        rows, "content_hash", template_key=F.lit("laxmi.sms_alert"), institution=F.lit("LAXMI"), account_mask=g(1), occurred_at=utc_of(parse_local(g(4), "laxmi.sms_alert")), occurred_precision=F.lit("DAY"),
        direction=F.when(F.lower(g(2)) == "debited", "DEBIT").otherwise("CREDIT"), amount_paisa=parse_subunit(g(3)), reference=some(1), description_raw=text, counterparty=some(2),
        channel=F.when(F.upper(text).startswith("QR-PAY"), "QR_PAY"), dedupe_key=F.concat(F.lit("laxmi:"), F.col("content_hash")),
    )


def parse_card_mail(mails: DataFrame) -> DataFrame:
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    g = lambda n: F.regexp_extract(body, NABIL_CARD, n)
    at, text, amount = parse_local(F.initcap(g(5)), "nabil.card_txn"), F.trim(g(2)), parse_subunit(g(4))
    return _normalized(
        mails.where(body.rlike(NABIL_CARD)), "message_id", template_key=F.lit("nabil.card_txn"), institution=F.lit("NABIL"), account_mask=g(1), occurred_at=utc_of(at), occurred_precision=F.lit("DAY"), direction=F.lit("DEBIT"),
        amount_paisa=amount, currency=g(3), description_raw=text, counterparty=F.trim(F.split(text, ";")[0]), channel=F.lit("CARD_FX"), dedupe_key=card_key(g(1), at, amount, text),
    )


def parse_wallet_rows(rows: DataFrame) -> DataFrame:
    """Wallet statement rows (reference, datetime_str, description, dr, cr, balance, message_id);
    a row with both or neither of Dr. and Cr. is no transaction (see ``ambiguous_rows``)."""
    dr, cr = parse_subunit(F.col("dr")), parse_subunit(F.col("cr"))
    d = F.col("description")
    return _normalized(
        rows.where((dr > 0) != (cr > 0)), "message_id", template_key=F.lit("esewa.statement_row"), institution=F.lit("ESEWA"), occurred_at=utc_of(parse_local(F.col("datetime_str"), "esewa.statement_row")), occurred_precision=F.lit("SECOND"),
        direction=F.when(dr > 0, "DEBIT").otherwise("CREDIT"), amount_paisa=F.greatest(dr, cr), balance_after_paisa=parse_subunit(F.col("balance")), reference=F.col("reference"), description_raw=d,
        counterparty=wallet_counterparty(d), channel=wallet_channel(d), dedupe_key=F.concat(F.lit("esewa:"), F.col("reference")),
    )


def ambiguous_rows(rows: DataFrame) -> DataFrame:
    return rows.where((parse_subunit(F.col("dr")) > 0) == (parse_subunit(F.col("cr")) > 0))


def sheet_rows(grid: DataFrame) -> DataFrame:
    """Rows of a wallet statement from cells (file_id, row_no, cells): the header is found by
    its names, the data ends at a blank or a total, only completed rows count."""
    header = F.array(*[F.lit(h) for h in SHEET_HEADER])
    w = W.partitionBy("file_id")
    is_header = F.forall(header, lambda h: F.array_contains("cells", h))
    marked = grid.withColumn("head_row", F.min(F.when(is_header, F.col("row_no"))).over(w)).withColumn("head", F.min_by("cells", F.when(is_header, F.col("row_no"))).over(w))
    cell = lambda name: F.trim(F.get("cells", F.array_position("head", name).cast("int") - 1))
    body = marked.where(F.col("row_no") > F.col("head_row")).withColumn("reference", cell("Reference Code"))
    ends = F.coalesce("reference", F.lit("")).isin("", "Total")
    body = body.withColumn("stop", F.min(F.when(ends, F.col("row_no"))).over(w)).where(F.col("stop").isNull() | (F.col("row_no") < F.col("stop"))).where(cell("Status") == "COMPLETE")
    return body.select(F.col("file_id").alias("message_id"), "row_no", "reference", cell("Date Time").alias("datetime_str"), cell("Description").alias("description"), cell("Dr.").alias("dr"), cell("Cr.").alias("cr"), cell("Balance (NPR)").alias("balance"), cell("Channel").alias("channel"))


def statement_heads(texts: DataFrame) -> DataFrame:
    """(file_id, sender, text) of whole statements: institution and account number from the text."""
    low, number = F.lower("text"), F.regexp_extract("text", ACCOUNT_NUMBER, 1)
    named = F.when(low.contains("laxmi") | low.contains("sunrise"), "LAXMI").when(low.contains("nabil"), "NABIL")
    return texts.select("file_id", F.coalesce(named, F.when(F.col("sender").contains("LAXMI"), "LAXMI"), F.lit("NABIL")).alias("institution"), F.nullif(number, F.lit("")).alias("account_mask"))


def headerless_files(grid: DataFrame) -> DataFrame:
    """Files without a header row: an error, not an empty statement."""
    header = F.array(*[F.lit(h) for h in SHEET_HEADER])
    has = F.forall(header, lambda h: F.array_contains("cells", h))
    return grid.groupBy("file_id").agg(F.bool_or(has).alias("ok")).where(~F.col("ok")).select("file_id", F.lit("no header row").alias("error"))


def bank_statement_rows(grid: DataFrame) -> DataFrame:
    """Bank statement transactions from extracted tables (file_id, institution, account_mask,
    page, row_no, cells): header by keywords, columns by name and else by position."""
    w = W.partitionBy("file_id", "page")
    low = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    has = lambda cs, words: F.exists(cs, lambda c: F.lit(False) if not words else c.rlike("|".join(words)))
    head = (F.size("cells") >= 4) & has(low, ["date"]) & has(low, ["withdraw", "debit", "dr", "deposit", "credit", "cr", "amount"])
    rows = grid.withColumns({"head_row": F.min(F.when(head, F.col("row_no"))).over(w), "h": F.min_by(low, F.when(head, F.col("row_no"))).over(w)}).where(F.col("row_no") > F.col("head_row"))

    def place(pattern: str, fallback: int) -> Column:
        hits = F.filter(F.transform("h", lambda c, i: F.when(c.rlike(pattern), i)), lambda i: i.isNotNull())
        return F.coalesce(F.get(hits, 0), F.when(F.size("h") > fallback, F.lit(fallback)))

    cell = lambda at: F.trim(F.coalesce(F.get("cells", at.cast("int")), F.lit("")))
    rows = rows.select(
        "file_id", "institution", "account_mask", "page", "row_no", cell(place("date", 1)).alias("date"), cell(place("description|particular|narration|remarks", 2)).alias("text"),
        cell(place(r"withdraw|debit|^dr$|^dr\.", 3)).alias("out"), cell(place(r"deposit|credit|^cr$|^cr\.", 4)).alias("in_"), cell(place("balance", 5)).alias("balance"),
    )
    wanted = (F.col("date") != "") & ~F.lower("text").rlike("|".join(NOT_ROWS))
    taken = lambda c: ~F.col(c).isin(*EMPTY_AMOUNTS)
    at = parse_statement_date(F.col("date"))
    rows = rows.where(wanted & (taken("out") | taken("in_")) & at.isNotNull()).withColumn("nth", F.row_number().over(W.partitionBy("file_id").orderBy("page", "row_no")) - 1)
    mask = F.col("account_mask")
    canon = F.when((F.col("institution") == "NABIL") & (F.length(mask) > 8), F.concat(F.left(mask, F.lit(3)), F.right(mask, F.lit(5)))).when((F.col("institution") == "LAXMI") & (F.length(mask) > 8), F.right(mask, F.lit(8))).otherwise(mask)
    return _normalized(
        rows, "file_id", template_key=F.lit("bank.statement_row"), institution=F.col("institution"), account_mask=canon, occurred_at=utc_of(at), occurred_precision=F.lit("DAY"),
        direction=F.when(taken("out"), "DEBIT").otherwise("CREDIT"), amount_paisa=F.when(taken("out"), parse_subunit(F.col("out"))).otherwise(parse_subunit(F.col("in_"))),
        balance_after_paisa=F.when(~F.col("balance").isin("", "-"), parse_subunit(F.col("balance"))), description_raw=F.replace(F.col("text"), F.lit("\n"), F.lit(" ")),
        dedupe_key=F.concat(F.lower("institution"), F.lit("_stmt:"), F.col("file_id"), F.lit(":"), F.col("nth").cast("string")),
    )


class _Tables(HTMLParser):
    """Cells of the first table with a border."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.depth = 0
        self.done = self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "table" and (self.depth or (dict(attrs).get("border") == "1" and not self.done)):
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append([])
        elif self.depth and tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.open = True

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.done or not self.depth
        elif tag in ("td", "th"):
            self.open = False

    def handle_data(self, data):
        if self.depth and self.open and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


#: A mail whose first table with a border has only bare rows and cells without references, after text and paragraphs.
BARE_TABLE = re.compile(r'[^<]*+(?:</?p>[^<]*+)*+<table border="1">((?:\s*<tr>(?:\s*<t[dh]>[^<&]*</t[dh]>)*\s*</tr>)*)\s*</table>')
BARE_CELL = re.compile(r"<t[dh]>([^<]*)<")


def table_of(html: str) -> list[dict[str, str]]:
    """Most mails are as plain as their templates, and read by two patterns; the others are parsed."""
    if bare := BARE_TABLE.match(html or ""):
        found = [BARE_CELL.findall(r) for r in bare[1].split("</tr>")]
    else:
        reader = _Tables()
        reader.feed(html or "")
        found = reader.rows
    rows = [[" ".join(c.split()) for c in r] for r in found if r]
    return [dict(zip(rows[0], r)) for r in rows[1:] if len(r) == len(rows[0])] if rows else []


def read_mails(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) -> message_id, from_addr, subject, text, html."""

    def read(batches):
        names = ["message_id", "from_addr", "subject", "text", "html"]
        for batch in batches:
            out: list[list[str | None]] = [[] for _ in names]
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                m = email.message_from_bytes(content or b"", policy=email.policy.default)
                part = lambda kind: (b.get_content() if (b := m.get_body((kind,))) else "")  # noqa: B023,E731
                html, plain = part("html"), part("plain")
                for col, v in zip(out, (m["Message-ID"] or f"<no-message-id-{path}>", str(m["From"] or ""), str(m["Subject"] or ""), plain or re.sub(r"<[^>]+>", " ", html), html)):
                    col.append(str(v))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=names)

    return files.select("path", "content").mapInArrow(read, "message_id string, from_addr string, subject string, text string, html string")


def mail_tables(mails: DataFrame) -> DataFrame:
    """(message_id, template_key, cells): a map of header to cell for each table row."""

    def read(batches):
        for batch in batches:
            ids, keys, cells = [], [], []
            for mid, key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for row in table_of(html):
                    ids.append(mid)
                    keys.append(key)
                    cells.append(list(row.items()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.string()), pa.array(cells, pa.map_(pa.string(), pa.string()))], names=["message_id", "template_key", "cells"])

    return mails.select("message_id", "template_key", "html").mapInArrow(read, "message_id string, template_key string, cells map<string,string>")


def parse_mail_tables(tables: DataFrame, account_mask: str | None = None) -> DataFrame:
    """Bank alerts, wallet loads and wallet payments from their table rows."""
    c = lambda *names: F.coalesce(*[F.try_element_at("cells", F.lit(n)) for n in names], F.lit(None).cast("string"))
    key, mask = F.col("template_key"), F.lit(account_mask).cast("string")
    bank = key == "nabil.txn_alert"
    when_ = c("Transaction Date", "Transaction Time")
    # The one format that a text of such marks can have: a failed attempt costs an exception.
    colons = F.length(when_) - F.length(F.replace(when_, F.lit(":"), F.lit("")))
    at = F.when(when_.contains(","), parse_local(when_, "esewa.fund_load")).when(colons == 1, parse_local(when_, "nabil.txn_alert")).otherwise(parse_local(when_, "plain"))
    amount, remarks = parse_subunit(F.regexp_replace(c("Transaction Amount"), r"(?i)npr|rs\.?", "")), F.coalesce(c("Remarks"), c("Bank Name", "Merchant Name"))
    direction = F.when(bank, F.upper(c("Transaction Type"))).when(key == "esewa.fund_load", "CREDIT").otherwise("DEBIT")
    rows = tables.where(key.isin("nabil.txn_alert", "esewa.fund_load", "esewa.payment_success")).select(
        "message_id", "template_key", at.alias("at"), amount.alias("amount"), remarks.alias("remarks"), direction.alias("way"), c("Reference Code", "Transaction Code").alias("code"), c("Available Balance").alias("left"), c("Bank Name", "Merchant Name").alias("other"),
    )
    at, amount, remarks, direction, reference, other = map(F.col, ("at", "amount", "remarks", "way", "code", "other"))
    return _normalized(
        rows, "message_id", template_key=key, institution=F.when(bank, "NABIL").otherwise("ESEWA"), account_mask=F.when(bank, canonical_mask(mask)),
        occurred_at=utc_of(at), occurred_precision=F.when(bank, "MINUTE").otherwise("SECOND"), direction=direction, amount_paisa=amount, balance_after_paisa=F.when(bank, parse_subunit(F.col("left"))), reference=F.when(~bank, reference),
        description_raw=remarks, counterparty=F.when(~bank, other), channel=F.when(bank, channel_of(remarks)).when(key == "esewa.fund_load", "WALLET_LOAD").otherwise("WALLET_PAYMENT"),
        dedupe_key=F.when(bank, account_key(mask, at, direction, amount, remarks)).otherwise(F.concat(F.lit("esewa:"), reference)),
    )


def outcomes(messages: DataFrame, parsed: DataFrame, id_col: str = "content_hash") -> DataFrame:
    """(id, status, error, txn_count): PARSED, FAILED (a parser's, but no row), IGNORED (nobody's)."""
    counts = parsed.groupBy(F.col("message_id").alias(id_col)).agg(F.count("*").alias("n"), F.count_if(F.col("occurred_at").isNull() | F.col("amount_paisa").isNull()).alias("bad"))
    rows = messages.join(counts, id_col, "left")
    bad = F.col("n").isNull() | (F.col("bad") > 0)
    status = F.when(F.col("template_key").isNull(), "IGNORED").when(bad, "FAILED").otherwise("PARSED")
    error = F.when(F.col("template_key").isNull(), "no parser matched").when(bad, F.concat("template_key", F.lit(": body did not match the expected shape")))
    return rows.select(id_col, status.alias("status"), error.alias("error"), F.coalesce("n", F.lit(0)).alias("txn_count"))


def _both() -> Column:
    return F.upper(F.concat_ws(" ", "sender", "body"))


#: Staged messages: SMS from their bodies, sheets and statements from their extracted cells.
SMS_PARSERS = Registry(
    (
        Parser("nabil.sms_alert", 1, lambda: _both().contains("NABIL") & F.col("body").rlike(NABIL_SMS), Reader(parse_nabil_sms)),
        Parser("laxmi.sms_alert", 1, lambda: _both().contains("LAXMI") & F.col("body").rlike(LAXMI_SMS), Reader(parse_laxmi_sms)),
        Parser("esewa.statement_row", 1, lambda: F.col("sender") == STATEMENT_SENDER, Reader(lambda cells: parse_wallet_rows(sheet_rows(cells)), "sheets")),
        Parser("bank.statement_row", 1, lambda: F.col("sender").endswith(STATEMENT_SUFFIX), Reader(lambda cells: bank_statement_rows(cells), "statements")),
    ),
    NORMALIZED,
    outcomes,
)


def mail_parsers(account_mask: str | None = None) -> Registry:
    """Parsers of mails; bank alerts name no account, so theirs is given."""
    sender, subject = F.lower("from_addr"), F.lower("subject")
    tables = Reader(lambda mails: parse_mail_tables(mail_tables(mails), account_mask))
    return Registry(
        (
            Parser("nabil.card_txn", 1, lambda: sender.contains("card-no-reply@nabilbank.com") | subject.contains("debit and credit txn"), Reader(parse_card_mail)),
            Parser("nabil.txn_alert", 1, lambda: sender.contains("nabilbank.com") & F.col("text").contains("Transaction Alert"), tables),
            Parser("esewa.fund_load", 1, lambda: sender.contains(WALLET_DOMAIN) & F.col("html").contains(LOAD_PHRASE), tables),
            Parser("esewa.payment_success", 1, lambda: sender.contains(WALLET_DOMAIN) & F.col("html").contains(PAYMENT_PHRASE), tables),
        ),
        NORMALIZED,
        outcomes,
        "message_id",
    )
