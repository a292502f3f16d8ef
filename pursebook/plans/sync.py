"""One run over what is new: parse, fold, link, reconcile, categorise, log (ORC1, STR1-STR5).

Everything is a function of tables to tables, so a run can be repeated: the second one
inserts nothing.  Whoever calls it writes the tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.clock import local_day
from pursebook.functions.keys import row_id
from pursebook.operators import audit, categorize, merge, parsing, reconcile, transfers
from pursebook.operators.registry import Registry

STATEMENTS = ("bank.statement_row",)
TXN = (
    "id", "user_id", "account_id", "institution", "source_message_id", "occurred_at", "occurred_precision", "direction", "amount_paisa", "balance_after_paisa", "currency", "reference", "description_raw", "counterparty",
    "channel", "category_id", "category_source", "category_confidence", "transfer_group_id", "excluded_from_spend", "status", "dedupe_key", "parser_version", "user_note", "entry_source", "created_at",
)
TXN_DDL = (
    "id string, user_id string, account_id string, institution string, source_message_id string, occurred_at timestamp_ntz, occurred_precision string, direction string, amount_paisa bigint, balance_after_paisa bigint, currency string, "
    "reference string, description_raw string, counterparty string, channel string, category_id string, category_source string, category_confidence decimal(4,3), transfer_group_id string, excluded_from_spend boolean, status string, "
    "dedupe_key string, parser_version int, user_note string, entry_source string, created_at timestamp_ntz"
)
ACCOUNT_DDL = "id string, user_id string, institution string, mask string, display_name string"
GAP_DDL = "account_id string, after_txn_id string, before_txn_id string, missing_paisa bigint, resolved boolean, resolved_by string"


@dataclass
class Ledger:
    transactions: DataFrame
    accounts: DataFrame
    gaps: DataFrame
    rules: DataFrame
    #: Parsed rows that the run could not use, each with its reason.
    rejected: DataFrame | None = None


def to_transactions(parsed: DataFrame, user_id: str, accounts: DataFrame, created_at: str) -> DataFrame:
    """Parsed rows under their accounts, with ids that follow from their keys."""
    rows = parsed.withColumns({"user_id": F.lit(user_id), "mask": F.coalesce("account_mask", F.lit(""))})
    # One person's accounts are few, and most rows are of one or two of them.
    a = F.broadcast(accounts.where(F.col("user_id") == user_id).select(F.col("id").alias("account_id"), "user_id", "institution", "mask"))
    none = lambda t: F.lit(None).cast(t)
    made = rows.join(a, ["user_id", "institution", "mask"], "left").withColumns({
        "id": row_id(F.lit("txn"), F.col("user_id"), F.col("dedupe_key")), "source_message_id": F.col("message_id"), "category_id": none("string"), "category_source": none("string"), "category_confidence": none("decimal(4,3)"),
        "transfer_group_id": none("string"), "excluded_from_spend": F.lit(False), "status": F.lit("NEEDS_REVIEW"), "user_note": none("string"), "entry_source": F.lit("PARSED"), "created_at": F.lit(created_at).cast("timestamp_ntz"),
    })
    return made.select(*TXN)


def row_fault() -> Column:
    """Why a parsed row cannot become a transaction, or null."""
    return F.when(F.col("occurred_at").isNull(), "no time could be read").when(~F.coalesce(F.col("amount_paisa") > 0, F.lit(False)), "no positive amount could be read")


def sync(ledger: Ledger, parsed: DataFrame, user_id: str, now: str, look_back_days: int = transfers.LOOK_BACK_DAYS, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Ledger:
    """parsed: normalised rows of this run's messages, of all templates.

    ``keep`` (table, name) may write a table that several results read, and return what it wrote;
    without it each result folds the ledger anew.  Only the fold sends whole transactions by key:
    links concern rows within the look-back, gaps need no links, and rules decide row by row."""
    judged = parsed.withColumn("reason", row_fault())
    usable = judged.where("reason is null").drop("reason")
    accounts = merge.get_or_create_accounts(ledger.accounts, usable.select(F.lit(user_id).alias("user_id"), "institution", F.col("account_mask").alias("mask")))
    rows = to_transactions(usable, user_id, accounts, now)
    by_statement = F.split("dedupe_key", ":")[0].endswith("_stmt")
    folded = keep(merge.upsert(ledger.transactions.select(*TXN), rows.where(~by_statement), ("created_at", "occurred_at", "source_message_id")), "folded")
    lines = rows.where(by_statement).withColumn("day", local_day(F.col("occurred_at")))
    known = folded.withColumn("day", local_day(F.col("occurred_at")))
    missing = audit.missing_from(lines, known, ("account_id", "day", "amount_paisa", "direction"), ("dedupe_key",)).select(*TXN)
    txns = folded.unionByName(keep(merge.insert_ignore(folded, missing, ("user_id", "dedupe_key"), ("id",)), "added"))
    gaps = reconcile.record_gaps(ledger.gaps, reconcile.find_gaps(txns))
    recent = F.coalesce(transfers.in_look_back(F.lit(now).cast("timestamp_ntz"), look_back_days), F.lit(False))
    near = txns.where(recent)
    linked = transfers.link(near, transfers.scored(transfers.candidate_pairs(near.where("transfer_group_id is null"))))
    txns = categorize.apply_rules(linked.unionByName(txns.where(~recent)), ledger.rules).select(*TXN)
    return Ledger(txns, accounts, gaps, ledger.rules, judged.where("reason is not null"))


def parse_messages(messages: DataFrame, sheets: DataFrame | None = None, statements: DataFrame | None = None, parsers: Registry = parsing.SMS_PARSERS) -> tuple[DataFrame, DataFrame]:
    """(normalised rows, outcomes) of staged messages: SMS from their bodies, wallet sheets and
    bank statements from their extracted cells, whose file_id is the message's content hash.

    sheets: (file_id, row_no, cells); statements: (file_id, institution, account_mask, page,
    row_no, cells).  A message whose cells are not given has no outcome: it stays pending."""
    return parsers.parse(messages, sheets=sheets, statements=statements)


def parse_mails(mails: DataFrame, account_mask: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(normalised rows, outcomes) of mails (message_id, from_addr, subject, text, html)."""
    return parsing.mail_parsers(account_mask).parse(mails)


def reparse(messages: DataFrame, template: str | None = None, **cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Today's parsers over archived messages, of one template or of all (STR5, FLT18)."""
    routed = parsing.route_sms(messages)
    wanted = routed if template is None else routed.where(F.col("template_key") == template)
    rows, outcomes = parse_messages(wanted.select(*messages.columns), **cells)
    return (rows if template is None else rows.where(F.col("template_key") == template)), outcomes
