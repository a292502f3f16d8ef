"""Explicit schemas, allowed values and constraint checks of the ledger tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "processed_emails": "message_id string, user_id string, received_at timestamp, from_addr string, template_key string, parser_version int, status string, error string, txn_count int, processed_at timestamp",
    "sync_runs": "id string, user_id string, machine string, started_at timestamp, completed_at timestamp, since timestamp, fetched int, parsed int, failed int, txns_inserted int, error string",
    "accounts": "id string, user_id string, kind string, institution string, mask string, display_name string, currency string",
    "categories": "id string, user_id string, name string, parent_id string, is_spend boolean",
    "transfer_groups": "id string, user_id string, confidence decimal(4,3), confirmed_by_user boolean, created_at timestamp",
    "transactions": "id string, user_id string, account_id string, source_message_id string, source_raw_message_id string, occurred_at timestamp, occurred_precision string, direction string, amount_paisa bigint, "
    "balance_after_paisa bigint, currency string, reference string, description_raw string, counterparty string, channel string, category_id string, category_source string, category_confidence decimal(4,3), "
    "transfer_group_id string, excluded_from_spend boolean, status string, dedupe_key string, parser_version int, user_note string, entry_source string, created_at timestamp",
    "merchant_rules": "id string, user_id string, pattern string, category_id string, counterparty_label string, priority int, learned_from_user boolean, hit_count int, created_at timestamp",
    "ledger_gaps": "id string, user_id string, account_id string, after_txn_id string, before_txn_id string, missing_paisa bigint, detected_at timestamp, resolved boolean, resolved_at timestamp, resolved_by string, resolution_note string",
    "raw_messages": "id string, user_id string, channel string, sender string, body string, received_at timestamp, device string, content_hash string, status string, template_key string, parser_version int, error string, txn_count int, processed_at timestamp, uploaded_at timestamp",
}

#: What a parser yields before it is stored.
NORMALIZED = (
    "template_key string, parser_version int, institution string, account_mask string, occurred_at timestamp_ntz, occurred_precision string, direction string, amount_paisa bigint, "
    "balance_after_paisa bigint, currency string, reference string, description_raw string, counterparty string, channel string, message_id string, dedupe_key string"
)

ALLOWED = {
    "kind": ("BANK", "WALLET", "CARD", "CASH"),
    "direction": ("DEBIT", "CREDIT"),
    "occurred_precision": ("SECOND", "MINUTE", "DAY"),
    "txn_status": ("NEEDS_REVIEW", "CATEGORIZED", "CONFIRMED", "PARSED"),
    "email_status": ("PARSED", "FAILED", "IGNORED"),
    "raw_status": ("PENDING", "PARSED", "FAILED", "IGNORED"),
    "entry_source": ("PARSED", "MANUAL"),
}

UNIQUE = {
    "accounts": ("user_id", "institution", "mask"),
    "categories": ("user_id", "name"),
    "transactions": ("user_id", "dedupe_key"),
    "raw_messages": ("user_id", "content_hash"),
    "ledger_gaps": ("account_id", "after_txn_id", "before_txn_id"),
    "processed_emails": ("message_id",),
}

NOTE_LIMIT = 500


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def transaction_checks() -> dict[str, Column]:
    """Name -> predicate that a valid row satisfies (null counts as satisfied)."""
    manual = F.col("entry_source") == "MANUAL"
    in_namespace = F.col("dedupe_key").startswith("manual:")
    return {
        "amount_positive": F.col("amount_paisa") > 0,
        "note_length": F.length("user_note") <= NOTE_LIMIT,
        "manual_has_no_parser": ~manual | (F.col("parser_version") == 0),
        "manual_key_namespace": manual == in_namespace,
        "direction_known": F.col("direction").isin(*ALLOWED["direction"]),
    }


def violations(rows: DataFrame, checks: dict[str, Column], key: str = "id") -> DataFrame:
    """(key, violation): one row for each check that a row breaks."""
    broken = F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()])
    return rows.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("violation"))


def duplicate_keys(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Key values that a unique constraint forbids, with how often they occur."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))
