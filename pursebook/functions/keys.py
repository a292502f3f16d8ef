"""Deterministic keys: masks, fingerprints, dedupe keys, content hashes (FN4-FN9, FN24)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINGERPRINT_CHARS = 18


def canonical_mask(mask: Column) -> Column:
    """First three and last five digits where there are at least eight; else unchanged."""
    digits = F.regexp_replace(mask, r"[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.concat(F.substring(digits, 1, 3), F.right(digits, F.lit(5)))).otherwise(mask)


def remark_fingerprint(remarks: Column) -> Column:
    """8 hex digits of the letters and digits among the first 18 characters."""
    head = F.regexp_replace(F.upper(F.substring(remarks, 1, FINGERPRINT_CHARS)), "[^A-Z0-9]", "")
    return F.substring(F.sha2(head, 256), 1, 8)


def account_key(mask: Column, local_time: Column, direction: Column, amount: Column, remarks: Column) -> Column:
    minute = F.date_format(local_time, "yyyy-MM-dd'T'HH:mm")
    return F.concat_ws(":", F.lit("nabil"), F.coalesce(canonical_mask(mask), F.lit("")), minute, direction, amount.cast("string"), remark_fingerprint(remarks))


def card_key(mask: Column, local_time: Column, amount: Column, description: Column) -> Column:
    return F.concat_ws(":", F.lit("nabil"), mask, F.date_format(local_time, "yyyy-MM-dd"), F.lit("DEBIT"), amount.cast("string"), F.substring(F.sha1(description), 1, 8))


def manual_key(*parts: Column) -> Column:
    return F.concat(F.lit("manual:"), F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def content_hash(sender: Column, epoch_millis: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", sender, epoch_millis.cast("string"), body), 256)


def archive_path(message_id: Column, received_at: Column) -> Column:
    return F.concat(F.date_format(received_at, "yyyy/MM/"), F.sha2(message_id, 256), F.lit(".eml"))


def row_id(*parts: Column) -> Column:
    """A stable id from natural keys; random ids would break recomputation."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-#&~\s])", r"\\$1")
