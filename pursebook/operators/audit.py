"""Statement audit, retention, run log, status counts, export (JN9, FLT9, FLT13, FLT17, AG5-AG7, AG13-AG16, SNK13, SNK15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.functions.clock import local_day
from pursebook.functions.keys import archive_path
from pursebook.functions.money import editable

RETENTION_DAYS = 365
PREVIEW_CHARS = 80


def missing_from(statement: DataFrame, ledger: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Statement lines without a ledger row of their own: a bag difference.

    Equal keys pair off one to one.  The ledger side is a count with map-side combine, so
    only the statement is ranked."""
    have = ledger.groupBy(*key).agg(F.count("*").alias("have"))
    ranked = statement.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.join(have, list(key), "left").where(F.col("nth") > F.coalesce("have", F.lit(0))).drop("nth", "have")


def audit_range(statement: DataFrame) -> DataFrame:
    return statement.groupBy("account_id").agg(F.min(local_day(F.col("occurred_at"))).alias("first_day"), F.max(local_day(F.col("occurred_at"))).alias("last_day"))


def retention_candidates(messages: DataFrame, txns: DataFrame, cutoff: Column) -> DataFrame:
    """Old parsed messages all of whose transactions are confirmed."""
    open_ = txns.where(F.col("status") != "CONFIRMED").select(F.col("message_no").alias("message_id")).distinct()
    old = messages.where((F.col("status") == "PARSED") & (F.col("txn_count") > 0) & (F.col("received_at") < cutoff))
    return old.join(open_, "message_id", "left_anti")


def expired_files(messages: DataFrame, txns: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """(message_id, path): archived files that a retention run may delete."""
    gone = retention_candidates(messages, txns, now - F.make_interval(days=F.lit(days)))
    return gone.select("message_id", archive_path(F.col("message_id").cast("string"), F.col("received_at")).alias("path"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def attention_counts(messages: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: failed messages and open gaps."""
    failed = messages.select((F.col("status") == "FAILED").alias("failed"), F.lit(False).alias("open"))
    both = failed.unionByName(gaps.select(F.lit(False).alias("failed"), (~F.col("resolved")).alias("open")))
    return both.agg(F.count_if("failed").alias("failed_messages"), F.count_if("open").alias("open_gaps"))


def earliest(txns: DataFrame) -> DataFrame:
    return txns.agg(F.min("occurred_at").alias("earliest_at"))


def issues(messages: DataFrame) -> DataFrame:
    """Failed and ignored messages with the beginning of their text."""
    text = F.col("body")
    short = F.when(F.length(text) > PREVIEW_CHARS, F.concat(F.substring(text, 1, PREVIEW_CHARS), F.lit("…"))).otherwise(text)
    return messages.where(F.col("status").isin("FAILED", "IGNORED")).withColumn("preview", short)


def run_summary(messages: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return messages.groupBy("channel").agg(F.count("*").alias("fetched"), n("PARSED").alias("parsed"), n("FAILED").alias("failed"), n("IGNORED").alias("ignored"), F.sum("txn_count").alias("txns"))


def last_runs(runs: DataFrame) -> DataFrame:
    """Three meanings of "last run": success, attempt, completion."""
    return runs.agg(
        F.max(F.when(F.col("error").isNull(), F.col("completed_at"))).alias("last_success"),
        F.max("started_at").alias("last_attempt"),
        F.max("completed_at").alias("last_completed"),
    )


def export_rows(txns: DataFrame) -> DataFrame:
    """The nine columns of the CSV export, newest first when written."""
    return txns.select(
        "id", "occurred_at", "account_name", "direction", "amount_paisa", editable(F.col("amount_paisa")).alias("amount"), "currency", "description_raw",
        F.coalesce("category_name", F.lit("")).alias("category"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Quotes where a value needs it, doubles quotes inside; one header a file."""
    rows.orderBy(F.desc("occurred_at"), F.desc("id")).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def apply_edits(txns: DataFrame, edits: DataFrame) -> DataFrame:
    """A person's edits (id, category_id?, note?, confirm?): source 'user', blanks become null."""
    e = edits.select("id", F.col("category_id").alias("c"), F.trim("note").alias("n"), F.coalesce("confirm", F.lit(False)).alias("k"), F.lit(True).alias("edited"))
    has = F.coalesce("edited", F.lit(False))
    return txns.join(e, "id", "left").withColumns({
        "category_source": F.when(F.col("c").isNotNull(), "user").otherwise(F.col("category_source")),
        "category_id": F.coalesce("c", "category_id"),
        "user_note": F.when(has & F.col("n").isNotNull(), F.nullif(F.col("n"), F.lit(""))).otherwise(F.col("user_note")),
        "status": F.when(F.coalesce("k", F.lit(False)), "CONFIRMED").when(F.col("c").isNotNull(), "CATEGORIZED").otherwise(F.col("status")),
    }).drop("c", "n", "k", "edited")
