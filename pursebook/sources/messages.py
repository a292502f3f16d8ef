"""Where messages come from and where rows go (SRC1-SRC4, SRC7-SRC11, SNK12, SNK19, MRG7).

A mailbox here is a folder of .eml files that something else fills: network access is not
the engine's business, the order, limit and watermark rules are."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.functions.keys import archive_path, content_hash

SMS_OVERLAP, SMS_FIRST = "INTERVAL '6' HOUR", "INTERVAL '90' DAY"
PENDING_BATCH = 500


@dataclass(frozen=True)
class Config:
    user_id: str
    account_start: datetime
    archive_dir: str = "archive"
    senders: tuple[str, ...] = ()


def load_config(home: str, env: dict | None = None) -> Config:
    """config.toml under ``home``; PURSEBOOK_* variables win; user_id and account_start are required."""
    env = dict(os.environ if env is None else env)
    path = os.path.join(home, "config.toml")
    raw = {}
    if os.path.exists(path):
        with open(path, "rb") as f:
            raw = tomllib.load(f)
    get = lambda k, d=None: env.get(f"PURSEBOOK_{k.upper()}", raw.get(k, d))
    missing = [k for k in ("user_id", "account_start") if not get(k)]
    if missing:
        raise ValueError(f"config lacks {', '.join(missing)}")
    start = datetime.fromisoformat(str(get("account_start"))).replace(tzinfo=timezone.utc)
    senders = get("senders", ())
    return Config(str(get("user_id")), start, str(get("archive_dir", "archive")), tuple(senders.split(",") if isinstance(senders, str) else senders))


def mail_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(folder)


def fetch_since(mails: DataFrame, since: Column, senders: list[str], limit: int | None = None) -> DataFrame:
    """Mails of the senders from the day of ``since`` on, newest first, senders in their
    order; the limit is shared, so early senders may use it up."""
    place = F.array_position(F.array(*[F.lit(s) for s in senders]), F.lower("from_addr"))
    rows = mails.where(F.col("received_at") >= F.date_trunc("day", since)).withColumn("sender_order", place).where("sender_order > 0")
    ordered = rows.orderBy("sender_order", F.desc("received_at"), "message_id")
    return ordered.limit(limit) if limit is not None else ordered


def count_since(mails: DataFrame, since: Column, senders: list[str]) -> DataFrame:
    """Messages by sender, and in total (sender null)."""
    rows = mails.where(F.col("received_at") >= F.date_trunc("day", since)).where(F.lower("from_addr").isin(*senders))
    return rows.rollup(F.lower("from_addr").alias("sender")).agg(F.count("*").alias("n"))


def truncated(n_rows: Column, limit: int) -> Column:
    return n_rows >= limit


def pending(messages: DataFrame, limit: int = PENDING_BATCH) -> DataFrame:
    return messages.where("status = 'PENDING'").orderBy("received_at", "content_hash").limit(limit)


def scan_sms(inbox: DataFrame, since: Column, tokens: list[str]) -> DataFrame:
    """Messages after ``since`` from senders that hold any token, oldest first."""
    complete = inbox.dropna(subset=["sender", "body", "received_at"]).where(F.col("received_at") > since)
    wanted = F.exists(F.array(*[F.lit(t.lower()) for t in tokens]), lambda t: F.contains(F.lower("sender"), t))
    hashed = complete.where(wanted).withColumn("content_hash", content_hash(F.col("sender"), F.unix_millis(F.col("received_at").cast("timestamp")), F.col("body")))
    return hashed.orderBy("received_at", "content_hash")


def sms_watermark(uploaded: DataFrame, now: Column, full_rescan: bool = False) -> DataFrame:
    """One row (since): a little before the newest upload, or the first window, or ever."""
    if full_rescan:
        return uploaded.sparkSession.range(1).select(F.lit("1970-01-01").cast("timestamp_ntz").alias("since"))
    newest = F.max(F.col("received_at")) - F.expr(SMS_OVERLAP)
    return uploaded.where("channel = 'SMS'").agg(F.coalesce(newest, now - F.expr(SMS_FIRST)).alias("since"))


def file_message(files: DataFrame, sender: Column) -> DataFrame:
    """A staged row for each file: base64 body, hash of the bytes."""
    return files.select(sender.alias("sender"), F.base64("content").alias("body"), F.sha2("content", 256).alias("content_hash"), F.lit("PENDING").alias("status"))


def file_bytes(messages: DataFrame) -> DataFrame:
    return messages.withColumn("content", F.unbase64("body"))


def statement_sender(file_name: Column, bank: str = "AUTO") -> Column:
    if bank != "AUTO":
        return F.lit(f"{bank.upper()}_STATEMENT")
    name = F.lower(file_name)
    return F.when(name.contains("laxmi") | name.contains("sunrise"), "LAXMI_STATEMENT").when(name.contains("nabil"), "NABIL_STATEMENT").otherwise("BANK_STATEMENT")


def dedupe_messages(messages: DataFrame, key: str, order: str) -> DataFrame:
    rank = W.partitionBy(key).orderBy(order)
    return messages.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def archive(mails: DataFrame, folder: str) -> None:
    """Raw mail by month; the path within follows from id and date."""
    rows = mails.withColumns({"year": F.year("received_at"), "month": F.month("received_at"), "path": archive_path(F.col("message_id"), F.col("received_at"))})
    rows.write.mode("append").partitionBy("year", "month").parquet(folder)
