"""Run log, message marks, manual entries, rule edits (SNK7-SNK9, SNK16-SNK18, FN8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.keys import manual_key, row_id
from pursebook.operators.merge import insert_ignore
from pursebook.operators.reconcile import GAP_KEY

NOTE_LIMIT = 500


def replace_by_key(table: DataFrame, newer: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of ``newer`` in place of those with the same key, and the rest as it is."""
    return table.join(newer.select(*key).distinct(), list(key), "left_anti").unionByName(newer, allowMissingColumns=True)


def start_run(runs: DataFrame, run_id: str, user_id: str, machine: str, started_at: Column, since: Column) -> DataFrame:
    row = runs.sparkSession.range(1).select(F.lit(run_id).alias("id"), F.lit(user_id).alias("user_id"), F.lit(machine).alias("machine"), started_at.alias("started_at"), since.alias("since"))
    return replace_by_key(runs, row, ("id",))


def finish_run(runs: DataFrame, run_id: str, counts: DataFrame, completed_at: Column, error: str | None = None) -> DataFrame:
    """counts: one row (fetched, parsed, failed, txns_inserted); an error keeps its text."""
    c = counts.select(*[F.col(x).cast("int").alias(f"_{x}") for x in ("fetched", "parsed", "failed", "txns_inserted")])
    mine = runs.where(F.col("id") == run_id).crossJoin(F.broadcast(c.limit(1)))
    done = mine.withColumns({x: F.col(f"_{x}") for x in ("fetched", "parsed", "failed", "txns_inserted")} | {"completed_at": completed_at, "error": F.lit(error).cast("string")})
    return replace_by_key(runs, done.select(*runs.columns), ("id",))


def mark_messages(messages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """raw_messages with status, error and count of what parsing made of them."""
    o = outcomes.select("content_hash", F.col("status").alias("s"), F.col("error").alias("e"), F.col("txn_count").alias("n"))
    return messages.join(o, "content_hash", "left").withColumns({"status": F.coalesce("s", "status"), "error": F.when(F.col("s").isNotNull(), F.col("e")).otherwise(F.col("error")), "txn_count": F.coalesce("n", "txn_count")}).drop("s", "e", "n")


def apply_decisions(txns: DataFrame, decisions: DataFrame) -> DataFrame:
    """Categorisation results written back by id; the spend flag is not among them."""
    d = decisions.select("id", F.col("category_id").alias("c"), F.col("category_source").alias("s"), F.col("confidence").alias("f"), F.col("status").alias("t"), F.lit(True).alias("hit"))
    take = lambda new, old: F.when(F.col("hit"), F.col(new)).otherwise(F.col(old))
    return txns.join(d, "id", "left").withColumns({
        "category_id": take("c", "category_id"), "category_source": take("s", "category_source"),
        "category_confidence": F.when(F.col("hit"), F.col("f").cast("decimal(4,3)")).otherwise(F.col("category_confidence")), "status": take("t", "status"),
    }).drop("c", "s", "f", "t", "hit")


def draft_fault() -> Column:
    """Why a draft cannot become a transaction, or null."""
    return (
        F.when(~F.coalesce(F.col("amount_paisa") > 0, F.lit(False)), "amount is not positive")
        .when(~F.coalesce(F.col("direction").isin("DEBIT", "CREDIT"), F.lit(False)), "direction is neither DEBIT nor CREDIT")
        .when(F.length(F.trim("note")) > NOTE_LIMIT, f"note is longer than {NOTE_LIMIT} characters")
    )


def rejected_drafts(drafts: DataFrame) -> DataFrame:
    """The drafts that ``manual_entries`` leaves out, each with its reason."""
    return drafts.withColumn("reason", draft_fault()).where("reason is not null")


def manual_entries(drafts: DataFrame) -> DataFrame:
    """Drafts (user_id, account_id, occurred_at, direction, amount_paisa, description, currency,
    balance_after_paisa, category_id, note) as transactions; see ``rejected_drafts`` for the rest."""
    note = F.nullif(F.trim("note"), F.lit(""))
    key = manual_key(F.col("account_id"), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col("direction"), F.col("amount_paisa"), F.col("currency"), F.trim("description"), note)
    return drafts.where(draft_fault().isNull()).select(
        row_id(F.lit("txn"), F.col("user_id"), key).alias("id"), "user_id", "account_id", "occurred_at", F.lit("MINUTE").alias("occurred_precision"), "direction", "amount_paisa", "balance_after_paisa", "currency",
        F.col("description").alias("description_raw"), "category_id", F.when(F.col("category_id").isNotNull(), "user").alias("category_source"), F.lit(False).alias("excluded_from_spend"),
        F.when(F.col("category_id").isNotNull(), "CATEGORIZED").otherwise("NEEDS_REVIEW").alias("status"), key.alias("dedupe_key"), F.lit(0).alias("parser_version"), note.alias("user_note"), F.lit("MANUAL").alias("entry_source"),
    )


def record_manual(txns: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transactions with the new entries, entries that were there already)."""
    entries = manual_entries(drafts)
    duplicates = entries.join(txns.select("user_id", "dedupe_key"), ["user_id", "dedupe_key"], "left_semi")
    new = insert_ignore(txns, entries, ("user_id", "dedupe_key"), ("id",))
    return txns.unionByName(new, allowMissingColumns=True), duplicates


def close_gaps(gaps: DataFrame, closed: DataFrame, at: Column) -> DataFrame:
    """Gaps that a person closes (GAP_KEY, note); those that are closed already stay as they are."""
    c = closed.select(*GAP_KEY, F.col("note").alias("n"), F.lit(True).alias("hit"))
    rows = gaps.join(c, list(GAP_KEY), "left")
    now = F.coalesce(F.col("hit"), F.lit(False)) & ~F.col("resolved")
    return rows.withColumns({"resolved_by": F.when(now, "USER").otherwise(F.col("resolved_by")), "resolved_at": F.when(now, at).otherwise(F.col("resolved_at")), "resolution_note": F.when(now, F.col("n")).otherwise(F.col("resolution_note"))}).withColumn("resolved", F.col("resolved") | now).drop("n", "hit")


def edit_rules(rules: DataFrame, updates: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rules after an edit log: updates (id, pattern?, category_id?, priority?) and deleted ids."""
    u = updates.select("id", *[F.col(c).alias(f"_{c}") for c in ("pattern", "category_id", "priority")])
    out = rules.join(deleted.select("id"), "id", "left_anti").join(u, "id", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("pattern", "category_id", "priority")}).drop("_pattern", "_category_id", "_priority")


def by_name(rows: DataFrame, column: str = "name") -> DataFrame:
    """Accounts by display name, categories by name; ids settle ties."""
    return rows.orderBy(column, "id")


def rules_by_use(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc_nulls_last("hit_count"), "id")
