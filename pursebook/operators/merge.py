"""Upserts, insert-ignore, survivor choice and the merge fold (SNK1-SNK6, MRG1-MRG7, WIN2-WIN4, AG12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.functions.clock import local
from pursebook.functions.keys import account_key, canonical_mask, row_id
from pursebook.functions.remarks import strip_advert

KEY = ("user_id", "dedupe_key")
FILLED = ("balance_after_paisa", "reference", "counterparty", "channel")


def first_non_null(column: str, order: Column) -> Column:
    return F.min_by(column, F.when(F.col(column).isNotNull(), order))


def extended_description(arrivals: Column) -> Column:
    """Fold over (order, text): a later text replaces the current one only if it extends it."""
    texts = F.transform(F.array_sort(arrivals), lambda x: x["text"])
    return F.aggregate(texts, F.lit(None).cast("string"), lambda acc, t: F.when(acc.isNull() | t.startswith(acc), t).otherwise(acc))


def extension_of(kept: Column, other: Column) -> Column:
    return F.when((F.length(other) > F.length(kept)) & other.startswith(kept), other).otherwise(kept)


def upsert(existing: DataFrame, incoming: DataFrame, order: tuple[str, ...] = ("arrival", "id")) -> DataFrame:
    """One row per key: the first arrival, blanks filled and its description extended by
    later ones; all else is kept.

    Rows are first combined by key and description, then by key: two shuffles, the second of
    what the first has left.  Only the distinct descriptions of a key are gathered, in order of first arrival."""
    rows = existing.unionByName(incoming)
    at = F.struct(*order)
    once = rows.groupBy(*KEY, "description_raw").agg(
        F.min(at).alias("at"), *[F.min(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))).alias(c) for c in FILLED],
        F.min_by(F.struct(*[c for c in rows.columns if c not in (*KEY, "description_raw", *FILLED)]), at).alias("first"),
    )
    folded = once.groupBy(*KEY).agg(
        extended_description(F.collect_list(F.struct(F.col("at"), F.col("description_raw").alias("text")))).alias("description_raw"),
        *[F.min(c)["v"].alias(c) for c in FILLED],
        F.min_by("first", "at").alias("first"),
    )
    return folded.select(*KEY, "description_raw", *FILLED, "first.*").select(*rows.columns)


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The incoming rows that are new: keys unknown so far, the first row of each."""
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*[c for c in incoming.columns if c not in key]), F.struct(*order)).alias("r")).select(*key, "r.*")
    return first.join(existing.select(*key).distinct(), list(key), "left_anti").select(*incoming.columns)


def last_writer(rows: DataFrame, key: str, order: str, kept_from_first: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of a key; some columns stay as they first arrived."""
    other = [c for c in rows.columns if c not in (key, *kept_from_first)]
    out = rows.groupBy(key).agg(F.max_by(F.struct(*other), order).alias("r"), *[F.min_by(c, order).alias(c) for c in kept_from_first])
    return out.select(key, "r.*", *kept_from_first).select(*rows.columns)


def get_or_create_accounts(known: DataFrame, keys: DataFrame) -> DataFrame:
    """Known accounts and new ones for unseen (user, institution, mask); ids follow from keys."""
    wanted = keys.select("user_id", "institution", F.coalesce("mask", F.lit("")).alias("mask")).distinct()
    new = wanted.join(known, ["user_id", "institution", "mask"], "left_anti")
    new = new.withColumns({"id": row_id(F.lit("account"), F.col("user_id"), F.col("institution"), F.col("mask")), "display_name": F.trim(F.concat_ws(" ", "institution", "mask"))})
    return known.unionByName(new, allowMissingColumns=True)


def survivor_rank(rows: DataFrame, key: str = "new_key") -> DataFrame:
    """1 for the row that stays: with a balance first, then the oldest, then the smallest id."""
    order = W.partitionBy("user_id", key).orderBy(F.col("balance_after_paisa").isNull(), "created_at", "id")
    return rows.withColumn("rank", F.row_number().over(order))


def survivor_category(rows: DataFrame, key: str = "new_key") -> DataFrame:
    """Category, source and confidence of one row: the oldest that has a category."""
    has = F.col("category_id").isNotNull()
    return rows.where(has).groupBy("user_id", key).agg(F.min_by(F.struct("category_id", "category_source"), F.struct("created_at", "id")).alias("c")).select("user_id", key, "c.*")


def merge_fold(rows: DataFrame, key: str = "new_key") -> DataFrame:
    """What the rows of a key amount to together; the longest description counts only where
    it goes on from that of the row that stays."""
    at = F.struct("created_at", "id")
    keep = F.struct(F.col("balance_after_paisa").isNull(), F.col("created_at"), F.col("id"))
    return rows.groupBy("user_id", key).agg(
        F.count("*").alias("n"),
        F.min_by("id", keep).alias("keep_id"),
        F.max("balance_after_paisa").alias("balance_after_paisa"),
        first_non_null("counterparty", at).alias("counterparty"),
        first_non_null("user_note", at).alias("user_note"),
        first_non_null("transfer_group_id", at).alias("transfer_group_id"),
        F.bool_or("excluded_from_spend").alias("excluded_from_spend"),
        F.bool_or(F.col("status") == "CONFIRMED").alias("confirmed"),
        F.min_by("description_raw", keep).alias("kept_text"),
        F.max_by("description_raw", F.struct(F.length("description_raw"), F.col("description_raw"))).alias("longest_text"),
    ).withColumn("description_raw", extension_of(F.col("kept_text"), F.col("longest_text"))).drop("kept_text", "longest_text")


def account_survivors(accounts: DataFrame) -> DataFrame:
    """(id, canon, keep_id): accounts whose masks mean the same; the canonical spelling wins, then the id.
    Accounts of different users or kinds, where these are known, stay apart."""
    canon = accounts.withColumn("canon", canonical_mask(F.col("mask")))
    by = [c for c in ("user_id", "kind") if c in accounts.columns] + ["institution", "canon"]
    keep = F.min_by("id", F.struct((F.col("mask") != F.col("canon")).alias("x"), F.col("id")))
    groups = canon.groupBy(*by).agg(keep.alias("keep_id")).select(F.struct(*by).alias("_g"), "keep_id")
    return canon.withColumn("_g", F.struct(*by)).join(groups, "_g").select("id", "canon", "keep_id")


def repoint_gaps(gaps: DataFrame, moved: DataFrame) -> DataFrame:
    """Gaps over merged rows: ends follow (old_id -> keep_id); a gap of a row with itself goes."""
    out = gaps
    for end in ("after_txn_id", "before_txn_id"):
        m = moved.select(F.col("old_id").alias(end), F.col("keep_id").alias("k"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce("k", end)).drop("k")
    return out.where("after_txn_id <> before_txn_id").dropDuplicates(["account_id", "after_txn_id", "before_txn_id"])


#: The bank whose accounts were written in two ways and whose rows two transports report.
MERGED = "NABIL"


def rekeyed(rows: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows under surviving accounts with ``new_key``, surviving accounts): adverts leave the
    descriptions unless nothing else is in them, masks that mean the same become one account, keys
    are made anew.  Accounts and rows of other institutions stay as they are."""
    own = F.col("institution") == MERGED
    moved = account_survivors(accounts.where(own))
    canon = accounts.withColumn("mask", F.when(own, canonical_mask(F.col("mask"))).otherwise(F.col("mask")))
    kept = canon.join(moved.where("id <> keep_id").select("id"), "id", "left_anti")
    old = rows.join(moved.select(F.col("id").alias("account_id"), F.col("canon").alias("_mask"), "keep_id", F.lit(True).alias("_own")), "account_id", "left")
    text = strip_advert(F.col("description_raw"))
    text = F.when(F.col("_own") & (F.length(text) > 0), text).otherwise(F.col("description_raw"))
    clean = old.withColumns({"description_raw": text, "account_id": F.coalesce("keep_id", "account_id")})
    key = account_key(F.col("_mask"), local(F.col("occurred_at")), F.col("direction"), F.col("amount_paisa"), F.col("description_raw"))
    return clean.withColumn("new_key", F.when(F.col("_own"), key).otherwise(F.col("dedupe_key"))).drop("keep_id", "_mask", "_own"), kept


def merge_transactions(rows: DataFrame, accounts: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole merge (MRG4): (transactions, accounts, gaps) after rows that mean the same
    transaction have become one.

    The row that stays (``survivor_rank``) keeps what it has, takes what it lacks from the
    others and the oldest category if it has none; the others go; gaps follow, to the surviving
    accounts too.  Rows are sent by key once: their rank and all that is folded into the
    first of a key come out of the same partitions."""
    keyed, kept_accounts = rekeyed(rows, accounts)
    by = ["user_id", "new_key"]
    first, at = F.col("rank") == 1, F.struct("created_at", "id")
    lost = lambda c: F.when(~first, F.col(c))
    ranked = survivor_rank(keyed)
    filled = [c for c in (*FILLED, "user_note", "transfer_group_id") if c in rows.columns and c != "balance_after_paisa"]
    folded = ranked.groupBy(*by).agg(
        F.max(F.when(first, F.struct(*rows.columns))).alias("_keep"),
        F.max(lost("balance_after_paisa")).alias("f_balance_after_paisa"), *[F.min_by(c, F.when(~first & F.col(c).isNotNull(), at)).alias(f"f_{c}") for c in filled],
        F.bool_or(lost("excluded_from_spend")).alias("f_excluded"), F.bool_or(F.coalesce(~first & (F.col("status") == "CONFIRMED"), F.lit(False))).alias("f_confirmed"),
        F.max_by("description_raw", F.when(~first, F.struct(F.length("description_raw"), F.col("description_raw")))).alias("f_text"),
        F.min_by(F.struct("category_id", "category_source"), F.when(~first & F.col("category_id").isNotNull(), at)).alias("f_category"),
    )
    kept = lambda c: F.col(f"_keep.{c}")
    value = {c: kept(c) for c in rows.columns}
    value |= {c: F.coalesce(kept(c), F.col(f"f_{c}")) for c in ("balance_after_paisa", *filled)}
    value |= {
        "excluded_from_spend": kept("excluded_from_spend") | F.coalesce("f_excluded", F.lit(False)), "status": F.when(F.col("f_confirmed"), "CONFIRMED").otherwise(kept("status")),
        "description_raw": F.coalesce(extension_of(kept("description_raw"), F.col("f_text")), kept("description_raw")),
        "category_id": F.coalesce(kept("category_id"), "f_category.category_id"), "category_source": F.coalesce(kept("category_source"), "f_category.category_source"), "dedupe_key": F.col("new_key"),
    }
    order = W.partitionBy(*by).orderBy(F.col("balance_after_paisa").isNull(), "created_at", "id").rowsBetween(W.unboundedPreceding, 0)
    moved = ranked.withColumn("keep_id", F.first("id").over(order)).where("rank > 1").select(F.col("id").alias("old_id"), "keep_id")
    home = account_survivors(accounts.where(F.col("institution") == MERGED)).select(F.col("id").alias("account_id"), F.col("keep_id").alias("_home"))
    at_home = gaps.join(home, "account_id", "left").withColumn("account_id", F.coalesce("_home", "account_id")).drop("_home")
    return folded.select(*(value[c].alias(c) for c in rows.columns)), kept_accounts, repoint_gaps(at_home, moved)
