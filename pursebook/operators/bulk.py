"""Rules over distinct descriptions, and the rules that a person's bulk edits stand for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.keys import escape_regex
from pursebook.operators.categorize import LEARNED_CHARS, rule_column

#: A description of over one row in so many is hot; there are no more hot ones than that.
HOT_SHARE = 10_000


def match_descriptions(txns: DataFrame, rules: DataFrame, match: Callable[[str], Column] | None = None) -> DataFrame:
    """Transactions with ``rule`` (struct<rule_id, category_id>, or null), where every rule ran once
    for each distinct description instead of once for each row.

    Descriptions are counted with map-side combine, then matched, then joined back.  The few
    hot ones, of over one row in HOT_SHARE, are broadcast with their results; their rows, and
    those without a description, are neither sent nor sorted, and the join that is left has no
    key that weighs down a task.  ``match`` makes the rule of a column's name; null
    descriptions have no rule."""
    find = match or (lambda column: rule_column(rules, column))
    counted = txns.where("description_raw is not null").groupBy(F.col("description_raw").alias("_text")).agg(F.count("*").alias("_n"))
    matched = counted.withColumn("_rule", find("_text"))
    least = max(1000, txns.count() // HOT_SHARE)
    hot = matched.where(F.col("_n") >= least).select(F.col("_text").alias("_hot"), F.col("_rule").alias("_hot_rule"))
    marked = txns.join(F.broadcast(hot), F.col("description_raw") == F.col("_hot"), "left")
    settled = F.col("_hot").isNotNull() | F.col("description_raw").isNull()
    rest = matched.where(F.col("_n") < least).select("_text", "_rule")
    joined = marked.where(~settled).join(rest, F.col("description_raw") == F.col("_text"), "left").select(*txns.columns, F.col("_rule").alias("rule"))
    return marked.where(settled).select(*txns.columns, F.col("_hot_rule").alias("rule")).unionByName(joined)


def implied_rules(edits: DataFrame, rules: DataFrame) -> DataFrame:
    """One rule for each distinct description that a person has filed otherwise than it was:
    (user_id, description_raw, pattern, category_id, n_edits, n_categories, against_rule).

    edits: (user_id, id, description_raw, category_id, new_category_id).  The last edit (greatest id)
    decides; ``n_categories`` over 1 says that the edits of a description contradict each other,
    ``against_rule`` which rule in force says otherwise, if any."""
    text = F.trim("description_raw")
    changed = edits.where(~F.col("new_category_id").eqNullSafe(F.col("category_id")) & F.col("new_category_id").isNotNull() & (text != ""))
    once = changed.groupBy("user_id", text.alias("description_raw")).agg(
        F.max_by("new_category_id", "id").alias("category_id"), F.count("*").alias("n_edits"), F.count_distinct("new_category_id").alias("n_categories"),
    )
    found = once.withColumn("_rule", rule_column(rules))
    against = F.when(F.col("_rule.category_id") != F.col("category_id"), F.col("_rule.rule_id"))
    return found.select("user_id", "description_raw", escape_regex(F.substring("description_raw", 1, LEARNED_CHARS)).alias("pattern"), "category_id", "n_edits", "n_categories", against.alias("against_rule"))
