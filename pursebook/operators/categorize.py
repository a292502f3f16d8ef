"""Rules, decisions and the category tree (JN7, CAT1-CAT8, FLT10, SRT7, SNK11, AG15)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.keys import escape_regex
from pursebook.functions.remarks import merchant_label

CONFIDENCE = 0.85
#: Rules of one conditional expression; more make several, of which the first hit counts.
RULES_AT_ONCE = 100
LEARNED_CHARS = 40


def rule_list(rules: DataFrame) -> list[tuple]:
    """The rules in force, by priority and id.  They are settings that people write, not data;
    a pattern that the engine which runs it cannot read is an error here, not in a task."""
    compiler = rules.sparkSession._jvm.java.util.regex.Pattern
    rows = rules.orderBy("priority", "id").collect()
    for r in rows:
        try:
            compiler.compile(rule_pattern(r.pattern))
        except IllegalArgumentException as e:
            raise ValueError(f"rule {r.id}: not a pattern: {r.pattern!r}") from e
    return [(r.id, r.pattern, r.category_id) for r in rows]


def rule_pattern(pattern: str) -> str:
    return f"(?i)(?:{pattern})"


def rule_column(rules: DataFrame, text: str = "description_raw") -> Column:
    """struct<rule_id, category_id> of the first rule that matches, or null.

    Conditional expressions inside the scan's stage: no join, and matching stops at the
    first hit.  Each holds few enough rules to be compiled."""
    listed = rule_list(rules)
    kind = rules.schema["category_id"].dataType.simpleString()
    parts = []
    for at in range(0, len(listed), RULES_AT_ONCE):
        found = F
        for rule_id, pattern, category in listed[at : at + RULES_AT_ONCE]:
            value = F.struct(F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category_id"))
            found = found.when(F.col(text).rlike(rule_pattern(pattern)), value)
        parts.append(found)
    return F.coalesce(*parts) if parts else F.lit(None).cast(f"struct<rule_id:int,category_id:{kind}>")


def leaves(categories: DataFrame) -> DataFrame:
    """Categories that no other one points at."""
    return categories.join(categories.select(F.col("parent_id").alias("id")).where("id is not null").distinct(), "id", "left_anti")


def groups(categories: DataFrame) -> DataFrame:
    return categories.join(categories.select(F.col("parent_id").alias("id")).where("id is not null").distinct(), "id", "left_semi")


def choices(categories: DataFrame) -> DataFrame:
    """(group_name, names): what may be picked; groups by name, the ungrouped leaves last."""
    leaf = leaves(categories).alias("l").join(categories.alias("g"), F.col("l.parent_id") == F.col("g.id"), "left")
    return leaf.groupBy(F.col("g.name").alias("group_name")).agg(F.array_sort(F.collect_list("l.name")).alias("names")).orderBy(F.asc_nulls_last("group_name"))


def find_category(categories: DataFrame, text: str) -> DataFrame:
    """Leaves whose own or group name holds the text."""
    own = leaves(categories).alias("l").join(categories.alias("g"), F.col("l.parent_id") == F.col("g.id"), "left")
    hit = F.lower("l.name").contains(text.lower()) | F.coalesce(F.lower("g.name").contains(text.lower()), F.lit(False))
    return own.where(hit).select("l.id", F.col("l.name").alias("name"), F.col("g.name").alias("group_name"))


def decide(txns: DataFrame, rules: DataFrame, classify: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Rows that need review with what becomes of them: (.., category_id, source, confidence, status).

    ``classify`` (label, amount, direction) -> struct<category_id, confidence> is asked only
    where no rule matches, and believed from CONFIDENCE on.  The spend flag never changes."""
    rows = txns.where(F.col("status") == "NEEDS_REVIEW").withColumn("rule", rule_column(rules))
    by_rule = F.col("rule").isNotNull()
    category, source = F.when(by_rule, F.col("rule.category_id")), F.when(by_rule, F.lit("rule"))
    confidence, filed = F.when(by_rule, 1.0), by_rule
    if classify:
        answer = classify(merchant_label(F.col("description_raw"), F.col("counterparty")), F.col("amount_paisa"), F.col("direction"))
        rows = rows.withColumn("model", F.when(~by_rule, answer))
        sure = F.coalesce(F.col("model.confidence") >= CONFIDENCE, F.lit(False))
        category, source = category.when(sure, F.col("model.category_id")), source.when(sure, F.lit("llm"))
        confidence, filed = confidence.when(sure, F.col("model.confidence")), filed | sure
    return rows.withColumns({
        "category_id": category.otherwise(F.col("category_id")),
        "category_source": source.otherwise(F.col("category_source")),
        "confidence": confidence,
        "status": F.when(filed, "CATEGORIZED").otherwise("NEEDS_REVIEW"),
    }).drop("rule", "model")


def apply_rules(txns: DataFrame, rules: DataFrame) -> DataFrame:
    """All transactions with what ``decide`` makes of those that need review, in place: as
    ``edits.apply_decisions`` writes it back by id, without a join."""
    review = F.coalesce(F.col("status") == "NEEDS_REVIEW", F.lit(False))
    filed = F.col("_rule").isNotNull()
    by_rule = lambda new, old: F.when(filed, new).otherwise(F.col(old))
    return txns.withColumns({"_review": review, "_rule": F.when(review, rule_column(rules))}).withColumns({
        "category_id": by_rule(F.col("_rule.category_id"), "category_id"), "category_source": by_rule(F.lit("rule"), "category_source"),
        "category_confidence": F.when(filed, F.lit(1.0).cast("decimal(4,3)")).when(~F.col("_review"), F.col("category_confidence")), "status": by_rule(F.lit("CATEGORIZED"), "status"),
    }).drop("_review", "_rule")


def redecide(txns: DataFrame, rules: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, old, new_category_id, decision) for every row outside transfers.

    A person's choice stays unless it has become a group; a rule files the rest unless
    it names a group; what is unsure and stands on a group goes back to review."""
    tree = groups(categories).select(F.col("id").alias("g"), F.lit(True).alias("is_group"))
    rows = txns.where("transfer_group_id is null").withColumn("rule_category", rule_column(rules)["category_id"])
    rows = rows.join(tree.withColumnRenamed("is_group", "on_group"), F.col("category_id") == F.col("g"), "left").drop("g")
    rows = rows.join(tree.withColumnRenamed("is_group", "rule_on_group"), F.col("rule_category") == F.col("g"), "left").drop("g")
    on_group, user = F.coalesce("on_group", F.lit(False)), F.coalesce(F.col("category_source") == "user", F.lit(False))
    usable = ~user & F.col("rule_category").isNotNull() & F.col("rule_on_group").isNull()
    same = F.col("rule_category").eqNullSafe(F.col("category_id"))
    decision = F.when(user & ~on_group, "kept").when(usable & same, "kept").when(usable, "by_rule").when(on_group, "needs_review").otherwise("kept")
    return rows.select("id", F.col("category_id").alias("old_category_id"), F.when(decision == "by_rule", F.col("rule_category")).otherwise(F.col("category_id")).alias("new_category_id"), decision.alias("decision"))


def coverage(txns: DataFrame, rules: DataFrame) -> DataFrame:
    return txns.agg(F.count("*").alias("n"), F.count_if(rule_column(rules).isNotNull()).alias("matched"))


def learned_rules(edits: DataFrame) -> DataFrame:
    """(user_id, pattern, category_id): only where the choice differs from what was stored."""
    changed = edits.where(~F.col("new_category_id").eqNullSafe(F.col("category_id")))
    return changed.select("user_id", escape_regex(F.substring(F.trim("description_raw"), 1, LEARNED_CHARS)).alias("pattern"), F.col("new_category_id").alias("category_id")).distinct()


#: The seed taxonomy.  Investments and income are not spend.
SEED_GROUPS = {
    "Food & Drink": ("Groceries", "Restaurants", "Cafe & Bakery", "Khaja & Snacks", "Bars & Drinks", "Food Delivery"),
    "Health": ("Medicine & Pharmacy", "Hospital & Doctor", "Lab Tests", "Dental & Eye", "Supplements & Nutrition", "Health Insurance", "Gym & Fitness"),
    "Home & Bills": ("Rent", "Electricity", "Water", "Internet", "Mobile Recharge", "Cooking Gas", "Home Repairs", "Household Supplies"),
    "Transport": ("Ride-hailing", "Fuel", "Bus & Public Transport", "Vehicle Service"),
    "Shopping": ("Clothing & Shoes", "Electronics & Gadgets", "Online Shopping", "Personal Care & Cosmetics"),
    "Subscriptions": ("AI Tools", "Cloud & Hosting", "Streaming & Apps"),
    "Travel": ("Travel Tickets", "Hotels & Stays", "Trip Activities"),
    "Education": ("Tuition & Fees", "Courses & Books"),
    "Fun & Social": ("Movies & Events", "Gifts & Donations", "Festivals & Puja"),
    "Family & People": ("Family Support", "Sent to Friends"),
    "Fees & Cash": ("Bank Fees", "Cash Withdrawal"),
    "Investments": ("IPO & Shares", "Mutual Funds & SIP", "Savings & Deposits"),
    "Income & Transfers": ("Salary", "Dividends & Interest", "Refunds & Cashback", "Transfer"),
    "Other": (),
}
NOT_SPEND = ("Investments", "Income & Transfers")
#: Starter rules, all of priority 100.
SEED_RULES = (
    (r"^ATM WDL", "Cash Withdrawal"), (r"^C-ASBA Fee", "Bank Fees"), (r"^CASBA allot", "IPO & Shares"), (r"^salary for", "Salary"),
    (r"eSewa Load|^ESW DLA:", "Other"), (r"GOOGLE \*CLAUDE", "AI Tools"), (r"OPENAI \*CHATGPT", "AI Tools"), (r"PAYPAL \*CONTABO", "Cloud & Hosting"),
    (r"EXAMPLE EDUCATION", "Tuition & Fees"), (r"EXAMPLE HEALTH CARE", "Hospital & Doctor"), (r"EXAMPLE PHARMACY", "Medicine & Pharmacy"), (r"NABIL BANK LTD\.", "Transfer"),
)


def seed_rows(user_id: str) -> list[tuple[str, str, str, str | None, bool]]:
    """(id, user_id, name, parent_id, is_spend) of the seed taxonomy."""
    name_id = lambda n: f"{user_id}:{n}"
    out = []
    for group, names in SEED_GROUPS.items():
        spend = group not in NOT_SPEND
        out.append((name_id(group), user_id, group, None, spend))
        out += [(name_id(n), user_id, n, name_id(group), spend) for n in names]
    return out


def seed_for_users(users: DataFrame) -> DataFrame:
    """The seed taxonomy of every distinct user: users x a fixed list."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).cast("string").alias("parent"), F.lit(s).alias("is_spend")) for _, _, n, p, s in seed_rows("")])
    seeded = users.select("user_id").distinct().select("user_id", F.explode(rows).alias("c")).select("user_id", "c.*")
    own = lambda n: F.when(F.col(n).isNotNull(), F.concat(F.col("user_id"), F.lit(":"), F.ltrim(n, F.lit(":"))))
    return seeded.select(own("name").alias("id"), "user_id", "name", own("parent").alias("parent_id"), "is_spend")


def reparent(categories: DataFrame, wanted: DataFrame) -> DataFrame:
    """Upsert on (user_id, name) that changes the parent only."""
    new = wanted.select("user_id", "name", F.col("parent_id").alias("p"), F.col("id").alias("new_id"), F.col("is_spend").alias("s"))
    both = categories.join(new, ["user_id", "name"], "full")
    return both.select(F.coalesce("id", "new_id").alias("id"), "user_id", "name", F.coalesce("p", "parent_id").alias("parent_id"), F.coalesce("is_spend", "s").alias("is_spend"))


def rename(categories: DataFrame, names: dict[str, str]) -> DataFrame:
    return categories.replace(names, subset=["name"])


def repoint_rules(rules: DataFrame, moves: DataFrame) -> DataFrame:
    """Rules whose pattern is listed in moves (pattern, category_id) point to that category."""
    m = moves.select("pattern", F.col("category_id").alias("to"))
    return rules.join(m, "pattern", "left").withColumn("category_id", F.coalesce("to", "category_id")).drop("to")
