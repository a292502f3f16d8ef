"""The composable transaction filter, search, presets, paging (FLT1-FLT7, SRT1, SRT2)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.clock import OFFSET, day_range
from pursebook.schema import all_of

PAGE = 50
SEARCHED = ("description_raw", "counterparty", "user_note")


def add_months(day: datetime, n: int) -> datetime:
    months = day.year * 12 + day.month - 1 + n
    return datetime(months // 12, months % 12 + 1, 1)


def preset_range(preset: str, now_local: datetime) -> tuple[datetime | None, datetime | None]:
    """UTC [start, end) of a named range of local months."""
    first = datetime(now_local.year, now_local.month, 1)
    spans = {
        "thisMonth": (first, add_months(first, 1)),
        "lastMonth": (add_months(first, -1), first),
        "last3Months": (add_months(first, -2), add_months(first, 1)),
        "thisYear": (datetime(first.year, 1, 1), datetime(first.year + 1, 1, 1)),
        "all": (None, None),
    }
    start, end = spans[preset]
    return (start and start - OFFSET), (end and end - OFFSET)


def active_count(saved: DataFrame) -> Column:
    """How many of a saved filter's dimensions narrow anything, for tables of saved filters whose
    columns are the fields of ``TransactionFilter``; a null narrows nothing."""
    c = {name: F.col(name) for name in saved.columns}
    some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    active = (
        F.coalesce(F.trim(c["search"]) != "", F.lit(False)), c["start"].isNotNull() | c["end"].isNotNull(), some(c["category_ids"]), some(c["account_ids"]), c["direction"].isNotNull(), c["status"].isNotNull(),
        F.coalesce(c["transfers"] != "shown", F.lit(False)), c["min_paisa"].isNotNull() | c["max_paisa"].isNotNull(), F.coalesce(c["uncategorized_only"], F.lit(False)),
    )
    return sum((a.cast("int") for a in active), F.lit(0))


@dataclass(frozen=True)
class TransactionFilter:
    """Every field narrows; an empty one means any."""

    search: str = ""
    start: datetime | None = None
    end: datetime | None = None
    category_ids: frozenset = field(default_factory=frozenset)
    account_ids: frozenset = field(default_factory=frozenset)
    direction: str | None = None
    status: str | None = None
    transfers: str = "shown"
    min_paisa: int | None = None
    max_paisa: int | None = None
    uncategorized_only: bool = False

    @property
    def active_count(self) -> int:
        return sum(map(bool, (
            self.search.strip(), self.start or self.end, self.category_ids, self.account_ids, self.direction, self.status,
            self.transfers != "shown", self.min_paisa is not None or self.max_paisa is not None, self.uncategorized_only,
        )))

    def predicates(self) -> list[Column]:
        c, out = F.col, []
        if self.start is not None:
            out.append(c("occurred_at") >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end is not None:
            out.append(c("occurred_at") < F.lit(self.end).cast("timestamp_ntz"))
        if self.uncategorized_only:
            out.append(c("category_id").isNull())
        elif self.category_ids:
            out.append(c("category_id").isin(*sorted(self.category_ids)))
        if self.account_ids:
            out.append(c("account_id").isin(*sorted(self.account_ids)))
        if self.direction:
            out.append(c("direction") == self.direction)
        if self.status:
            out.append(c("status") == self.status)
        if self.transfers != "shown":
            out.append(c("excluded_from_spend") == (self.transfers == "only"))
        if self.min_paisa is not None:
            out.append(c("amount_paisa") >= self.min_paisa)
        if self.max_paisa is not None:
            out.append(c("amount_paisa") <= self.max_paisa)
        if (hit := search_predicate(self.search)) is not None:
            out.append(hit)
        return out

    def apply(self, txns: DataFrame) -> DataFrame:
        return txns.where(all_of(self.predicates()))


def search_predicate(text: str, columns: tuple[str, ...] = SEARCHED) -> Column | None:
    """Case-blind substring over the columns; list and pattern marks count as spaces."""
    wanted = re.sub(r"[,()%_]", " ", text.strip()).strip()
    if not wanted:
        return None
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.contains(F.lower(name), F.lit(wanted.lower())), F.lit(False))
    return found


def page(txns: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """A page of the newest-first total order: one TakeOrderedAndProject, no full sort."""
    return newest_first(txns).offset(number * size).limit(size)


def newest_first(txns: DataFrame) -> DataFrame:
    return txns.orderBy(F.desc_nulls_last("occurred_at"), F.desc("id"))


def on_local_day(txns: DataFrame, day: datetime) -> DataFrame:
    start, end = day_range(day)
    return TransactionFilter(start=start, end=end).apply(txns)


def by_status(txns: DataFrame, status: str, limit: int = 200) -> DataFrame:
    return newest_first(txns.where(F.col("status") == status)).limit(limit)


def oldest_by_status(txns: DataFrame, status: str, limit: int = 500) -> DataFrame:
    """The queue of a review run: what has waited longest comes first."""
    return txns.where(F.col("status") == status).orderBy("occurred_at", "id").limit(limit)


def in_account_range(txns: DataFrame, account_id: object, start: datetime, end: datetime) -> DataFrame:
    """An account's rows from start to end, both of them included."""
    at = F.col("occurred_at")
    return txns.where((F.col("account_id") == account_id) & at.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


#: Senders of uploaded statements and what people see for them.
STATEMENT_NAMES = (("ESEWA_STATEMENT", "eSewa statement"), ("NABIL_STATEMENT", "Nabil statement"), ("LAXMI_STATEMENT", "Laxmi statement"), ("BANK_STATEMENT", "Bank statement"))


def uploaded_statements(messages: DataFrame, limit: int = 50) -> DataFrame:
    """Statement files among the messages, newest first, with display names."""
    name = F
    for sender, text in STATEMENT_NAMES:
        name = name.when(F.col("sender") == sender, text)
    rows = messages.where(F.col("sender").isin(*[s for s, _ in STATEMENT_NAMES])).withColumn("display_name", name)
    return rows.orderBy(F.desc("received_at"), F.desc("content_hash")).limit(limit)


def exactly_one(rows: DataFrame, key: str, value: object) -> DataFrame:
    """Point lookup that fails unless there is exactly one row."""
    found = rows.where(F.col(key) == value).limit(2)
    n = len(found.take(2))
    if n != 1:
        raise LookupError(f"{key}={value!r}: {'no' if n == 0 else 'more than one'} row")
    return found
