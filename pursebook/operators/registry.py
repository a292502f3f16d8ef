"""Parsers as declared objects: what they are called, whose messages they take, how they read them.

A registry routes messages to the first parser that fits, reads them, and says what became of
each.  Routing is one conditional expression; parsers that share a reader are read by it in
one pass.  A parser of one's own is added with ``with_parser``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reader:
    """Makes normalised rows.  It is given the messages of its parsers, or, with ``cells``, the table
    of extracted cells of that name; a run that has no such table leaves its messages pending."""

    read: Callable[[DataFrame], DataFrame]
    cells: str | None = None


@dataclass(frozen=True)
class Parser:
    """``matches`` is a predicate over the messages' columns; null counts as no."""

    key: str
    version: int
    matches: Callable[[], Column]
    reader: Reader


@dataclass(frozen=True)
class Registry:
    """Parsers in the order in which they are asked.

    ``columns``: the normalised columns that every reader must make, but for the parser's version; ``id_col`` names a message,
    and a row's ``message_id`` is that name; ``outcomes`` (messages, rows, id column) judges them."""

    parsers: tuple[Parser, ...]
    columns: tuple[str, ...]
    outcomes: Callable[[DataFrame, DataFrame, str], DataFrame]
    id_col: str = "content_hash"

    def __post_init__(self):
        keys = [p.key for p in self.parsers]
        if len(keys) != len(set(keys)):
            raise ValueError(f"two parsers of one key: {sorted(k for k in keys if keys.count(k) > 1)[0]}")

    def with_parser(self, parser: Parser, first: bool = False) -> Registry:
        return replace(self, parsers=(parser, *self.parsers) if first else (*self.parsers, parser))

    def route(self, messages: DataFrame) -> DataFrame:
        """``template_key`` of the first parser that fits; null: nobody's."""
        found = F
        for p in self.parsers:
            found = found.when(p.matches(), p.key)
        return messages.withColumn("template_key", found if self.parsers else F.lit(None).cast("string"))

    def rows(self, routed: DataFrame, **cells: DataFrame) -> tuple[DataFrame | None, list[str]]:
        """(normalised rows of routed messages, keys of the parsers that could run)."""
        readers: dict[Reader, list[Parser]] = {}
        for p in self.parsers:
            readers.setdefault(p.reader, []).append(p)
        made, ran = None, []
        for reader, parsers in readers.items():
            keys = [p.key for p in parsers]
            given = cells.get(reader.cells) if reader.cells else routed.where(F.col("template_key").isin(*keys))
            if given is None:
                continue
            out = reader.read(given)
            if missing := set(self.columns) - {"parser_version"} - set(out.columns):
                raise ValueError(f"{keys[0]}: no column {sorted(missing)[0]}")
            version = F
            for p in parsers:
                version = version.when(F.col("template_key") == p.key, p.version)
            out = out.withColumn("parser_version", version.cast("int")).select(*self.columns)
            made, ran = out if made is None else made.unionByName(out), ran + keys
        return made, ran

    def parse(self, messages: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows, **cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(normalised rows, outcomes of all messages but the pending ones).  ``keep`` may write the
        rows and return what it wrote; without it whoever uses both reads the messages twice."""
        routed = self.route(messages)
        made, ran = self.rows(routed, **cells)
        if made is None:
            raise ValueError("no parser can run")
        made = keep(made)
        done = routed.where(F.col("template_key").isNull() | F.col("template_key").isin(*ran))
        return made, self.outcomes(done, made, self.id_col)
