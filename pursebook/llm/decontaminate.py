"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 1).

The benchmark's word windows are the patterns, words are the symbols.  A SHIFT table
over blocks of two words says how far the search may jump; where it says zero, the
HASH bucket of that suffix block (split once more by the pattern's first block) names
the few patterns to compare word by word.  Patterns of one length share one set of
tables, so that short benchmark items do not shorten the jumps of the long ones.

A text's occurrences are kept as the spans of words that they cover, merged, and the set of
patterns that occur; their items are named once, so a window that many items share and a
text repeats costs neither their product nor a row for each.

Scale: documents are never shuffled.  The benchmark is measured first; it is cut into
blocks of at most ``block_bytes`` of text and only one block's tables are on the driver and
broadcast at a time.  One block is the usual case and needs a single pass; more blocks are
one pass each, stored before the next one's tables are built; then they are joined by
document.

Item ids are whole numbers, others are a TypeError; document ids may be of any type.

Defined results: null or empty texts have no words and no hits; items without words, or
without an id, match nothing; items that repeat an id are one item; repeated documents
get equal rows; an empty benchmark leaves every document clean.  Only the named columns
are read, so extra or clashing columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.common import byte_rows, column_function, discard, read_table, record, stored, text_key, whole_number_id

WINDOW_WORDS = 10
#: Text of the benchmark that one broadcast may hold.
BLOCK_BYTES = 2 << 20
#: A longer text is searched in slices of this size, which overlap by one window.
SLICE_BYTES = 4 << 20

#: ASCII upper case to lower case; every byte outside [0-9a-z\x80-\xff] to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SPAN = record(first_word=pa.int64(), end_word=pa.int64())
FOUND = record(n_words=pa.int64(), spans=pa.list_(SPAN), items=pa.list_(pa.int64()))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class LengthTables:
    """Wu-Manber tables of the patterns that have ``m`` words each."""

    def __init__(self, m: int):
        self.m, self.block = m, min(2, m)
        self.shift: dict = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[list[bytes], list[int]]]]] = {}
        self.known: dict[tuple, list[int]] = {}

    def add(self, pattern: list[bytes], item: int) -> None:
        m, b = self.m, self.block
        key = tuple(pattern)
        if key in self.known:
            if item not in self.known[key]:
                self.known[key].append(item)
            return
        items = self.known[key] = [item]
        for j in range(b, m + 1):
            block = tuple(pattern[j - b : j])
            self.shift[block] = min(self.shift.get(block, m), m - j)
        self.buckets.setdefault(key[-b:], {}).setdefault(key[:b], []).append((pattern, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, the pattern's list of items) of every occurrence."""
        m, b, shift, buckets = self.m, self.block, self.shift, self.buckets
        jump, end, n = m - b + 1, m, len(words)
        while end <= n:
            block = (words[end - 2], words[end - 1]) if b == 2 else (words[end - 1],)
            step = shift.get(block, jump)
            if step:
                end += step
                continue
            start = end - m
            for pattern, items in buckets[block].get(tuple(words[start : start + b]), ()):
                if words[start:end] == pattern:
                    yield start, items
            end += 1


def build_tables(items: list[tuple[int, str]], window: int = WINDOW_WORDS) -> list[LengthTables]:
    tables: dict[int, LengthTables] = {}
    for item, text in items:
        words = words_of((text or "").encode())
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            tables.setdefault(m, LengthTables(m)).add(words[i : i + m], item)
    return sorted(tables.values(), key=lambda t: -t.m)


def search_text(text: bytes, tables: list[LengthTables], window: int = WINDOW_WORDS, slice_bytes: int = SLICE_BYTES) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Words of the text, the merged spans (first word, end) of all occurrences, the items."""
    spans: list[tuple[int, int]] = []
    named: dict[int, list[int]] = {}
    done, at, kept = 0, 0, []
    folded = text.translate(_FOLD)
    while at < len(folded):
        stop = len(folded)
        if stop - at > slice_bytes:
            cut = folded.find(b" ", at + slice_bytes)
            stop = cut if cut >= 0 else stop
        words = kept + folded[at:stop].split()
        base = done - len(kept)
        for t in tables:
            for first, items in t.search(words):
                if first + t.m > len(kept):
                    named[id(items)] = items
                    # Occurrences of one length come in order: most extend the last span.
                    if spans and spans[-1][0] <= base + first <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], base + first + t.m))
                    else:
                        spans.append((base + first, base + first + t.m))
        done, at = base + len(words), stop
        kept = words[max(0, len(words) - window + 1) :]
    return done, merged(spans), set().union(*named.values())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans of which none touch."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark's items (i, t) in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(whole_number_id(benchmark, id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) for b in range(n)]


def searcher(block: DataFrame, window: int) -> tuple[Callable[[str | Column], Column], Broadcast]:
    """Column function text -> words, spans and items of a block; and the broadcast of its tables."""
    shared = block.sparkSession.sparkContext.broadcast(build_tables([(r.i, r.t) for r in block.collect()], window))

    @column_function(FOUND)
    def search(text: pa.Array) -> pa.Array:
        rows = []
        for t in byte_rows(text):
            n, spans, items = search_text(t, shared.value, window)
            rows.append({"n_words": n, "spans": [{"first_word": a, "end_word": z} for a, z in spans], "items": sorted(items)})
        return pa.array(rows, FOUND)

    return search, shared


def find_benchmark_windows(
    docs: DataFrame, benchmark: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_col, n_words, spans, items) of every document: merged spans (first_word, end_word)
    of the words inside occurrences, and the items that have some."""
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    if len(blocks) == 1:
        search, _ = searcher(blocks[0], window)
        return docs.select(doc_col, search(text_col).alias("r")).select(doc_col, "r.*")
    every = None
    for b, block in enumerate(blocks):
        search, shared = searcher(block, window)
        found = docs.select(F.col(doc_col), text_key(text_col).alias("k"), F.lit(b).alias("b"), search(text_col).alias("r")).select(doc_col, "k", "b", "r.*")
        found = stored(found if b == 0 else found.where(F.size("items") > 0), "hits")
        shared.unpersist()
        every = found if every is None else every.unionByName(found)
    # Rows that repeat id and text are one row with copies until here.
    joined = every.groupBy(doc_col, "k").agg(
        F.max("n_words").alias("n_words"), merged_spans(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("b") == 0).alias("n")
    )
    return joined.select(doc_col, "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")


@column_function(pa.list_(SPAN))
def merged_spans(spans: pa.Array) -> pa.Array:
    rows = [merged([(s["first_word"], s["end_word"]) for s in row or ()]) for row in spans.to_pylist()]
    return pa.array([[{"first_word": a, "end_word": z} for a, z in row] for row in rows], pa.list_(SPAN))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark window."""
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    before = None
    for block in blocks:
        search, shared = searcher(block, window)
        docs = docs.where(F.size(search(text_col)["items"]) == 0)
        if len(blocks) > 1:
            docs = stored(docs, "clean")
            shared.unpersist()
            if before is not None:
                discard(before)
            before = docs
    return docs


VERDICT = record(n_hit=pa.int64(), n_items=pa.int64(), items_sha256=pa.string(), contaminated=pa.bool_())


@column_function(VERDICT)
def verdict(spans: pa.Array, items: pa.Array) -> pa.Array:
    """Spans and items -> how many words are hit and which items those are."""
    rows = []
    for own, named in zip(spans.to_pylist(), items.to_pylist()):
        n = sum(s["end_word"] - s["first_word"] for s in own or ())
        names = sorted(str(i) for i in named or ())
        rows.append({"n_hit": n, "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "contaminated": n > 0})
    return pa.array(rows, VERDICT)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_benchmark_windows(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", verdict("spans", "items").alias("v")).select("doc_id", "n_words", "v.*")
