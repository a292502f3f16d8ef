"""Periodic runs of words by a dictionary of basic factors (operator 13).

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``max(least, 2 * q)`` words long, that no neighbouring word extends.

1. Level k of the dictionary names the factors of 2^k words: two get one name if they are
   equal, and a factor that occurs once gets none.  A name of level k + 1 is the pair of
   names of its halves, so only factors whose halves repeat are looked at again.
2. Periods q with L <= q < 2L are proposed on the level of L = 2^k words.  The occurrences
   of a factor within twice its length fall into few arithmetic progressions: an occurrence
   is the first of one if none precedes it by L/2 or less.  A run that begins at s has equal
   factors at s and s + q, and one of the two is first of a progression; were neither, both
   would have a predecessor at the same distance, and the run would begin earlier.  So each
   occurrence is paired with the at most four firsts next to it, not with every other one.
3. A pair that the words before it would extend to the left is skipped, for the run is
   proposed at its own beginning.  The rest are extended to the right by descending the
   levels.  Proposals of one stretch by several periods (multiples) leave its smallest.

The work on a text of n words is O(n log n) whatever repeats in it; memory is 4 bytes for
each word and level, of one chunk of texts at a time (a text is never cut).  Rows are
independent, so nothing is shuffled.

Defined results: a null or empty text, or one of white space, has no words and no runs and
collapses to an empty text; repeated rows get equal results; of equally long runs the first
start, then the smallest period is the longest run; words are compared exactly, byte by
byte.  Only the named column is read, so extra or clashing columns do no harm.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.common import byte_rows, column_function, read_table, record

LEAST_WORDS = 12
#: Words whose dictionary is built at once; a longer text has one of its own.
CHUNK_WORDS = 1 << 17
#: White space between words, as a character class.
SPACE = r"\x20\x09-\x0D"

RUNS = record(n_words=pa.int64(), runs=pa.list_(record(start=pa.int64(), length=pa.int64(), period=pa.int64())), collapsed=pa.string())


def next_level(name: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(names of factors of 2 * size words, their places in the order of name and place)."""
    places = np.sort(places)
    places = places[places + size < len(name)]
    places = places[name[places + size] >= 0]
    key = name[places].astype(np.int64) * len(name) + name[places + size]
    order = np.argsort(key, kind="stable")
    key = key[order]
    number = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)]) - 1
    often = np.bincount(number)[number] > 1 if len(key) else np.zeros(0, bool)
    out = np.full(len(name), -1, np.int32)
    places = places[order][often]
    out[places] = number[often]
    return out, places


def proposals(name: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of equal factors of ``size`` words, size <= j - i < 2 * size, one of them
    the first of a progression."""
    names = name[places]
    first = np.ones(len(places), bool)
    first[1:] = (names[1:] != names[:-1]) | (2 * (places[1:] - places[:-1]) > size)
    firsts, seen = np.flatnonzero(first), np.cumsum(first)
    found = []
    for step in (1, -1):
        # The firsts after every occurrence, then those before every one that is no first.
        own = np.arange(len(places)) if step > 0 else np.flatnonzero(~first)
        at = seen[own] - (step < 0)
        while len(own):
            inside = (at >= 0) & (at < len(firsts))
            own, at = own[inside], at[inside]
            other = firsts[at]
            apart = (places[other] - places[own]) * step
            near = (names[other] == names[own]) & (apart < 2 * size)
            own, at, other, apart = own[near], at[near], other[near], apart[near]
            far = apart >= size
            pair = (places[own[far]], places[other[far]])
            found.append(pair[::step])
            at = at + step
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def runs_of(ids: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """(n, 3): start, length and period of every run of the words, by start, then period.
    ``ids`` numbers the words; equal numbers are equal words."""
    n = len(ids)
    name = np.append(np.where(np.bincount(ids)[ids] > 1, ids, -1), -1).astype(np.int32) if n else np.full(1, -1, np.int32)
    places = np.flatnonzero(name >= 0)
    places = places[np.argsort(name[places], kind="stable")]
    levels, starts, seconds = [], [], []
    while len(places):
        size = 1 << len(levels)
        i, j = proposals(name, places, size)
        whole = (i == 0) | (ids[i - 1] != ids[j - 1])
        starts.append(i[whole])
        seconds.append(j[whole])
        levels.append(name)
        name, places = next_level(name, places, size)
    if not levels:
        return np.empty((0, 3), np.int64)
    i, j = np.concatenate(starts), np.concatenate(seconds)
    same = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        equal = (level[i + same] == level[j + same]) & (level[j + same] >= 0)
        same += equal.astype(np.int64) << k
    period, length = j - i, j - i + same
    long = length >= np.maximum(least, 2 * period)
    i, length, period = i[long], length[long], period[long]
    order = np.lexsort((period, length, i))
    i, length, period = i[order], length[order], period[order]
    smallest = np.append(True, (i[1:] != i[:-1]) | (length[1:] != length[:-1]))[: len(i)]
    found = np.stack([i, length, period], 1)[smallest]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def chunks(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    """Lists of texts, as words, of together about CHUNK_WORDS words."""
    held, n = [], 0
    for text in texts:
        held.append(text.split())
        n += len(held[-1])
        if n >= CHUNK_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def chunk_results(texts: list[list[bytes]], least: int) -> Iterator[dict]:
    """Results of some texts by one dictionary.  Words of different texts have different
    numbers, so no factor repeats in another text."""
    number, lengths = itertools.count(), [len(words) for words in texts]
    ends = np.cumsum(lengths)
    ids = np.empty(int(ends[-1]), np.int64)
    for words, end in zip(texts, ends):
        ids[end - len(words) : end] = np.fromiter(map(defaultdict(number.__next__).__getitem__, words), np.int64, len(words))
    found = runs_of(ids, least)
    change = np.zeros(len(ids) + 1, np.int32)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    gone = np.cumsum(change) > 0
    cuts = np.searchsorted(found[:, 0], ends)
    for words, end, a, b in zip(texts, ends, np.append(0, cuts), cuts):
        begin = end - len(words)
        kept = itertools.compress(words, ~gone[begin:end]) if b > a else words
        yield {"n_words": len(words), "runs": [{"start": s - begin, "length": m, "period": q} for s, m, q in found[a:b].tolist()], "collapsed": b" ".join(kept).decode("utf-8", "replace")}


def periodic_runs(text: str | Column, least: int = LEAST_WORDS) -> Column:
    """Text -> its word count, its runs by start and period, and the text without the words
    that repeat the first period of a run, joined by single spaces."""

    @column_function(RUNS)
    def of(values: pa.Array) -> pa.Array:
        return pa.array((r for c in chunks(byte_rows(values)) for r in chunk_results(c, least)), RUNS)

    return of(text)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the contract's texts, one in ten with a tail that repeats."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, F.regexp_extract_all(text_col, F.lit(f"[^{SPACE}]+"), F.lit(0)))
    w, n = F.col("_words"), F.size("_words").cast("long")
    split = docs.select(F.col(id_col), F.col(text_col), words.alias("_words"), F.floor(h / 10).cast("long").alias("_g"))
    a = F.col("_g") % n
    split = split.withColumns({"_a": F.when(n > 0, a), "_p": F.when(n > 0, 1 + F.floor((n - a) / (3 + F.col("_g") % 8)).cast("long"))})
    tail = F.transform(w, lambda word, i: F.when(i < F.col("_a"), word).otherwise(F.get(w, F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return split.select(F.col(id_col), F.when(F.col("_a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col(text_col)).alias(text_col))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", periodic_runs("text").alias("f")).select("doc_id", "f.*")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "r.start", (-F.col("r.less")).alias("length"), "r.period", F.expr("1000 * -r.less div r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
