"""Byte-level BPE encoding and decoding (operator 4).

Every text is cut into chunks that overlap; each chunk is pre-tokenised on its own.
Inside an overlap the two neighbours' pre-token boundaries soon agree, and from a common
boundary on they must stay equal, so the text is cut there, and every piece is encoded,
pre-token by pre-token.  (The character before a cut is never white space: the pattern
looks ahead only behind white space, so a piece is split as it would be inside the whole
text.)  A chunk starts behind the first blank that follows a visible character, so a run
of a million letters or blanks stays in one chunk.  Where two neighbours have no common
boundary in their overlap, the second chunk is joined to the first one.

The chunks of a text of up to ``spread_chars`` are worked on in one task; those of a longer
one are dealt over many tasks, stitched by a window over their boundaries, and the pieces
are dealt again.

Merging is the usual greedy one: the adjacent pair of the lowest rank, leftmost first.  The
pairs of a long pre-token wait in a heap, so one of n bytes costs n log n.  Decoding concatenates the tokens' bytes.

Defined results: a null or empty text has no tokens; repeated rows get equal results;
characters that the pattern does not match have no tokens; the rank file is a parameter, is
read by the driver and reaches executors by broadcast (its size is fixed); it must know
all 256 bytes.  Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.llm.common import column_function, read_table, record, text_key

CHUNK_CHARS = 1 << 11
OVERLAP_CHARS = 1 << 8
#: Chunks of a longer text are dealt over tasks, in larger pieces.
SPREAD_CHARS = 1 << 18
SPREAD_CHUNK_CHARS, SPREAD_OVERLAP_CHARS = 1 << 15, 1 << 10
#: Pre-tokens whose ids a Python worker remembers, and their greatest length.
KNOWN_TOKENS, KNOWN_CHARS = 300_000, 48

IDS = pa.list_(pa.int32())
_BORDER = re.compile(r"\S\s")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token of any length."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    # Part i is piece[i:after[i]]; before[i] is where the part on its left starts.
    after, before = list(range(1, n + 1)), list(range(-1, n))
    after.append(n + 1)
    pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, i, end = heapq.heappop(pairs)
        middle = after[i]
        if middle >= n or middle < 0 or after[middle] != end:
            continue  # one of its parts has been merged since
        after[i], after[middle] = end, -1
        before[end] = i
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heapq.heappush(pairs, (r, left, end))
        if end < n and (r := ranks.get(piece[i : after[end]])) is not None:
            heapq.heappush(pairs, (r, i, after[end]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Known(dict):
    """pre-token -> ids.  Short pre-tokens are merged by the library, one at a time, and
    remembered; long ones, whose time and stack it does not bound, by ``merge``."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.ranks = ranks
        self.short = tiktoken.Encoding("pre-tokens", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, token: str) -> list[int]:
        if len(token) > KNOWN_CHARS:
            return merge(token.encode(), self.ranks)
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        ids = self[token] = self.short(token)
        return ids


def borders(text: str, size: int) -> list[int]:
    """Where chunks of at least ``size`` characters start, and the text's end."""
    found = [0]
    while (m := _BORDER.search(text, found[-1] + size)) and m.end() < len(text):
        found.append(m.end())
    return [*found, len(text)]


def pre_tokens(text: str, split: regex.Pattern) -> tuple[list[str], np.ndarray]:
    """The matches in a text and where each one ends."""
    tokens = split.findall(text)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    if len(ends) and ends[-1] == len(text):
        return tokens, ends
    spans = [m.span() for m in split.finditer(text)]  # some characters match nothing
    return [text[a:b] for a, b in spans], np.array([b for _, b in spans], np.int64)


def boundaries(text: str, ends: np.ndarray, low: int, high: int) -> list[int]:
    """Ends from low to high of the pre-tokens that a longer text could not change, behind
    non-space; the text's start is one too."""
    near = ends[:-1][np.searchsorted(ends[:-1], low) : np.searchsorted(ends[:-1], high, "right")]
    return [0] * (low <= 0) + [e for e in near.tolist() if not text[e - 1].isspace()]


def stitched(text: str, split: regex.Pattern, chunk_chars: int, overlap_chars: int) -> Iterator[list[str]]:
    """The pre-tokens of a text, one list for each piece between two common boundaries."""
    starts = borders(text, chunk_chars)
    chunk = lambda a, b: pre_tokens(text[a : min(len(text), b + overlap_chars)], split)
    start, k = 0, 1
    tokens, ends = chunk(0, starts[1])
    while k < len(starts) - 1:
        edge = starts[k]
        more, more_ends = chunk(edge, starts[k + 1])
        own = {start + e for e in boundaries(text[start : edge + overlap_chars], ends, edge - start, len(text))}
        new = (edge + e for e in boundaries(text[edge : edge + overlap_chars + 1], more_ends, 0, overlap_chars))
        cut = next((e for e in new if e in own), None)
        if cut is not None:
            yield tokens[: np.searchsorted(ends, cut - start, "right")]
            drop = np.searchsorted(more_ends, cut - edge, "right")
            tokens, ends, start = more[drop:], more_ends[drop:] - (cut - edge), cut
        else:  # join twice as many chunks as have been joined in vain
            k = min(len(starts) - 2, k + max(0, k - np.searchsorted(starts, start, "right")))
            tokens, ends = chunk(start, starts[k + 1])
        k += 1
    yield tokens


class Codec:
    """Built at most once for a rank file and pattern in each Python worker."""

    _built: dict[tuple, "Codec"] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.known, self.split = Known(ranks), regex.compile(pattern)
        self.raw = {i: token for token, i in ranks.items()}
        self.digits = np.array([str(i).encode() for i in range(max(ranks.values()) + 1)], dtype=object)

    @classmethod
    def of(cls, shared, key: tuple[str, str]) -> "Codec":
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(shared.value, key[1])
        return cls._built[key]

    def encode(self, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> np.ndarray:
        pieces = stitched(text, self.split, chunk_chars, overlap_chars)
        ids = itertools.chain.from_iterable(map(self.known.__getitem__, itertools.chain.from_iterable(pieces)))
        return np.fromiter(ids, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


def bpe_columns(
    spark: SparkSession, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> tuple[Callable[[str | Column], Column], Callable, Callable]:
    """Column functions (encode: text -> ids, decode: ids -> bytes, digest: ids -> digests)."""
    ranks = load_ranks(ranks_path)
    with open(ranks_path, "rb") as f:
        key = (hashlib.sha256(f.read()).hexdigest(), pattern)
    shared = spark.sparkContext.broadcast(ranks)

    @column_function(IDS)
    def encode(text: pa.Array) -> pa.Array:
        codec = Codec.of(shared, key)
        rows = [codec.encode(t.as_py() or "", chunk_chars, overlap_chars) for t in text]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.empty(0, np.int32)])))

    own_ids = lambda x: x.values.to_numpy(zero_copy_only=False)

    @column_function(pa.binary())
    def decode(ids: pa.Array) -> pa.Array:
        codec = Codec.of(shared, key)
        return pa.array([codec.decode(own_ids(x)) if x.is_valid else None for x in ids], pa.binary())

    kind = record(n_tokens=pa.int64(), ids_sha256=pa.string(), decoded_sha256=pa.string())

    @column_function(kind)
    def digest(ids: pa.Array) -> pa.Array:
        codec = Codec.of(shared, key)
        rows = []
        for x in ids:
            own = own_ids(x) if x.is_valid else np.empty(0, np.int32)
            text = b",".join(codec.digits[own])
            rows.append({"n_tokens": len(own), "ids_sha256": hashlib.sha256(text).hexdigest(), "decoded_sha256": hashlib.sha256(codec.decode(own)).hexdigest()})
        return pa.array(rows, kind)

    return encode, decode, digest


CHUNKS = pa.list_(record(at=pa.int32(), edge=pa.int32(), t=pa.string()))
EDGES = record(head=pa.list_(pa.int32()), tail=pa.list_(pa.int32()))


def long_text_pieces(texts: DataFrame, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """(k, piece, text) for (k, text): pieces that can be encoded separately, in order."""
    split = regex.compile(pattern)

    @column_function(CHUNKS)
    def chunks_of(text: pa.Array) -> pa.Array:
        """One pass over each text: chunks with the overlap, where they start and the next one starts."""
        rows = []
        for t in text:
            t = t.as_py()
            starts = borders(t, chunk_chars)
            rows.append([{"at": a, "edge": b, "t": t[a : b + overlap_chars]} for a, b in itertools.pairwise(starts)])
        return pa.array(rows, CHUNKS)

    @column_function(EDGES)
    def edges(at: pa.Array, edge: pa.Array, text: pa.Array) -> pa.Array:
        rows = []
        for a, b, t in zip(at.to_pylist(), edge.to_pylist(), text.to_pylist()):
            ends = pre_tokens(t, split)[1]
            head, tail = boundaries(t, ends, 0, overlap_chars), boundaries(t, ends, b - a, len(t))
            rows.append({"head": [a + e for e in head], "tail": [a + e for e in tail]})
        return pa.array(rows, EDGES)

    chunks = texts.select("k", F.posexplode(chunks_of("text")).alias("i", "c")).select("k", "i", "c.*")
    chunks = chunks.repartition(F.col("k"), F.col("i")).withColumn("e", edges("at", "edge", "t"))
    order = W.partitionBy("k").orderBy("i")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    cut = F.array_min(F.array_intersect(F.lag("e.tail").over(order), F.col("e.head")))
    cuts = chunks.select("k", "i", "at", "edge", "t", cut.alias("cut")).withColumn("ok", F.when((F.col("i") == 0) | F.col("cut").isNotNull(), 1).otherwise(0))
    # From the first overlap without a common boundary on, the rest is one piece.
    cuts = cuts.withColumn("ok", F.min("ok").over(upto))
    cuts = cuts.withColumn("piece", F.sum("ok").over(upto)).withColumn("start", F.when(F.col("ok") == 1, F.coalesce("cut", F.lit(0))).otherwise(F.col("at")))
    until = F.coalesce(F.lead("start").over(order), F.col("edge"))
    cuts = cuts.withColumn("own", F.substring(F.col("t"), F.col("start") - F.col("at") + 1, until - F.col("start")))
    return cuts.groupBy("k", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "own"))), lambda x: x["own"]), "").alias("text"))


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, spread_chars: int = SPREAD_CHARS,
) -> DataFrame:
    """(id_col, ids): the token ids of every document."""
    encode, _, _ = bpe_columns(docs.sparkSession, ranks_path, pattern, chunk_chars, overlap_chars)
    return _encoded(docs, encode, pattern, id_col, text_col, spread_chars)


def _encoded(docs: DataFrame, encode: Callable, pattern: str, id_col: str, text_col: str, spread_chars: int) -> DataFrame:
    rows = docs.select(id_col, F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > spread_chars, F.lit(False))
    whole = rows.where(~is_long).select(id_col, encode("text").alias("ids"))
    long_rows = rows.where(is_long).withColumn("k", text_key("text"))
    sizes = (min(spread_chars, SPREAD_CHUNK_CHARS), min(spread_chars, SPREAD_OVERLAP_CHARS))
    pieces = long_text_pieces(long_rows.select("k", "text").dropDuplicates(["k"]), pattern, *sizes)
    ids = pieces.select("k", "piece", encode("text").alias("ids")).groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.unionByName(long_rows.select(id_col, "k").join(ids, "k").select(id_col, "ids"))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, *, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    encode, _, digest = bpe_columns(docs.sparkSession, ranks_path, pattern, chunk_chars, overlap_chars)
    encoded = _encoded(docs, encode, pattern, "doc_id", "text", spread_chars)
    return encoded.select("doc_id", digest("ids").alias("d")).select("doc_id", "d.*")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
