"""Near-duplicate groups by an inverted join of MinHash coordinates (operator 7).

A document is the set of its 5-word shingles (128-bit hashes, made of cryptographic hashes
of the words); two documents are linked where the sets' Jaccard similarity reaches
``threshold``; a group is what links connect.

1. Equal sets are one class from here on; its representative is the smallest doc_id.
2. Every class has ``COORDINATES`` MinHash values.  Each (coordinate, value) pair is a
   posting key.  A linked pair collides in at least ``MATCHES`` coordinates (but for a
   chance of a few in a million, see ``MATCHES``).
3. Skip: keys with one posting are counted, not joined; a class with fewer than
   ``MATCHES`` shared keys cannot match anything and leaves.  Prefix: a class is posted
   only under its rarest keys, so many that two classes with ``MATCHES`` common keys
   share a posted one.  What very many documents share (a license, a passage) is thus
   posted only by documents that consist of it.
4. The classes posted under one key meet.  Their coordinates are posting lists again:
   for one class, its shortest lists are merged, counting the collisions of each class
   that turns up, and the longer lists are only asked about those (``Collisions``).  Pairs
   that reach the threshold become candidate edges, at most one for each class (a
   spanning forest), never all pairs.
5. Candidate components are found; each one's texts meet, and links are confirmed on
   full sets by a search that visits each class once and again emits a forest only.
6. Components over the confirmed links give component_id; every row looks up its class.

Large lists and components are dealt twice into blocks of about ``BLOCK_ROWS`` classes, by
two independent hashes.  What hangs together inside the blocks of both dealings is one
part, and a group of near copies is one part after this linear work.  Only classes outside
a group's largest part go on to meet all its blocks (``connected``), so no link is lost;
the memory of a task is bounded by a cell.

Defined results: null or empty texts and texts without words have empty sets and are
linked with nothing; fewer than five words are one shingle; repeated rows are in one
group; a row without an id joins the group of its equal texts but starts and names none.
Ids are whole numbers, as the smallest one names a group; others are a TypeError.
Only the named columns are read, so extra or clashing columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.llm.common import byte_rows, column_function, discard, may_hold, read_table, record, salted_join, stored, text_key, whole_number_id

SHINGLE_WORDS = 5
#: Similarity as a fraction, kept as integers so that the comparison is exact.
LINK_NUMERATOR, LINK_DENOMINATOR = 85, 100
COORDINATES = 32
#: At a similarity of 0.85 a pair agrees in fewer than 17 of 32 with probability 3.5e-6.
MATCHES = 17
#: A larger group is dealt into blocks of so many classes; one of up to CELL_BLOCKS such
#: blocks, and so many outer classes, meet in one cell.
BLOCK_ROWS, CELL_BLOCKS = 64, 8
#: Shingles of one block of a component, where its texts are long.
BLOCK_SHINGLES = 1_000_000
#: Words whose hashes a Python worker remembers between texts.
KNOWN_WORDS = 200_000
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _SEED) | np.uint64(1)
_SHIFTS = _mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64) * _SEED)
#: One odd factor for each place in a shingle and each half of its hash.
_PLACES = (_mix(np.arange(1, 2 * SHINGLE_WORDS + 1, dtype=np.uint64) * _SEED) | np.uint64(1)).reshape(2, SHINGLE_WORDS)


class WordHashes(dict):
    """word -> its number in ``raw``, which holds a 128-bit hash of the bytes of each word."""

    def __init__(self):
        self.raw = bytearray()

    def __missing__(self, word: bytes) -> int:
        self.raw += hashlib.blake2b(word, digest_size=16).digest()
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        """(2, number of words): both halves of each word's hash."""
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.raw = bytearray()
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.ascontiguousarray(np.frombuffer(bytes(self.raw) if len(words) > len(self) else self.raw, np.uint64).reshape(-1, 2)[places].T)


_KNOWN = WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words, which are runs of bytes other than ASCII white space."""
    return _KNOWN.of(text.lower().split())


def distinct_pairs(h: np.ndarray) -> np.ndarray:
    """The distinct columns of (2, n), in the order of their halves."""
    order = np.argsort(h[0])
    h = h[:, order]
    same = h[0, 1:] == h[0, :-1]
    if (same & (h[1, 1:] != h[1, :-1])).any():
        h = h[:, np.lexsort((h[1], h[0]))]
        same = (h[0, 1:] == h[0, :-1]) & (h[1, 1:] == h[1, :-1])
    return h[:, np.concatenate([[True], ~same])] if h.shape[1] else h


def shingle_set(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """(2, n): the distinct shingles' 128-bit hashes, sorted."""
    w = word_hashes(text)
    count = w.shape[1]
    if not count:
        return w
    n = min(words, count)
    with np.errstate(over="ignore"):
        h = np.full((2, count - n + 1), np.uint64(n), np.uint64)
        for j in range(n):
            h += w[:, j : count - n + 1 + j] * _PLACES[:, j : j + 1]
        return distinct_pairs(_mix(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One minimum for each coordinate, as 32 bits."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    first = shingles[0]
    with np.errstate(over="ignore"):
        for at in range(0, len(first), 4096):
            best = np.minimum(best, (first[at : at + 4096, None] * _FACTORS + _SHIFTS).min(0))
    return (_mix(best) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_key(shingles: np.ndarray) -> bytes | None:
    """128 bits that name a shingle set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if shingles.shape[1] else None


SKETCH = record(n_shingles=pa.int64(), set_key=pa.binary(), sig=pa.binary())


@column_function(SKETCH)
def sketch(text: pa.Array) -> pa.Array:
    """text -> size and 128-bit key of its shingle set, and its MinHash signature."""
    rows = []
    for t in byte_rows(text):
        s = shingle_set(t)
        n = s.shape[1]
        rows.append({"n_shingles": n, "set_key": set_key(s), "sig": signature(s).tobytes() if n else None})
    return pa.array(rows, SKETCH)


@column_function(pa.list_(pa.int64()))
def posting_keys(sig: pa.Array) -> pa.Array:
    """Signature -> one 64-bit key for each (coordinate, value)."""
    values = np.frombuffer(b"".join(byte_rows(sig)), np.uint32).astype(np.uint64).reshape(-1, COORDINATES)
    keys = (values | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * COORDINATES), pa.array(keys.ravel()))


def edges_by_cell(rows: DataFrame, group: str, find: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) that ``find`` yields for the rows of each (group, cell).

    The rows of a task are sorted by cell and cut where the cell changes, which costs far
    less than a Python call through Spark for each of very many small groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def cut(table: pa.Table, last: bool) -> tuple[list[tuple[int, int]], pa.Table | None]:
            g, c = table[group].to_numpy(), table["cell"].to_numpy()
            ends = np.flatnonzero((g[1:] != g[:-1]) | (c[1:] != c[:-1])) + 1
            starts = [0, *ends.tolist()]
            stops = [*ends.tolist(), len(g)]
            if not last:
                starts, stops, rest = starts[:-1], stops[:-1], table.slice(starts[-1])
            else:
                rest = None
            found = []
            for x, y in zip(starts, stops):
                if y - x > 1:
                    found += find(table.slice(x, y - x))
            return found, rest

        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            edges, held = cut(held.combine_chunks(), False)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], schema=kind)
        if held is not None:
            edges, _ = cut(held.combine_chunks(), True)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], schema=kind)

    dealt = rows.repartition(group, "cell").sortWithinPartitions(group, "cell")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def forest(n: int, order: np.ndarray, neighbours) -> Iterator[tuple[int, int]]:
    """Edges that connect what the links connect; each row is visited once.

    ``neighbours(i, left)`` says which of the rows ``left`` are linked with row i."""
    left = order.copy()
    todo: list[int] = []
    while len(left):
        if not todo:
            todo.append(int(left[0]))
            left = left[1:]
        i = todo.pop()
        if not len(left):
            return
        hit = neighbours(i, left)
        for j in left[hit]:
            yield i, int(j)
        todo += left[hit].tolist()
        left = left[~hit]


class Collisions:
    """Counts in how many coordinates rows of signatures collide, from their posting lists."""

    def __init__(self, sig: np.ndarray):
        coordinate = np.broadcast_to(np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32), sig.shape)
        _, lists, sizes = np.unique(sig.view(np.uint32).astype(np.uint64) | coordinate, return_inverse=True, return_counts=True)
        self.lists, self.sizes = lists.reshape(sig.shape), sizes
        #: The rows of list k are posted[starts[k] : starts[k] + sizes[k]].
        self.posted = np.argsort(self.lists, axis=None, kind="stable") // sig.shape[1]
        self.starts = np.cumsum(sizes) - sizes

    def reach(self, i: int, left: np.ndarray, least: int) -> np.ndarray:
        """Which of the rows ``left`` collide with row i in at least ``least`` coordinates.

        A row that does must turn up in one of the shortest lists; if merging those would
        cost more than asking about every row of ``left``, those are asked at once."""
        own = self.lists[i]
        own = own[np.argsort(self.sizes[own], kind="stable")]
        short, rest = own[: len(own) - least + 1], own[len(own) - least + 1 :]
        if self.sizes[short].sum() >= len(left):
            return np.isin(self.lists[left], own).sum(1) >= least
        merged = np.bincount(np.concatenate([self.posted[self.starts[k] : self.starts[k] + self.sizes[k]] for k in short]), minlength=len(self.lists))[left]
        at = np.flatnonzero(merged)
        hit = np.zeros(len(left), bool)
        hit[at] = merged[at] + np.isin(self.lists[left[at]], rest).sum(1) >= least
        return hit


def stars(edges: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(root, row) for the edges of a forest, so that every tree is a star."""
    root: dict[int, int] = {}
    for i, j in edges:
        root[j] = root.get(i, i)
        yield root[j], j


def connected(rows: DataFrame, group: str, ship: Callable[[DataFrame], DataFrame], find: Callable[[pa.Table], list[tuple[int, int]]], total: int, block_rows: int, block_weight: int | None = None) -> DataFrame:
    """Stored (node, comp) over rows (group, node, weight): what the links inside groups
    connect.  ``ship`` adds to dealt rows what ``find`` looks at.

    A group of one block is one cell.  A larger one is dealt twice into blocks.  What all
    edges connect so far are parts of the group; whatever is outside its largest part is
    then dealt into blocks that meet every block of the group."""
    cell_rows = CELL_BLOCKS * block_rows
    by_weight = lambda w: F.ceil(F.col(w) / block_weight) if block_weight else F.lit(1)
    blocks = lambda n, w, rows: F.least(F.col(n), F.greatest(F.when(F.col(n) <= cell_rows, 1).otherwise(F.ceil(F.col(n) / rows)), by_weight(w))).cast("long")
    in_block = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum("weight").alias("w")).where("n > 1").withColumn("blocks", blocks("n", "w", block_rows))
    sized = stored(salted_join(rows, sizes, group, "node", "n", total=total).drop("n", "w"), "sized")
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array(in_block(1, "blocks"), F.col("blocks") + in_block(2, "blocks")))
    edges = edges_by_cell(ship(sized.withColumn("cell", F.explode(cells))), group, find)
    parts = stored(components(edges), "parts")
    large = sized.where("blocks > 1")
    placed = large.join(parts.withColumnRenamed("comp", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    tally = placed.groupBy(group, "part").agg(F.count("*").alias("k"), F.sum("weight").alias("kw"))
    main = tally.groupBy(group).agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("outer"), (F.sum("kw") - F.max_by("kw", F.struct("k", "part"))).alias("outer_w"))
    main = stored(main.where("outer > 0").withColumn("outer_blocks", blocks("outer", "outer_w", cell_rows)), "main")
    if main.isEmpty():
        discard(sized, main)
        return parts
    split = salted_join(placed, main, group, "node", "n", total=total)
    cell = lambda o, b: o * F.col("blocks") + b
    until = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_member = F.transform(until("outer_blocks"), lambda o: cell(o, in_block(1, "blocks")))
    as_outer = F.when(F.col("part") != F.col("main"), F.transform(until("blocks"), lambda b: cell(in_block(3, "outer_blocks"), b))).otherwise(F.array().cast("array<bigint>"))
    met = split.withColumn("cell", F.explode(F.array_distinct(F.concat(as_member, as_outer))))
    more = edges_by_cell(ship(met), group, find)
    whole = stored(components(parts.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)), "parts")
    discard(sized, main, parts)
    return whole


def candidates(classes: DataFrame, total: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored (node, comp) over classes (node, sig, n_shingles): what signature matches connect."""
    postings = classes.select("node", F.explode(posting_keys("sig")).alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    found = salted_join(postings, shared, "key", "node", "df", total=total, merge=True)
    w = W.partitionBy("node")
    ranked = found.withColumns({"m": F.count("*").over(w), "r": F.row_number().over(w.orderBy("df", "key"))})
    posted = ranked.where((F.col("m") >= MATCHES) & (F.col("r") <= F.col("m") - MATCHES + 1)).select("node", "key", F.lit(1).alias("weight"))
    posted = stored(posted, "postings")
    signed = classes.select("node", "sig", "n_shingles")
    found = connected(posted, "key", lambda cells: cells.select("key", "cell", "node").join(signed.hint("merge"), "node"), signature_forest, total, block_rows)
    discard(posted)
    return found


def fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be linked at all."""
    return LINK_DENOMINATOR * np.minimum(n, m) >= LINK_NUMERATOR * np.maximum(n, m)


def signature_forest(rows: pa.Table) -> list[tuple[int, int]]:
    """A forest of the pairs that collide in enough coordinates."""
    nodes, size = rows["node"].to_numpy(), rows["n_shingles"].to_numpy()
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.int32).reshape(-1, COORDINATES)
    if len(nodes) == 2:
        return [(int(nodes[0]), int(nodes[1]))] if fits(size[:1], size[1:])[0] and (sig[0] == sig[1]).sum() >= MATCHES else []
    lists = Collisions(sig)
    found = forest(len(nodes), np.argsort(nodes, kind="stable"), lambda i, left: lists.reach(i, left, MATCHES) & fits(size[left], size[i]))
    return [(int(nodes[i]), int(nodes[j])) for i, j in stars(found)]


def set_forest(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of the confirmed links between whole shingle sets."""
    sizes = np.array([s.shape[1] for s in sets])
    every = np.concatenate(sets, axis=1)
    order = np.lexsort((every[1], every[0]))
    every = every[:, order]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(np.concatenate([[0], (every[:, 1:] != every[:, :-1]).any(0)]))
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(order), np.int64)

    def neighbours(i: int, left: np.ndarray) -> np.ndarray:
        hit = fits(sizes[left], sizes[i])
        some = left[hit]
        if len(some):
            own = code[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            n = sizes[some]
            ends = np.cumsum(n)
            at = np.repeat(starts[some] - (ends - n), n) + np.arange(ends[-1])
            both = np.add.reduceat(mark[code[at]], ends - n)
            mark[own] = 0
            hit[hit] = LINK_DENOMINATOR * both >= LINK_NUMERATOR * (n + sizes[i] - both)
        return hit

    return [(int(nodes[i]), int(nodes[j])) for i, j in stars(forest(len(nodes), np.argsort(nodes), neighbours))]


def confirmed(members: DataFrame, texts: DataFrame, total: int, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Stored (node, comp) for members (node, comp, rep, set_key, weight): what links inside
    candidate components, on full sets, connect.  texts: (rep, text)."""
    ship = lambda cells: cells.select("comp", "cell", "node", "rep", "set_key").join(texts.hint("merge"), "rep").select("comp", "cell", "node", "set_key", "text")
    return connected(members, "comp", ship, text_forest, total, block_rows, block_shingles)


def text_forest(rows: pa.Table) -> list[tuple[int, int]]:
    """A forest of the links between whole texts; a text that is not the class's own (rows
    may repeat an id) is passed over."""
    sets: dict[int, np.ndarray] = {}
    for node, key, text in zip(rows["node"].to_pylist(), rows["set_key"].to_pylist(), rows["text"].to_pylist()):
        if node not in sets:
            s = shingle_set(text.encode())
            if set_key(s) == key:
                sets[node] = s
    return set_forest(np.array(list(sets), np.int64), list(sets.values())) if len(sets) > 1 else []


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, comp) for every node of (a, b): comp is the smallest node that it can reach.

    Alternates large-star and small-star steps; each round's edges are a table in the
    shared folder, so lineage stays short; a hub's edges are dealt over many tasks."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    was = mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).withColumn("low", F.least("u", "low"))
        large = salted_join(both, least, "u", "v", "n", total=was[0]).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        joined = salted_join(large, large.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")), "u", "v", "n", total=was[0])
        small = joined.select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        before, now = now, stored(small, "edges")
        discard(before)
        if (new := mark(now)) == was:
            break
        was = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())


def grouped_rows(docs: DataFrame, extra: dict[str, Column], id_col: str, text_col: str, block_rows: int) -> DataFrame:
    """(id, n_shingles, component_id, grp, and ``extra`` of the text) for every row; grp, the
    smallest set key of the group, is null where the text has no words."""
    rows = docs.select(whole_number_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = stored(rows.select("id", sketch("text").alias("s"), *[c.alias(n) for n, c in extra.items()]).select("id", "s.*", *extra), "sketch")
    classes = sketched.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    # The number is unique and, once stored, fixed: the table is only read from here on.
    classes = stored(classes.where("rep is not null").withColumn("node", F.monotonically_increasing_id()), "classes")
    total = sketched.count()
    near = candidates(classes, total, block_rows)
    members = classes.select("node", "rep", "set_key", F.col("n_shingles").alias("weight")).join(near, "node")
    texts = rows.where("id is not null and text is not null").select(F.col("id").alias("rep"), "text")
    texts = may_hold(texts, members.select("rep"), "rep", members.count())  # most texts have no candidate and stay where they are
    groups = confirmed(members, texts, total, block_rows)
    owned = classes.select("node", "set_key", "rep", "copies").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = owned.groupBy("comp").agg(F.min("rep").alias("component_id"), F.min("set_key").alias("grp"), F.count("*").alias("n"))
    names = stored(salted_join(owned, least, "comp", "node", "n", total=total).select("set_key", "component_id", "grp", "copies"), "names")
    own = sketched.select("id", "n_shingles", "set_key", *extra)
    found = salted_join(own.where("set_key is not null"), names, "set_key", "id", "copies", "left", total=total)
    empty = own.where("set_key is null").withColumns({"component_id": F.lit(None).cast("long"), "grp": F.lit(None).cast("binary")})
    every = found.drop("copies").unionByName(empty)
    discard(near, groups, classes)
    return every.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("grp", "set_key").alias("grp"), *extra)


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row."""
    out = grouped_rows(docs, {}, id_col, text_col, block_rows)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_row_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The row with the smallest id of each group, whatever ids repeat or are null.

    A row is named by id and text: ids may repeat.  Rows without words have no group; of
    those only repeats of the same id and text leave.  Rows without an id come last."""
    # The key tells a null text from an empty one.
    key = F.concat(F.when(F.col("text").isNull(), "n").otherwise("t"), text_key("text"))
    rows = grouped_rows(docs, {"text_key": key}, id_col, text_col, block_rows)
    keyed = stored(rows.groupBy("id", "text_key").agg(F.count("*").alias("n"), F.min("grp").alias("grp")), "row-keys")
    grouped = keyed.where("grp is not null").groupBy("grp").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "text_key")).alias("w")).select(F.col("w.id").alias("_id"), F.col("w.text_key").alias("_key"))
    same = lambda a, b: a["id"].eqNullSafe(b["_id"]) & (a["text_key"] == b["_key"])
    losers = keyed.where("grp is not null").join(grouped, same(keyed, grouped), "left_anti").select(F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    repeated = keyed.where("n > 1 and (grp is not null or id is not null)").select(F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    own = docs.withColumns({"_own_id": whole_number_id(docs, id_col), "_own_key": F.concat(F.when(F.col(text_col).isNull(), "n").otherwise("t"), text_key(text_col))})
    on = lambda k: own["_own_id"].eqNullSafe(k["_id"]) & (own["_own_key"] == k["_key"])
    if repeated.isEmpty():
        return own.join(losers, on(losers), "left_anti").select(*docs.columns)
    gone = losers.unionByName(repeated)
    single = own.join(gone, on(gone), "left_anti").select(*docs.columns)
    winners = repeated.join(losers.withColumnsRenamed({"_id": "_l", "_key": "_k"}), F.col("_id").eqNullSafe(F.col("_l")) & (F.col("_key") == F.col("_k")), "left_anti")
    again = own.join(winners, on(winners), "left_semi")
    whole = F.struct(*docs.columns)
    first = again.groupBy("_own_id", "_own_key").agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
    return single.unionByName(first)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "documents"))
