"""Exact top-k search by inner product, term at a time (operator 12).

Rows are sparse: a term is a place in the vector whose integer weight is not zero.  The
components x of a vector become the weights floor(scale * x).

Queries and candidates are dealt into blocks by a hash, and every block of queries meets
every block of candidates in one cell, so a cell's rows are bounded whatever the table
holds.  In a cell the candidates are posting lists: for each term, which of them have it,
and with which weight.  A query's terms are taken one after another; each scatters its
weighted list into a dense array with a score for each candidate.  A partition selection
then finds the k-th best score; what is above it, and the smallest ids of those that equal
it, are the cell's answer.  The answers of a query's cells are merged by a ranking window.
Every candidate is scored; nothing is pruned.

Scale: a cell holds at most ``BLOCK_ROWS`` queries and as many candidates, a score array
``SCORED_ROWS`` candidates.  A candidate is sent once for each block of queries, a query once
for each block of candidates, and a cell returns k rows for a query.

Defined results: vectors that are null, or hold a null, a NaN or an infinity, take no part;
an empty vector scores 0 with every other; vectors of different lengths score over the places
that both have.  Rows that repeat an id with the same weights count once; an id with several
vectors is several candidates and, if it asks, several queries; rows of the query's own id are
never its answers.  Ids are whole numbers; a row without an id asks nothing and, of equal
scores, comes last.  Ties go to the smaller id.  Weights and scores beyond a long are held at
its ends.  Without queries or candidates the result is empty.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pursebook.llm.common import read_table

TOP_K = 5
SCALE = 256
#: Rows whose id is divisible by this ask.
QUERY_EVERY = 50
BLOCK_ROWS = 1 << 16
#: Candidates of one array of scores: it stays in a core's cache.
SCORED_ROWS = 1 << 14

ANSWERS = "_query long, _vector long, _id long, _score long"
_LONG = np.iinfo(np.int64)


def weights(vector: str | Column, scale: int = SCALE) -> Column:
    """Vector of floats -> whole weights; null if it takes no part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    x = lambda c: c.cast("double")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    return F.when(finite, F.transform(v, lambda c: F.floor(x(c) * scale).cast("long")))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of every weight that is not zero."""
    array = column.combine_chunks()
    lengths = np.asarray(pa.compute.list_value_length(array).to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(array.flatten().to_numpy(zero_copy_only=False), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    full = flat != 0
    return row[full], term[full], flat[full]


def score_type(query_weight: np.ndarray, candidate_weight: np.ndarray, terms: int) -> type:
    """The narrowest type that holds every score exactly."""
    largest = lambda a: max((abs(int(x)) for x in (a.min(), a.max())), default=0) if len(a) else 0
    bound = largest(query_weight) * largest(candidate_weight) * max(terms, 1)
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


class Postings:
    """For each term the candidates that have it, in the order of their places, and their weights."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, kind: type):
        order = np.argsort(term, kind="stable")
        row, weight = row[order], weight[order].astype(kind)
        terms, begins = np.unique(term[order], return_index=True)
        ends = np.append(begins[1:], len(row))
        #: A list of all candidates needs no places.
        self.lists = {int(t): (slice(None) if b - a == size else row[a:b], weight[a:b]) for t, a, b in zip(terms, begins, ends)}
        self.size, self.kind = size, kind

    def scores(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of one query with every candidate."""
        out = np.zeros(self.size, self.kind)
        for t, w in zip(term.tolist(), weight):
            if t in self.lists:
                places, listed = self.lists[t]
                out[places] += listed * w
        return np.clip(out, _LONG.min, _LONG.max).astype(np.int64) if self.kind is object else out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of equal ones the smallest places."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.append(above, np.flatnonzero(scores == least)[: k - len(above)])


def answer_cell(queries: pa.Table, candidates: pa.Table, k: int = TOP_K) -> pa.Table:
    """The k best of a cell's candidates for each of its queries."""
    kinds = pa.schema([("_query", pa.int64()), ("_vector", pa.int64()), ("_id", pa.int64()), ("_score", pa.int64())])
    if not queries.num_rows or not candidates.num_rows:
        return kinds.empty_table()
    candidates = candidates.sort_by([("_id", "ascending")])
    q_row, q_term, q_weight = _lists(queries["_weights"])
    c_row, c_term, c_weight = _lists(candidates["_weights"])
    kind = score_type(q_weight, c_weight, int(max(q_term.max(initial=-1), c_term.max(initial=-1))) + 1)
    begins = np.searchsorted(q_row, np.arange(queries.num_rows + 1))
    q_id = queries["_id"].to_numpy()
    known = candidates.num_rows - candidates["_id"].null_count
    c_id = candidates["_id"].slice(0, known).to_numpy()
    q_weight, found = q_weight.astype(kind), [[] for _ in q_id]
    for at in range(0, candidates.num_rows, SCORED_ROWS):
        size = min(SCORED_ROWS, candidates.num_rows - at)
        here = slice(*np.searchsorted(c_row, [at, at + size]))
        lists = Postings(c_row[here] - at, c_term[here], c_weight[here], size, kind)
        ids = c_id[at : at + size]
        for n, own in enumerate(q_id):
            part = slice(begins[n], begins[n + 1])
            scores, places = lists.scores(q_term[part], q_weight[part]), None
            a, b = np.searchsorted(ids, [own, own + 1])
            if b > a:
                places = np.delete(np.arange(size), slice(a, b))
                scores = scores[places]
            top = best(scores, k)
            found[n].append((scores[top], (places[top] if places is not None else top) + at))
    out = []
    for n, parts in enumerate(found):
        score, place = (np.concatenate(x) for x in zip(*parts))
        top = np.array(sorted(range(len(score)), key=lambda i: (-int(score[i]), place[i]))[:k], np.int64)
        out.append((n, place[top], score[top]))
    n = np.concatenate([np.full(len(p), n) for n, p, _ in out])
    score = np.concatenate([s for *_, s in out]).astype(np.int64)
    of = lambda table, name, rows: table[name].combine_chunks().take(pa.array(rows))
    place = np.concatenate([p for _, p, _ in out])
    return pa.table([of(queries, "_id", n), of(queries, "_vector", n), of(candidates, "_id", place), pa.array(score)], schema=kinds)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP_K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, <id_col>, score): the k candidates of the highest inner product for
    each query, all of them if there are fewer."""
    spark = candidates.sparkSession

    def rows(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("_id"), weights(vector_col, scale).alias("_weights"))
        return own.where(F.col("_weights").isNotNull()).dropDuplicates()

    # At least one block of candidates for each task of a shuffle, so that all cores have work.
    n_candidates = max(-(-candidates.count() // block_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_queries = max(-(-queries.count() // block_rows), 1)
    block = lambda n: F.pmod(F.xxhash64("_id", "_weights"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows(queries.where(F.col(id_col).isNotNull())).select("_id", "_weights", F.xxhash64("_weights").alias("_vector"), block(n_queries).alias("_q"), every(n_candidates).alias("_c"))
    offered = rows(candidates).select("_id", "_weights", every(n_queries).alias("_q"), block(n_candidates).alias("_c"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return answer_cell(left, right, k)

    answers = asked.groupBy("_q", "_c").cogroup(offered.groupBy("_q", "_c")).applyInArrow(cell, ANSWERS)
    place = F.row_number().over(W.partitionBy("_query", "_vector").orderBy(F.desc("_score"), F.asc_nulls_last("_id")))
    ranked = answers.withColumn("_rank", place).where(F.col("_rank") <= k)
    return ranked.select(F.col("_query").alias("query_id"), F.col("_rank").alias("rank"), F.col("_id").alias(id_col), F.col("_score").alias("score"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where(F.col("vec_id") % QUERY_EVERY == 0), vectors)
