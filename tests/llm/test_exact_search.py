import math
import random

import numpy as np
import pytest

from pursebook.llm import exact_search as es


def brute(queries, rows, k=5):
    """Rows and queries: (id, vector); the answers of each (id, weights) that asks."""
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    table = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if ok(v)}
    asks = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in queries if ok(v) and i is not None}
    out = []
    for i, w in asks:
        scored = sorted((-sum(a * b for a, b in zip(w, x)), j is None, j or 0) for j, x in table if j is None or j != i)
        out += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def answers(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string").repartition(3)
    out = es.top_k(df.where("vec_id % 50 = 0"), df, **more)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("block_rows", [1 << 16, 7])
def test_equals_brute_force(spark, block_rows):
    rng = random.Random(block_rows)
    # Halves and quarters: floats hold them exactly, and many scores tie.
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, -0.25, 1.75]) for _ in range(rng.choice([8, 8, 8, 5, 0]))]) for i in range(0, 300, 1)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")]), (1150, [float("inf"), 1.0]), (None, [1.75] * 8), (None, None)]
    rows += rows[50:60] * 3 + [(50, [1.0] * 8), (100, [])]
    assert answers(spark, rows, block_rows=block_rows) == brute([r for r in rows if r[0] is not None and r[0] % 50 == 0], rows)


def test_one_vector_many_times(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(0, [1.0, 2.0])] * 200
    got = answers(spark, rows, block_rows=64)
    assert [r for r in got if r[0] == 0] == [(0, n, n, 327680) for n in range(1, 6)] and len(got) == 40


def test_few_rows(spark):
    assert answers(spark, []) == [] and answers(spark, [(50, [1.0])]) == [] and answers(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert answers(spark, [(50, [1.0]), (3, [-1.0])]) == [(50, 1, 3, -65536)]


def test_large_weights_stay_exact(spark):
    assert answers(spark, [(0, [2.0**40, 1.0]), (1, [2.0**20, 1.0]), (2, [2.0**20, 0.5])]) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1)]
    assert es.score_type(np.array([1 << 20]), np.array([1 << 20]), 4) is np.int64 and es.score_type(np.array([255]), np.array([-255]), 64) is np.int32


def test_selection_takes_the_first_of_equal_scores():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(0, 4, rng.integers(0, 30)).astype(np.int32)
        assert sorted(es.best(s, 5)) == sorted(np.lexsort((np.arange(len(s)), -s))[:5])


def test_a_list_of_some_candidates_is_scattered():
    lists = es.Postings(np.array([0, 2, 0, 1, 2]), np.array([0, 0, 1, 1, 1]), np.array([3, 4, 5, 6, 7]), 3, np.int32)
    assert lists.scores(np.array([0, 1, 9]), np.array([10, 1, 5])).tolist() == [35, 6, 47]
