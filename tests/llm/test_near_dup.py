import random
import re

import numpy as np
import pytest

from pursebook.llm import near_dup as nd


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and 100 * both >= 85 * either:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, families=12, copies=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    shared, rows = " ".join(word() for _ in range(60)), []
    for f in range(families):
        base = [word() for _ in range(rng.randint(30, 160))]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 5) if c else 0):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text) + (" " + shared if f % 3 == 0 else ""))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,block", [(0, nd.BLOCK_ROWS), (1, 1)])
def test_groups_equal_brute_force(spark, seed, block):
    rows = corpus(seed) + [(9001, None), (9002, ""), (9003, " \n "), (9004, "one two"), (9005, "One  TWO"), (9006, "two one"), (9007, "a b c d e"), (9008, "A b c d e\t")]
    want = brute(rows)
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_shingles int, node string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicate_groups(df, block_rows=block).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_repeats_nulls_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (None, text), (7, text + " x"), (None, "lonely words of no one else"), (5, None)]
    out = nd.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == sorted([("5", 46, "5"), ("5", 46, "5"), ("None", 46, "5"), ("7", 47, "5"), ("None", 2, "None"), ("5", 0, "5")])
    assert nd.near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_with_two_texts_loses_no_link(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(80)) for p in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, "quite another short text here")]
    out = {r.doc_id: r.component_id for r in nd.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2] == 1 and out[3] == 1 and out[4] == 4


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.comp for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[x] == 100 for x in range(100, 160)) and {got[200], got[201], got[202]} == {200}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, (2, 4000)).astype(np.uint64)
    other = base.copy()
    other[:, :400] = rng.integers(0, 1 << 62, (2, 400)).astype(np.uint64)
    share = np.mean([(nd.signature(base ^ s) == nd.signature(other ^ s)).mean() for s in rng.integers(0, 1 << 62, 30).astype(np.uint64)])
    assert abs(share - 0.9 / 1.1) < 0.05


def test_forest_connects_each_row_once():
    link = {(0, 1), (1, 2), (3, 4)}
    edges = list(nd.forest(6, np.arange(6), lambda i, left: np.array([(min(i, j), max(i, j)) in link for j in left])))
    assert sorted(tuple(sorted(e)) for e in edges) == [(0, 1), (1, 2), (3, 4)]


def test_trees_become_stars():
    assert list(nd.stars([(0, 1), (1, 2), (3, 4), (2, 5)])) == [(0, 1), (0, 2), (3, 4), (0, 5)]


def test_word_hash_does_not_depend_on_place():
    assert (nd.word_hashes(b"aa bb aa")[:, 0] == nd.word_hashes(b"   zz\x0baa")[:, 1]).all()
    assert nd.word_hashes(b" \t\n").shape == (2, 0) and nd.shingle_set(b"x" * 200_000).shape == (2, 1)


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_words_that_polynomial_hashes_confuse_stay_apart(spark):
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rows = [(1, one), (2, two), (3, " ".join([one, two] * 5)), (4, one.upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 3), 4: (1, 1)}


def test_pairs_that_share_one_half_are_distinct():
    h = np.array([[5, 5, 1, 5, 1], [7, 6, 2, 7, 2]], np.uint64)
    assert nd.distinct_pairs(h).T.tolist() == [[1, 2], [5, 6], [5, 7]]
    assert nd.set_forest(np.array([1, 2]), [h[:, :1], h[:, 1:2]]) == []


@pytest.mark.parametrize("left", [3, 60])
def test_collisions_are_counted_from_lists(left):
    rng = np.random.default_rng(left)
    sig = rng.integers(0, 3, (60, nd.COORDINATES)).astype(np.int32)
    lists = nd.Collisions(sig)
    for least in (1, 8, 17, 32):
        for i in range(0, 60, 7):
            rest = rng.permutation(60)[:left]
            assert (lists.reach(i, rest, least) == ((sig[rest] == sig[i]).sum(1) >= least)).all()


def chain(n, spark):
    """Texts of which only neighbours are linked: every block but a few pairs falls apart."""
    words = [f"w{i}" for i in range(n * 4 + 100)]
    return [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(n)]


def test_chains_longer_than_blocks_lose_no_link(spark):
    rows = chain(40, spark)
    want = brute(rows)
    df = spark.createDataFrame([(i * 7 % 41, t) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nd.near_duplicate_groups(df, block_rows=1).collect()}
    assert len(set(c for _, c in want.values())) == 1 and set(got.values()) == {0}


def test_the_filter_loses_no_key(spark):
    from pursebook.llm.common import may_hold

    rows, keys = spark.range(-3000, 3000).selectExpr("id AS rep", "id % 7 AS x"), spark.range(-1000, 1000, 3).selectExpr("id AS rep")
    kept = {r.rep for r in may_hold(rows, keys, "rep").collect()}
    wanted = set(range(-1000, 1000, 3))
    assert wanted <= kept and len(kept) < len(wanted) + 50
    assert may_hold(rows, keys.where("false"), "rep").count() == 0 and may_hold(rows, keys, "rep").columns == rows.columns
