import hashlib
import random
import zlib

import numpy as np
import pytest

from pursebook.llm import periodic


def brute(words, least=12):
    """Every run, by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q] or i and words[i - 1] == words[i + q - 1]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((i, m, q) for (i, m), q in found.items()), key=lambda r: (r[0], r[2]))


def numbered(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def runs(words, least=12):
    return [tuple(r) for r in periodic.runs_of(numbered(words), least).tolist()]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_random_words_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(1500):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 70))]
        assert runs(words, least) == brute(words, least), words


def test_planted_periods_equal_brute_force():
    rng = random.Random(1)
    for period in range(1, 60):
        root = [rng.choice("ab") for _ in range(period)]
        words = [rng.choice("abc") for _ in range(rng.randint(0, 9))] + (root * 4)[: rng.randint(2 * period, 4 * period)] + [rng.choice("abc") for _ in range(9)]
        assert runs(words) == brute(words), words


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("words", [fibonacci(700), list("a" * 300), list(("a" * 20 + "b") * 12), list("".join("ab"[bin(i).count("1") % 2] for i in range(512)))])
def test_words_with_many_repeats(words):
    assert runs(words, 4) == brute(words, 4)


def test_long_texts_take_little_more_than_linear_time():
    assert runs(["x"] * 400_000) == [(0, 400_000, 1)]
    assert runs(["x", "y"] * 100_000 + ["z"] + ["x"] * 100_000) == [(0, 200_000, 2), (200_001, 100_000, 1)]


def collapsed(words, found):
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_texts_of_one_chunk_do_not_meet(spark):
    text = "one two three " * 5
    rows = [(1, text), (2, text), (3, None), (4, ""), (5, " \t\n"), (6, "a" * 50_000), (7, "Ä\x0bÄ " * 9), (8, text + text), (1, text), (None, "b " * 12)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs int, collapsed string").coalesce(1)
    out = df.select("doc_id", "text", periodic.periodic_runs("text").alias("f")).collect()
    assert len(out) == len(rows)
    for r in out:
        words = (r.text or "").split()
        want = brute(words)
        assert (r.f.n_words, [tuple(x) for x in r.f.runs], r.f.collapsed) == (len(words), want, collapsed(words, want))
    assert df.where("false").select(periodic.periodic_runs("text")).count() == 0


def planted(doc_id, text):
    words = (text or "").split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query(spark, sf_dir, rows_of):
    got = rows_of(periodic.op13_periodic_runs(spark, sf_dir), "doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        words = planted(d.doc_id, d.text)
        found = runs(words) if len(words) > 1500 else brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[d.doc_id]
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(found), sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(collapsed(words, found)))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
