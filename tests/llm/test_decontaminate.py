import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pursebook.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))


def brute(text, items, window=10):
    w, hits = words(text), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        for k in range(len(p) - m + 1 if m else 0):
            hits |= {(item, i, i + m) for i in range(len(w) - m + 1) if w[i : i + m] == p[k : k + m]}
    return len(w), hits


TEXT = st.lists(st.sampled_from("a b c d é A 1".split()), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(TEXT, max_size=6), st.integers(2, 5), st.integers(1, 30))
def test_search_equals_brute_force(text, items, window, slice_bytes):
    named = list(enumerate(items))
    n, spans, found = d.search_text(text.encode(), d.build_tables(named, window), window, slice_bytes)
    want_n, hits = brute(text, named, window)
    assert (n, found) == (want_n, {item for item, _, _ in hits})
    assert [k for a, z in spans for k in range(a, z)] == sorted({k for _, a, z in hits for k in range(a, z)})


def test_operator_cases(spark):
    long = "w" + " w".join(map(str, range(200_000)))
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Zz ONE two, three!", 9), (4, long, 9), (4, long, 9), (5, "one two", 9)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(7, "one TWO"), (8, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (9, None), (None, "one"), (10, "..."), (7, "three")], "item_id long, text string")
    expect = {1: (0, 0, 0), 2: (0, 0, 0), 3: (4, 3, 1), 4: (200_000, 11, 1), 5: (2, 2, 1)}
    for block in (1 << 20, 8):
        out = d.find_benchmark_windows(docs, bench, block_bytes=block).select("doc_id", "n_words", d.verdict("spans", "items").alias("v")).collect()
        assert len(out) == 6
        for r in out:
            assert (r.n_words, r.v.n_hit, r.v.n_items) == expect[r.doc_id], r
        clean = d.without_benchmark(docs, bench, block_bytes=block)
        assert sorted(r.doc_id for r in clean.collect()) == [1, 2] and clean.columns == docs.columns
    none = d.find_benchmark_windows(docs, bench.where("false")).select(d.verdict("spans", "items").alias("v")).collect()
    assert not any(r.v.contaminated for r in none) and len(none) == 6
    assert d.find_benchmark_windows(docs.where("false"), bench).count() == 0


def test_tables_skip():
    t = d.build_tables([(1, " ".join(f"x{i}" for i in range(10)))])[0]
    assert t.m == 10 and max(t.shift.values()) == 8 and t.shift[(b"x8", b"x9")] == 0


def test_a_window_of_many_items_in_a_repeating_text_stays_small():
    window = " ".join(f"x{i}" for i in range(10))
    tables = d.build_tables([(i, window) for i in range(2000)])
    n, spans, items = d.search_text(((window + " ") * 5000).encode(), tables)
    assert (n, spans, len(items)) == (50_000, [(0, 50_000)], 2000)
