"""run() against a brute-force version, and the contract of the stages."""

import hashlib

import pytest

from tests.llm.test_decontaminate import brute as hits_of
from tests.llm.test_line_dedup import brute as cut_lines
from tests.llm.test_near_dup import brute as groups_of

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_equals_brute_force(spark, sf_dir):
    import tiktoken

    from pursebook.llm import bpe, quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score = quality.score_column(spark, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    kept = {r.doc_id: r.text for r in docs.select("doc_id", "text", score("text").alias("x")).collect() if r.x >= 0.3}
    kept = cut_lines(kept.items())
    kept = {i: kept[i] for i, (_, c) in groups_of(kept.items()).items() if c == i}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not hits_of(t, bench)[1]}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in kept.items():
        ids = enc.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns_and_take_odd_tables(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, "en", "s", 0, 1), (2, "", "en", "s", 0, 1), (3, "a b c d e f", None, None, None, 1), (3, "a b c d e f", None, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, sf_dir)
            assert out.columns == rows.columns, name
            out.count()
        assert "ids_sha256" in corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).columns


A, B, C, D = (" ".join(f"{c}{i}" for i in range(40)) for c in "abcd")
NEAR_A = A.replace("a39", "z39")
ODD = [
    (1, A, "p"), (5, A, "p"), (5, B, "p"),  # a repeated id with one text of its own
    (2, C, "q"), (2, C, "q"), (None, C, "q"), (None, C, "r"), (9, C, "p"),  # repeated rows of the smallest id, copies without an id
    (5, NEAR_A, "p"), (3, D, "p"), (3, D.replace("d39", "z39"), "p"),  # near copies under one id
    (None, "only " + B[::-1], "p"), (None, "only " + B[::-1], "p"), (None, None, "p"), (None, None, "p"), (7, "", "p"), (7, None, "p"), (7, "", "p"),
]


def test_near_dedup_keeps_one_row_of_a_group(spark, sf_dir):
    docs = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in ODD], "doc_id long, text string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_deduplication(spark, docs, sf_dir).collect()
    rows = sorted(((r.doc_id, r.text, r.source) for r in got), key=repr)
    three = [x for x in rows if x[0] == 3]
    assert len(three) == 1 and three[0] in ODD
    assert [x for x in rows if x[0] != 3] == sorted([(1, A, "p"), (5, B, "p"), (2, C, "q"), (None, "only " + B[::-1], "p"), (None, None, "p"), (None, None, "p"), (7, "", "p"), (7, None, "p")], key=repr)
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_near_dedup_repeats_without_text_of_a_loser(spark, sf_dir):
    docs = spark.createDataFrame([(4, A), (8, A), (8, A), (8, B)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_deduplication(spark, docs, sf_dir).collect())) == [(4, A), (8, B)]
