import hashlib
import random

import pytest

from pursebook.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def sha(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def cases():
    rng = random.Random(5)
    odd = [(i, "".join(rng.choice("ab  \n\n\t'sé1,;x") for _ in range(rng.randint(0, 700)))) for i in range(120)]
    return odd + [(900, "x" * 1000), (901, " " * 1000), (902, None), (903, "a" + "\n" * 500 + "b" * 50), (904, ""), (905, "don't 12,5"), (905, "don't 12,5"), (906, "<|endoftext|>")]


@pytest.mark.parametrize("chunk,overlap,spread", [(50, 9, 1 << 18), (64, 1, 1 << 18), (20, 5, 60), (1 << 15, 1 << 10, 30), (bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS, bpe.SPREAD_CHARS)])
def test_chunks_stitch_to_the_whole(spark, encoding, chunk, overlap, spread):
    rows = cases()
    docs = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, n_tokens string")
    out = bpe.token_digests(docs, PATH, P.PATTERN, chunk_chars=chunk, overlap_chars=overlap, spread_chars=spread).collect()
    assert len(out) == len(rows)
    want = {i: encoding.encode_ordinary(t or "") for i, t in rows}
    text = dict(rows)
    for r in out:
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), sha(want[r.doc_id])), r.doc_id
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()


def test_million_blanks_and_million_letters(spark):
    texts = [" " * 1_000_000, "x" * 1_000_000, "ab" * 300_000 + " " * 300_000 + "c d"]
    out = bpe.token_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, P.PATTERN).collect()
    assert len(out) == 3
    for r in out:
        assert r.n_tokens > 1000 and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_merges_equal_the_library(encoding):
    ranks = bpe.load_ranks(PATH)
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 30, 99, 101, 400):
        for _ in range(40):
            piece = "".join(rng.choice("aeinst") for _ in range(n))
            want = encoding.encode_ordinary(piece)
            assert bpe.merge(piece.encode(), ranks) == want


def test_neighbours_without_a_common_boundary_are_joined():
    import regex

    split = regex.compile(P.PATTERN)
    rng = random.Random(4)
    for overlap in (0, 1, 4):
        for _ in range(100):
            text = "".join(rng.choice("ab c  \n") for _ in range(rng.randint(0, 120)))
            pieces = list(bpe.stitched(text, split, 5, overlap))
            assert sum(pieces, []) == split.findall(text) and (overlap or len(pieces) == 1)


def test_encode_and_decode_columns(spark, encoding):
    docs = spark.createDataFrame([(1, "héllo wörld"), (2, None)], "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs, PATH, P.PATTERN).collect()}
    assert ids == {1: encoding.encode_ordinary("héllo wörld"), 2: []}
    _, decode, _ = bpe.bpe_columns(spark, PATH, P.PATTERN)
    back = bpe.encode_documents(docs, PATH, P.PATTERN).select("doc_id", decode("ids").alias("b")).collect()
    assert {r.doc_id: bytes(r.b).decode() for r in back} == {1: "héllo wörld", 2: ""}
    assert bpe.encode_documents(docs.where("false"), PATH, P.PATTERN).count() == 0


def test_boundaries_end_before_white_space_only():
    import regex

    text = "a  b\n\nc d"
    ends = bpe.pre_tokens(text, regex.compile(P.PATTERN))[1]
    found = bpe.boundaries(text, ends, 0, len(text))
    assert found[0] == 0 and all(not text[e - 1].isspace() for e in found[1:]) and len(text) not in found
    assert bpe.boundaries(text, ends, 2, 4) == [e for e in found if 2 <= e <= 4]


def test_a_run_stays_in_one_chunk():
    text = "a b" * 10 + "x" * 500 + " " * 500 + "c d" * 10
    starts = bpe.borders(text, 8)
    assert starts[-1] == len(text) and not any(30 < b < 531 or 531 < b < 1030 for b in starts[:-1])
