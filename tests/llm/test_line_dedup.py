import random

import pytest

from pursebook.llm import line_dedup as ld


def brute(rows):
    """rows: distinct (id, text), ids sorted; text -> text without later occurrences."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
    return out


def test_cases(spark):
    rows = [(3, "a\nb\nc\nd"), (1, "x\na\nb\nc\ny"), (2, "a\nb\nc"), (4, "a\nb"), (5, None), (6, ""), (7, "\n".join("L" * 10)), (8, "\n\n\n\n"), (9, "q\nb\nc\nd\na\nb\nc\nz"), (None, "a\nb\nc\nnew")]
    want = brute(rows)
    df = spark.createDataFrame([(i, t, "k", "g") for i, t in rows + rows[:1] + rows[7:8]], "doc_id long, text string, _gone string, lang string").withColumnRenamed("_gone", "h")
    out = ld.dedup_lines(df).collect()
    assert len(out) == 12
    for r in out:
        assert r.text == want[r.doc_id], r
        assert r.h == "k" and r.lang == "g"
    lines = {r.doc_id: (r._n_lines, r._n_removed) for r in out}
    assert lines[2] == (3, 3) and lines[5] == (0, 0) and lines[6] == (0, 0) and lines[4] == (2, 0)
    assert ld.dedup_lines(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_and_no_line_is_lost(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for i in range(60)]
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    lines = lambda texts: {x for t in texts if t for x in t.split("\n")}
    assert lines(got.values()) == lines(t for _, t in rows)
