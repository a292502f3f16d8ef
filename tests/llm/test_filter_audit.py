import itertools
import os
import random
import re
from collections import Counter

import pytest

from pursebook.llm import filter_audit as fa


def fails(rows):
    """Row -> the letters of the filters that it fails, by the definition."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        checks = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        out.append("".join(k for k, v in checks.items() if v))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed, out = fails(rows), {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                all_fail = sum(letter in f for _, f in mine)
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), all_fail - len(gone), sum(f == letter for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def corpus(seed, n=120):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["a", "b", "Cd", "ef", "x#", *map(str, range(80))]) for _ in range(rng.choice([3, 49, 50, 70]))) for _ in range(12)] + ["", None, "A", "ÄÖ Ü", " ".join(map(str, range(60)))]
    return [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["s", "t", "", None])) for _ in range(n)]


SCHEMA = "doc_id long, text string, source string"
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, 1), (4, 0, 0), (None, 1, 1), (77, 1, 1), *((i, i % 2, 1 - i % 3) for i in range(5, 50))]


def batches(spark, folder, parts):
    """Files that arrive one after another."""
    for k, rows in enumerate(parts):
        spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", _id string, part int").coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and not os.path.exists(mark := f"{folder}/.{f}.seen"):
                open(mark, "w").close()
                os.utime(f"{folder}/{f}", (1_700_000_000 + 10 * k, 1_700_000_000 + 10 * k))


def stream(spark, folder, per_batch=1):
    return spark.readStream.schema(SCHEMA + ", _id string, part int").option("maxFilesPerTrigger", per_batch).parquet(folder)


def audited(spark, docs, out):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = fa.interactions(fa.count_available(docs, labels, out)).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_smaller_ids_that_arrive_later_retract(spark, tmp_path):
    rows = sorted(corpus(1), key=lambda r: -(r[0] or 0))
    third = len(rows) // 3
    batches(spark, f"{tmp_path}/in", [rows[:third], rows[third : 2 * third], rows[2 * third :]])
    assert audited(spark, stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out") == brute(rows, LABELS)


def test_a_later_call_goes_on_from_the_checkpoint(spark, tmp_path):
    rows = corpus(2, 90)
    batches(spark, f"{tmp_path}/in", [rows[:50]])
    assert audited(spark, stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out") == brute(rows[:50], LABELS)
    batches(spark, f"{tmp_path}/in", [rows[50:]])
    assert audited(spark, stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out") == brute(rows, LABELS)
    assert audited(spark, stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out") == brute(rows, LABELS)


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    rows, labels = corpus(3, 60), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    run = fa.audit_batch(labels, str(tmp_path), "doc_id", "text", "source")
    parts = [spark.createDataFrame(rows[:30], SCHEMA), spark.createDataFrame(rows[30:], SCHEMA)]
    for k in (0, 0, 1, 0, 1, 1):
        run(parts[k], k)
    changed = spark.read.parquet(f"{tmp_path}/counters").groupBy("part", "code").sum("n").where("`sum(n)` <> 0").collect()
    want = Counter((r[2] or "", sum(fa.BIT[x] for x in f)) for r, f in zip(rows, fails(rows)))
    got = Counter()
    for part, code, n in changed:
        got[part, code & 31] += n
    assert got == want and not os.path.exists(f"{tmp_path}/rows/batch=1")


def test_an_empty_table(spark, tmp_path):
    batches(spark, f"{tmp_path}/in", [[]])
    assert audited(spark, stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out") == {}


def test_one_text_in_any_order(spark, tmp_path):
    """One row a batch: whatever order the ids of a text arrive in, all but the least are copies."""
    rng = random.Random(4)
    rows = [(rng.randint(0, 4), "t", rng.choice("st")) for _ in range(9)]
    run = fa.audit_batch(spark.createDataFrame([], "doc_id long, quality int, toxic int"), str(tmp_path), "doc_id", "text", "source")
    for k, row in enumerate(rows):
        run(spark.createDataFrame([row], SCHEMA), k)
        got = {(r.part, r.code): r.n for r in spark.read.parquet(f"{tmp_path}/counters").groupBy("part", "code").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").where("n <> 0").collect()}
        least = min(i for i, *_ in rows[: k + 1])
        assert got == Counter((p, 1 + (fa.COPY if i > least else 0)) for i, _, p in rows[: k + 1])


def test_text_ids(spark, tmp_path):
    rows = [("b", "t"), ("a", "t"), ("c", "t"), ("c", "u"), (None, "t")]
    spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id string, text string, source string").write.parquet(f"{tmp_path}/in")
    docs = spark.readStream.schema("doc_id string, text string, source string").parquet(f"{tmp_path}/in")
    got = fa.count_available(docs, spark.createDataFrame([("a", 1, 0)], "doc_id string, quality int, toxic int"), f"{tmp_path}/out").collect()
    assert {(r.code, r.n) for r in got} == {(1 + fa.COPY, 2), (1 + fa.GOOD, 1), (1, 2)}
