import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pursebook.llm import language, learning, quality, toxicity
from pursebook.llm.common import held_out

SF = "/root/testdata/sf0.01"


def auc(y, x):
    order = np.argsort(np.argsort(x)) + 1
    ones = sum(y)
    return (order[np.array(y) == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_folds(spark):
    got = {r.id: r.h for r in spark.range(200).select("id", held_out("id").alias("h")).collect()}
    assert got == {i: held(i) for i in range(200)}
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(held_out("id").alias("h")).first().h is False


def test_samples_are_bounded_and_leave_the_held_out(spark):
    labels = spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 10 = 0 AS INT) AS y")
    sample = learning.labelled_sample(labels.unionByName(labels), "y", 100).collect()
    assert 120 < len(sample) < 300 and not any(held(r.doc_id) for r in sample) and len({r.doc_id for r in sample}) == len(sample)
    assert learning.labelled_sample(labels.where("false"), "y", 100).count() == 0
    assert learning.class_prior(labels.where("false"), "y") == 0.5


def made(n, seed=0):
    """Documents of two languages, good and bad, some toxic; ids from 0."""
    rng = random.Random(seed)
    parts = {"en": "the and tion ing er of that with ere".split(), "de": "der und ung keit sch ein ver zu ich".split()}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 200))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = "gru" + rng.choice("abcdefgh") + rng.choice("xyz") + "mok"
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        rows.append((i, text, lang))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


ODD = [(90001, None, "en"), (90002, "", "en"), (90003, "12 34 !!", "en"), (90004, "x", None), (None, "the and", "en")]


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = made(900)
    docs = spark.createDataFrame([(*r, "s") for r in rows + ODD + ODD[:1]], "doc_id long, text string, lang string, score string").repartition(4).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), {i: (q, t) for i, q, t in labels}, {r[0]: r[2] for r in rows}


def test_quality(spark, tables):
    docs, labels, truth, _ = tables
    model = quality.train(docs, labels)
    got = docs.select("doc_id", quality.score_column(spark, model)("text").alias("x")).collect()
    assert len(got) == 906 and all(0 <= r.x <= 1 for r in got)
    own = [(truth[r.doc_id][0], r.x) for r in got if r.doc_id in truth and held(r.doc_id)]
    assert auc(*map(list, zip(*own))) > 0.97
    blank = quality.train(docs, labels.where("false"))
    assert {r.x for r in docs.select(quality.score_column(spark, blank)("text").alias("x")).collect()} == {0.5}
    assert docs.where("false").select(quality.score_column(spark, model)("text")).count() == 0


def test_quality_is_alike_at_every_length():
    meter = quality.SizeMeter(b"", b"")
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(20_000)).encode()
    short, long = meter.features(text[:8192]), meter.features(text)
    assert np.abs(np.array(short) - long).max() < 0.05 and meter.features(b"") == [0.0] * quality.N_FEATURES


def test_language(spark, tables):
    docs, _, _, langs = tables
    got = docs.select("doc_id", "text", language.guess_column(spark, language.train(docs))("text").alias("g")).collect()
    own = [r.g.lang_pred == langs[r.doc_id] for r in got if r.doc_id in langs and held(r.doc_id)]
    assert np.mean(own) > 0.98
    by = {r.doc_id: r.g for r in got}
    assert {by[i].lang_pred for i in (90001, 90002, 90003)} == {"und"} and by[90004].lang_pred in ("de", "en") and by[90004].rejected
    empty = docs.where("false")
    assert {r.g.lang_pred for r in docs.select(language.guess_column(spark, language.train(empty))("text").alias("g")).collect()} == {"und"}


def test_gram_counts_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["abc déf " * 50, "", "x", "Ab1c", "zz"]
    whole = language.count_vectors(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(language.count_vectors([t])[0], whole[i])
    assert whole[1].sum() == 0 and np.array_equal(language.count_vectors(["ABC"]), language.count_vectors(["abc"]))


def test_toxicity(spark, tables):
    docs, labels, truth, _ = tables
    model = toxicity.train(docs, labels)
    got = docs.select("doc_id", toxicity.score_column(spark, model)("text").alias("x")).collect()
    assert len(got) == 906 and all(0 <= r.x <= 1 for r in got)
    own = [(truth[r.doc_id][1], r.x) for r in got if r.doc_id in truth and held(r.doc_id)]
    assert auc(*map(list, zip(*own))) > 0.97
    assert np.mean([(x >= toxicity.CUT) == y for y, x in own]) > 0.95
    by = {r.doc_id: r.x for r in got}
    assert by[90001] == by[90002] < 0.5
    alone = toxicity.train(docs, labels.where("false"))
    assert alone["entries"] == []
    scores = spark.createDataFrame([("you are an idiot, a moron",), ("a calm and friendly text",), (None,)], "text string").select(toxicity.score_column(spark, alone)("text").alias("x")).collect()
    assert scores[0].x > scores[1].x == scores[2].x


def test_label_model_recovers_rates_and_finds_correlation():
    rng = np.random.default_rng(2)
    n, prior = 200_000, 0.2
    y = rng.random(n) < prior
    on, off = np.array([0.8, 0.6, 0.7, 0.5]), np.array([0.05, 0.1, 0.02, 0.05])
    votes = (rng.random((n, 4)) < np.where(y[:, None], on, off)).astype(float)
    votes = np.hstack([votes, votes[:, :1]])
    m = toxicity.label_model(n, votes.sum(0), votes.T @ votes, prior)
    assert np.abs(m["on"][1:4] - on[1:]).max() < 0.08 and np.abs(m["off"][1:4] - off[1:]).max() < 0.03
    assert m["correlation"][0, 4] > 0.3 and abs(m["correlation"][1, 2]) < 0.15
    assert auc(y.astype(int)[:5000], toxicity.posterior(m, votes[:5000])) > 0.95


def test_signals_match_whole_words_and_beginnings():
    s = toxicity.Signals([("gru", False, (2,)), ("tox", True, (0,))])
    # entries, then the voters that they stand for: a beginning counts where it repeats
    assert s.of("Grumok grupek") == [0, 4] and s.of("Grumok") == s.of("toxic") == s.of("") == [] and s.of("agru tox") == [1, 2]
    assert s.of("gru1 gru2" + " x" * 2000) == [] and s.votes(s.of("tox, gru gru")).tolist()[:3] == [1, 0, 1]
    fixed = s.signals
    assert s.of("you are an idiot") == [fixed, fixed + 1] and s.of("WHAT NOW!") == [fixed + 2] and s.of("idiot moron clown") == [fixed, fixed + 3]


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test tables")
def test_language_query_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op9_language_id(spark, SF).where(F.col("held_out")).collect()
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.95


def test_gram_counts_of_long_texts_do_not_depend_on_slices(monkeypatch):
    text = "the quick brown fox déjà vu 12 jumps " * 300
    whole = language.count_vectors([text, "abc"])
    for size in (7, 64, 1000):
        monkeypatch.setattr(language, "SLICE_BYTES", size)
        assert np.array_equal(language.count_vectors([text, "abc"]), whole)


def test_more_languages_than_two_hundred(spark):
    rng = random.Random(7)
    names = [f"l{i:03d}" for i in range(201)]
    letters = {n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") for _ in range(6)] for n in names}
    rows = [(i, " ".join("".join(rng.choice(letters[n]) for _ in range(3)) for _ in range(60)), n) for i, n in enumerate(names * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model["names"] == sorted({n for i, _, n in rows if not held(i)}) and len(model["names"]) == 201
    got = docs.select("lang", language.guess_column(spark, model)("text").alias("g")).collect()
    assert np.mean([r.lang == r.g.lang_pred for r in got]) > 0.9


def brute_language(text, model):
    """Cosines by the definition, gram by gram."""
    data = b" " + text.lower().encode().translate(language._TO_SPACE) + b"  "
    v = np.zeros(language.DIMENSIONS)
    for i in range(len(data) - 2):
        if data[i] != 32 or data[i + 1] != 32:
            for gram, factor in ((data[i : i + 2], 2654435761), (data[i : i + 3], 2246822519)):
                v[(int.from_bytes(gram) * factor % 2**32) >> (32 - language.BITS)] += 1
    v = np.sqrt(v) * model["idf"]
    v /= max(np.linalg.norm(v), 1e-12)
    best = {}
    for c, o in zip(model["centroids"], model["owner"]):
        best[model["names"][o]] = max(best.get(model["names"][o], -1), float(v @ c))
    return max(sorted(best), key=lambda n: round(best[n], 5)), best


def test_language_scores_equal_brute_force(spark, tables):
    docs, _, _, _ = tables
    model = language.train(docs)
    for r in docs.where("doc_id < 40").select("text", language.guess_column(spark, model)("text").alias("g")).collect():
        name, best = brute_language(r.text, model)
        assert name == r.g.lang_pred and abs(best[name] - r.g.cosine) < 1e-4
        assert abs(1 / sum(np.exp(language.SHARPNESS * (b - best[name])) for b in best.values()) - r.g.score) < 1e-3


def test_quality_scores_equal_brute_force(spark, tables):
    import zstandard as zstd

    docs, labels, _, _ = tables
    model = quality.train(docs, labels)
    size = lambda raw, x: len(zstd.ZstdCompressor(level=quality.LEVEL, dict_data=zstd.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False).compress(x))
    for r in docs.where("doc_id < 12").select("text", quality.score_column(spark, model)("text").alias("x")).collect():
        parts = [r.text.encode()[i : i + quality.FRAME_BYTES] for i in range(0, len(r.text.encode()), quality.FRAME_BYTES)]
        g, b, n = ([f(p) for p in parts] for f in (lambda p: size(model["good"], p), lambda p: size(model["bad"], p), len))
        x = []
        for norm in ([i + j for i, j in zip(g, b)], n):
            each = [(i - j) / k for i, j, k, raw in zip(g, b, norm, n) if raw >= min(max(n), quality.FRAME_BYTES / 4)]
            x += [(sum(g) - sum(b)) / sum(norm), max(each), min(each)]
        z = sum(w * (v - c) / s for w, v, c, s in zip(model["weights"], x, model["centre"], model["scale"])) + model["weights"][-1]
        assert abs(1 / (1 + np.exp(-z)) - r.x) < 0.02  # a prepared dictionary may save a byte


def test_toxicity_scores_equal_brute_force(spark, tables):
    docs, labels, _, _ = tables
    model = toxicity.train(docs, labels)
    for r in docs.where("doc_id < 60").select("text", toxicity.score_column(spark, model)("text").alias("x")).collect():
        low = r.text.lower()
        words = toxicity._WORD.findall(low)
        w, z, voters = model["weights"], model["weights"][-1], set()
        for i, (entry, whole, own) in enumerate(model["entries"]):
            count = sum(x == entry if whole else x.startswith(entry) for x in words)
            if count and (whole or toxicity.repeats(count, len(low))):
                z += w[i]
                voters |= set(own)
        k = len(model["entries"])
        insults = sum(x in toxicity.INSULTS for x in words)
        fixed = [insults > 0, bool(insults and toxicity._ADDRESS.search(low)), bool(toxicity._SHOUT.search(r.text)), insults >= 3 and insults * 400 >= len(low)]
        z += sum(w[k + v] for v in voters) + sum(w[k + toxicity.LEXICON_VOTERS + i] for i, f in enumerate(fixed) if f)
        assert abs(1 / (1 + np.exp(-(model["slope"][0] * z + model["slope"][1]))) - r.x) < 1e-9


def test_long_texts_and_an_empty_table(spark, tables):
    docs, labels, _, _ = tables
    long = "the and tion ing " * 300_000
    df = spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")
    for score in (quality.score_column(spark, quality.train(docs, labels)), toxicity.score_column(spark, toxicity.train(docs, labels))):
        rows = df.select(score("text").alias("x")).collect()
        assert rows[0].x == rows[1].x and 0 <= rows[0].x <= 1
    none = docs.where("false")
    assert toxicity.train(none, labels)["entries"] == [] and quality.train(none, labels)["good"] == b""


def test_parts_of_the_labels_are_disjoint(spark):
    labels = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS y")
    one, two = ({r.doc_id for r in learning.labelled_sample(labels, "y", 10_000, 1, p).collect()} for p in (quality.DICTIONARY_PART, quality.CALIBRATION_PART))
    assert not one & two and len(one) + len(two) == sum(not held(i) for i in range(3000))
