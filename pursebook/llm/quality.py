"""Quality scores from compression with two dictionaries (operator 6).

One zstandard dictionary is built from text labelled good, one from text labelled bad.
A text is compressed in blocks with each of them; the difference of the compressed
sizes, normalised by their sum and by the length, says which kind of text it resembles.
Blocks are also compressed without a dictionary, and the difference that the good dictionary
makes to that is an input too: prose gains by it on every byte, while endless repetition, which
shrinks to nothing with or without it, gains nothing.  Blocks keep the measure alike at every length: with one
frame for a long text, the dictionary would matter at its start only.  A logistic model calibrates that difference, of the whole text
and at its extremes over the blocks, into a score; nothing else is an input of it.

Bounds: the dictionaries are built from about ``per_class`` whole texts of each class, of whose
blocks at most about ``DICT_BLOCKS`` a class, chosen by a hash, reach the driver; the
calibration from as many other texts, of which only the differences do: labelled
rows are split by a hash, so no text is both.  The dictionaries (``DICT_BYTES`` each) are
broadcast.  Scoring reads every whole text once and shuffles nothing.

Defined results: a null or empty text gets the score of a text of average differences;
without labels of both classes in both parts every score is 0.5; repeated rows get equal
scores; very long texts are whole, in training too; of rows that repeat a labelled id one is
learnt from.  Labels, language, source and id are
never inputs of a score.  Only the named columns are read, so extra or clashing columns do
no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.common import byte_rows, column_function, held_out, read_table
from pursebook.llm.learning import class_prior, class_weights, fit_logistic, hash_share, labelled_sample, sigmoid

PER_CLASS = 1500
DICT_BYTES = 256 << 10
DICT_BLOCKS = 1 << 15
FRAME_BYTES = 1024
LEVEL = 3
CUT = 0.3
#: Labelled rows for the dictionaries, and for the calibration.
DICTIONARY_PART, CALIBRATION_PART = (0.0, 0.5), (0.5, 1.0)
N_FEATURES = 8


def frames(text: bytes) -> list[memoryview]:
    view = memoryview(text)
    return [view[i : i + FRAME_BYTES] for i in range(0, len(text), FRAME_BYTES)]


def build_dictionary(blocks: list[bytes]) -> bytes:
    """A zstandard dictionary.  Blocks too few or too alike to train on are joined instead, as
    many as it holds, in the order of a hash."""
    try:
        return zstd.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstd.ZstdError:
        raw = bytearray()
        for block in sorted(set(blocks), key=lambda b: hashlib.blake2b(b).digest()):
            if len(raw) + len(block) < DICT_BYTES:
                raw += b"\n" + block
        return bytes(raw)


class SizeMeter:
    """Compressed sizes of a text's blocks with both dictionaries, and without one."""

    def __init__(self, good: bytes, bad: bytes):
        self.runs = []
        for raw in (good, bad, b""):
            d = zstd.ZstdCompressionDict(raw) if raw else None
            if d is not None:
                d.precompute_compress(level=LEVEL)
            options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            self.runs.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, **options) if d else zstd.ZstdCompressor(level=LEVEL, **options))

    def features(self, text: bytes) -> list[float]:
        """The normalised differences of the whole, the greatest and the least of its full blocks,
        and what the good dictionary saves of the whole and of the block that gains least."""
        if not text:
            return [0.0] * N_FEATURES
        blocks = frames(text)
        raw = np.array([len(b) for b in blocks])
        g, b, none = (np.array([len(run.compress(x)) for x in blocks], float) for run in self.runs)
        full = raw >= min(raw.max(), FRAME_BYTES / 4)
        out = []
        for norm in (g + b, raw):
            each = ((g - b) / norm)[full]
            out += [(g.sum() - b.sum()) / norm.sum(), each.max(), each.min()]
        return [*out, (none.sum() - g.sum()) / raw.sum(), ((none - g) / raw)[full].min()]


@column_function(pa.list_(pa.binary()))
def block_column(text: pa.Array) -> pa.Array:
    return pa.array([[bytes(b) for b in frames(t)] for t in byte_rows(text)], pa.list_(pa.binary()))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> dict:
    """Dictionaries and calibration; learns from the learnable folds only."""
    texts = docs.select("doc_id", "text").where("text is not null and text <> ''")

    def of_sample(seed: int, part: tuple[float, float]) -> DataFrame:
        sample = labelled_sample(labels, label_col, per_class, seed, part)
        return texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    none = {"good": b"", "bad": b"", "weights": [0.0] * (N_FEATURES + 1), "centre": [0.0] * N_FEATURES, "scale": [1.0] * N_FEATURES}
    chosen = of_sample(1, DICTIONARY_PART)
    sizes = {r.y: r.n for r in chosen.groupBy("y").agg(F.sum(F.ceil(F.octet_length("text") / FRAME_BYTES)).alias("n")).collect()}
    if len(sizes) < 2:
        return none
    share = F.when(F.col("y") == 1, DICT_BLOCKS / sizes[1]).otherwise(DICT_BLOCKS / sizes[0])
    rows = chosen.select("y", "doc_id", F.posexplode(block_column("text")).alias("k", "t")).where(hash_share("doc_id", "k", seed=5) < share).select("y", "t").orderBy("y", "doc_id", "k").collect()
    good, bad = ([bytes(r.t) for r in rows if r.y == y and len(r.t) >= 8] for y in (1, 0))
    model = {"good": build_dictionary(good), "bad": build_dictionary(bad)}
    rows = of_sample(2, CALIBRATION_PART).select("y", feature_column(docs.sparkSession, model)("text").alias("f")).collect()
    if len({r.y for r in rows}) < 2:
        return none
    return model | calibrate(np.array([r.f for r in rows], float), np.array([r.y for r in rows], float), class_prior(labels, label_col))


def calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> dict:
    centre, scale = x.mean(0), x.std(0) + 1e-9
    weights = fit_logistic((x - centre) / scale, y, class_weights(y, prior), l2=0.1)
    return {"weights": weights.tolist(), "centre": centre.tolist(), "scale": scale.tolist()}


def score_of(model: dict, x: np.ndarray) -> np.ndarray:
    """Features -> scores; no features at all (an empty text) count as average ones."""
    z = (x - np.array(model["centre"])) / np.array(model["scale"])
    z[~x.any(axis=1)] = 0
    w = np.array(model["weights"])
    return sigmoid(z @ w[:-1] + w[-1])


def feature_column(spark: SparkSession, model: dict):
    shared = spark.sparkContext.broadcast((model["good"], model["bad"]))

    @column_function(pa.list_(pa.float64()))
    def features(text: pa.Array) -> pa.Array:
        meter = SizeMeter(*shared.value)
        return pa.array([meter.features(t) for t in byte_rows(text)], pa.list_(pa.float64()))

    return features


def score_column(spark: SparkSession, model: dict):
    """Column function text -> score in [0, 1]; higher is better text."""
    shared = spark.sparkContext.broadcast(model)

    @column_function(pa.float64())
    def score(text: pa.Array) -> pa.Array:
        m = shared.value
        meter = SizeMeter(m["good"], m["bad"])
        x = np.array([meter.features(t) for t in byte_rows(text)], float).reshape(-1, N_FEATURES)
        return pa.array(score_of(m, x))

    return score


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    score = score_column(spark, train(docs, read_table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
