"""Language identification by nearest centroids (operator 9).

A text is a vector of counts of its 2- and 3-byte grams (lower case, letters only),
hashed to ``DIMENSIONS`` places, damped by a square root, weighted by inverse document
frequency and normalised.  Each language has several centroids, found by spherical
k-means, each language in a Spark task of its own.  The nearest centroid by cosine names
the language; a text farther from it than nearly all training texts are from theirs is
marked as rejected.

Bounds: document frequencies are counted over all learnable documents, in Spark.  The
centroids of a language are fitted on about ``PER_LANGUAGE`` of its documents, with their
whole texts; every language that occurs has some, however many there are.  The model is
broadcast; its size is languages x centroids x dimensions.  Scoring reads every whole text,
in slices that overlap, so that no gram is lost or added at a cut.

Defined results: null texts and texts without a letter are ``und`` with score 0; without
any learnable document everything is ``und``; repeated rows get equal results; ties go to
the language that sorts first; very long texts are whole.  Language, source and id are
never inputs of a score.  Only the named columns are read, so extra or clashing columns do
no harm.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.common import column_function, discard, held_out, read_table, record, stored
from pursebook.llm.learning import hash_share

BITS = 12
DIMENSIONS = 1 << BITS
CENTROIDS = 3
PER_LANGUAGE = 800
#: Share of training texts that the rejection distance lets through.
ACCEPTED = 0.995
SHARPNESS = 25.0
SLICE_BYTES = 1 << 20
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Around each text, so that no gram reaches into its neighbour.
_BEFORE, _AFTER = b" ", b"  "


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of the 2- and the 3-byte grams that start at each byte but the last two."""
    a = data.astype(np.uint32)
    two = (a[:-2] << 8) | a[1:-1]
    three = (two << 8) | a[2:]
    return (two * np.uint32(2654435761)) >> np.uint32(32 - BITS), (three * np.uint32(2246822519)) >> np.uint32(32 - BITS)


def count_vectors(texts: list[str]) -> np.ndarray:
    """Gram counts of whole texts; memory is bounded by the slice, not by a text's length."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        joined = np.frombuffer(b"".join(b for _, b in held), np.uint8)
        lengths = np.array([len(b) for _, b in held])
        local = np.repeat(np.arange(len(held), dtype=np.int64), lengths)[:-2] << BITS
        counted = (joined[:-2] != 32) | (joined[1:-1] != 32)
        # The last two bytes of a slice start no gram: the next slice repeats them.
        ends = np.cumsum(lengths)[:-1]
        counted[ends - 1] = counted[ends - 2] = False
        total = np.zeros(len(held) << BITS, np.int64)
        for places in grams(joined):
            total += np.bincount((local + places)[counted], minlength=len(total))
        for (i, _), row in zip(held, total.reshape(len(held), DIMENSIONS)):
            out[i] += row
        held, size = [], 0

    for i, text in enumerate(texts):
        data = _BEFORE + text.lower().encode().translate(_TO_SPACE) + _AFTER
        for at in range(0, len(data) - 2, SLICE_BYTES):
            part = data[at : at + SLICE_BYTES + 2]
            held.append((i, part))
            size += len(part)
            if size >= SLICE_BYTES or len(held) >= 256:
                flush()
    flush()
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
    return v


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts from the row nearest to the mean and then the farthest ones."""
    k = min(k, len(v))
    start = [int(np.argmax(v @ v.mean(0)))]
    while len(start) < k:
        start.append(int(np.argmin((v @ v[start].T).max(1))))
    c = v[start].copy()
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        for j in range(k):
            if (own == j).any():
                m = v[own == j].sum(0)
                c[j] = m / max(1e-12, np.linalg.norm(m))
    return c


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many learnable documents each gram occurs, and how many those are."""

    def count(batches):
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            for i in range(0, len(texts), 256):
                seen += (count_vectors(texts[i : i + 256]) > 0).sum(0)
            n += len(texts)
        places = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"place": pa.array([*places.tolist(), -1], pa.int32()), "n": pa.array([*seen[places].tolist(), n], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    found = {r.place: r.n for r in rows}
    return np.array([found.get(i, 0) for i in range(DIMENSIONS)], float), found.get(-1, 0)


CENTROID = "lang string, centroids array<array<float>>, near array<double>"


def train(docs: DataFrame, lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> dict:
    rows = docs.select("doc_id", "text", F.col(lang_col).alias("lang")).where("text is not null and lang is not null and doc_id is not null").where(~held_out("doc_id"))
    # Stored tables have known sizes, by which Spark chooses how to join them.
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    df, n = document_frequencies(rows)
    idf = (np.log((n + 1) / (df + 1)) + 0.05).astype(np.float32)
    chosen = rows.select("doc_id", "lang").join(counts, "lang").where(hash_share("doc_id") < per_language / F.col("n")).select("doc_id", "lang").distinct()
    chosen = stored(chosen, "sample")
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def fit(texts: pd.DataFrame) -> pd.DataFrame:
        own = [t for t in texts["text"].sort_values() if _LETTER.search(t)]
        if not own:
            return pd.DataFrame({"lang": [], "centroids": [], "near": []})
        v = weigh(count_vectors(own), shared.value)
        c = spherical_kmeans(v, CENTROIDS)
        return pd.DataFrame({"lang": texts["lang"].iloc[:1], "centroids": [c.tolist()], "near": [(v @ c.T).max(1).astype(float).tolist()]})

    found = sorted(rows.join(chosen, ["doc_id", "lang"]).select("lang", "text").groupBy("lang").applyInPandas(fit, CENTROID).collect(), key=lambda r: r.lang)
    discard(counts, chosen)
    near = [x for r in found for x in r.near]
    return {
        "names": [r.lang for r in found], "idf": idf, "centroids": np.array([c for r in found for c in r.centroids], np.float32).reshape(-1, DIMENSIONS),
        "owner": np.array([i for i, r in enumerate(found) for _ in r.centroids], int), "limit": float(np.quantile(near, 1 - ACCEPTED)) if near else 0.0,
    }


GUESS = record(lang_pred=pa.string(), score=pa.float64(), cosine=pa.float64(), rejected=pa.bool_())


def guess_column(spark: SparkSession, model: dict):
    """Column function text -> language, score, cosine to the nearest centroid, rejection."""
    shared = spark.sparkContext.broadcast(model)

    @column_function(GUESS)
    def guess(text: pa.Array) -> pa.Array:
        m = shared.value
        names, owner = m["names"], m["owner"]
        rows: list[dict] = []
        for at in range(0, len(text), 256):
            texts = [t.as_py() or "" for t in text[at : at + 256]]
            cos = weigh(count_vectors(texts), m["idf"]) @ m["centroids"].T
            best = np.full((len(texts), len(names)), -1.0)
            for j, o in enumerate(owner):
                best[:, o] = np.maximum(best[:, o], cos[:, j])
            for t, b in zip(texts, best):
                if not len(owner) or not _LETTER.search(t):
                    rows.append({"lang_pred": UNKNOWN, "score": 0.0, "cosine": 0.0, "rejected": True})
                    continue
                i = int(np.argmax(b))
                share = 1 / np.exp(SHARPNESS * (b - b[i])).sum()
                rows.append({"lang_pred": names[i], "score": float(share), "cosine": float(b[i]), "rejected": bool(b[i] < m["limit"])})
        return pa.array(rows, GUESS)

    return guess


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    guess = guess_column(spark, train(docs))
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), guess("text").alias("g")).select("doc_id", "held_out", "g.*")
