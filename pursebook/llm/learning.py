"""Bounded training samples and small linear models for the text classifiers.

Every sample is bounded in rows by a parameter, and takes their whole texts: rows are chosen
by a hash of their id with a rate that follows from exact counts, so a sample does not
depend on partitioning.  Only ids of the sample (never texts) are broadcast, and their
number is the parameter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.llm.common import held_out

#: Seed of the hash by which labelled rows are split into disjoint parts.
PARTS_SEED = 1009


def hash_share(*cols: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def labelled_sample(labels: DataFrame, label_col: str, per_class: int, seed: int = 0, part: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(doc_id, y) of about ``per_class`` learnable rows of each class (never over twice that),
    of those alone whose hash falls into ``part``: samples of disjoint parts share no row."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    place = hash_share("doc_id", seed=PARTS_SEED)
    rows = rows.where((place >= part[0]) & (place < part[1])).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("y") == 1, per_class / max(1, counts.get(1, 0))).otherwise(per_class / max(1, counts.get(0, 0)))
    return rows.where(hash_share("doc_id", seed=seed) < rate)


def class_prior(labels: DataFrame, label_col: str) -> float:
    """Share of ones among the learnable rows."""
    rows = labels.where(F.col(label_col).isin(0, 1) & ~held_out("doc_id"))
    share = rows.agg(F.avg(F.col(label_col).cast("double")).alias("p")).first()["p"]
    return 0.5 if share is None else float(min(max(share, 1e-4), 1 - 1e-4))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last one is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def class_weights(y: np.ndarray, prior: float) -> np.ndarray:
    """Weights that give a sample the class shares of the whole."""
    ones = max(1, int((y == 1).sum()))
    zeros = max(1, int((y == 0).sum()))
    n = len(y)
    return np.where(y == 1, prior * n / ones, (1 - prior) * n / zeros)
