"""Toxicity by weak supervision (operator 10).

1. Voters.  Words that occur, and word beginnings of several lengths that occur again and
   again, in toxic-labelled sample documents significantly more often than in others make
   lexicons: one for each length and each half of the sample.  (Insults come in numbers and
   inflected, so one beginning that a text repeats says more than many that it holds once;
   that is so in every language, also in one of few labels.)  To these voters come fixed
   lexicons and patterns (insults, address, shouting, density).  A voter fires or stays
   silent.
2. Generative label model.  The firing rates and co-firing counts of all voters are
   summed over all documents.  Where voters are independent given the class, the
   covariance of two is the class variance times the product of their separations, so
   every triple of voters yields an estimate of a separation; the median over triples
   gives each voter's rates on toxic and on clean text.  What the rank-one model leaves
   of a covariance is the correlation of the two voters inside the classes, and voters
   that say the same thing share their weight.
3. A linear classifier over the single lexicon entries and the voters is trained on
   the label model's posterior of a sample, then calibrated on that sample's labels.

Bounds: the samples have about ``PER_CLASS`` documents of each label, chosen by a hash
of the id, with their whole texts; entries must be significant in such a sample, which
bounds their number; covariances are voters x voters; the model is broadcast.  Scoring
reads every whole text once and shuffles nothing.

Defined results: a null or empty text has no signal and gets the lowest scores; without
toxic labels, or without documents, the fixed lexicons alone vote; repeated rows get equal
scores; very long texts are whole.  Labels, language, source and id are never inputs of a
score.  Only the named columns are read, so extra or clashing columns do no harm.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.common import column_function, held_out, read_table
from pursebook.llm.learning import class_prior, class_weights, fit_logistic, hash_share, labelled_sample, sigmoid

PER_CLASS = 3000
MIN_SUPPORT = 4
#: Least log-odds of an entry between toxic and other sample documents, and the least
#: likelihood-ratio statistic: chance among millions of words stays below it.
MIN_LOG_ODDS, MIN_STATISTIC = 1.5, 25.0
BEGINNINGS = (3, 4, 5, 6, 7)
#: A beginning counts in a text that has it so often, and once in so many characters.
REPEATS, RATE_CHARS = 2, 1500
HALVES = 2
LEXICON_VOTERS = HALVES * (1 + len(BEGINNINGS))
CUT = 0.5
#: Labelled rows from which entries are mined, and those on which weights and slope are fitted.
MINING_PART, CALIBRATION_PART = (0.0, 0.85), (0.85, 1.0)

#: Common insults of several languages, as whole words.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown jerk fool garbage imbecile "
    "idiota idiotas imbécil estúpido estúpida basura inútil payaso asqueroso asquerosa tonto tonta "
    "idiote crétin crétine imbécile débile ordure minable nul clown dégoûtant abruti "
    "dummkopf blödmann trottel abschaum versager widerlich wertlos erbärmlich müll vollidiot"
).split()
_ADDRESS = re.compile(r"\b(?:you|your|you're|du|dein|tu|ton|eres|tus)\b[^.!?\n]{0,30}\b(?:" + "|".join(INSULTS) + r")\b")
_SHOUT = re.compile(r"\b[A-ZÀ-Þ]{3,}\b[^a-z]{0,20}!")
_WORD = re.compile(r"[^\W\d_]+")
SIGNALS = ("insults", "address", "shouting", "density")


def _is_letter(c: str) -> bool:
    """As in ``_WORD``."""
    return c.isalnum() and not c.isdecimal()


def repeats(count: int, chars: int) -> bool:
    return count >= REPEATS and count * RATE_CHARS >= chars


class Signals:
    """Which entries and patterns a text holds."""

    def __init__(self, entries: list[tuple[str, bool, tuple[int, ...]]]):
        self.entries = entries
        self.machine = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[int, bool]]] = {}
        for i, (text, whole, _) in enumerate([*entries, *((w, True, ()) for w in INSULTS)]):
            by_text.setdefault(text, []).append((i, whole))
        for text, uses in by_text.items():
            self.machine.add_word(text, (len(text), uses))
        self.machine.make_automaton()
        #: Places of the voters: the lexicon voters, then the fixed signals.
        self.voters = len(entries)
        self.signals = self.voters + LEXICON_VOTERS
        self.width = self.signals + len(SIGNALS)

    def of(self, text: str) -> list[int]:
        """Places of the entries that are present and of the voters that fire."""
        low = text.lower()
        n, k = len(low), len(self.entries)
        counts: Counter[int] = Counter()
        for end, (size, uses) in self.machine.iter(low):
            start = end - size + 1
            if start and _is_letter(low[start - 1]):
                continue
            closed = end + 1 == n or not _is_letter(low[end + 1])
            for i, whole in uses:
                if closed or not whole:
                    counts[min(i, k)] += 1
        found = {i for i, c in counts.items() if i < k and (self.entries[i][1] or repeats(c, n))}
        found |= {self.voters + v for i in found for v in self.entries[i][2]}
        insults = counts[k]
        fixed = (insults > 0, insults > 0 and _ADDRESS.search(low), "!" in text and _SHOUT.search(text), insults >= 3 and insults * 400 >= n)
        return sorted([*found, *(self.signals + i for i, fires in enumerate(fixed) if fires)])

    def votes(self, places: list[int]) -> np.ndarray:
        """Which voters fire."""
        v = np.zeros(self.width - self.voters)
        v[[p - self.voters for p in places if p >= self.voters]] = 1
        return v


def mine_entries(docs: DataFrame, sample: DataFrame) -> list[tuple[str, bool, tuple[int, ...]]]:
    """(text, whole word?, voters) of the lexicon entries; voters are length x half."""

    @column_function(pa.list_(pa.string()))
    def spread(text: pa.Array) -> pa.Array:
        rows = []
        for t in text:
            low = (t.as_py() or "").lower()
            words = _WORD.findall(low)
            starts = Counter(w[:n] for n in BEGINNINGS for w in words if len(w) >= n)
            rows.append([*set(words), *(w + "*" for w, c in starts.items() if repeats(c, len(low)))])
        return pa.array(rows, pa.list_(pa.string()))

    halved = sample.withColumn("half", F.floor(hash_share("doc_id", seed=11) * HALVES).cast("int"))
    sizes = {(r.half, r.y): r.n for r in halved.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    chosen = docs.select("doc_id", "text").join(F.broadcast(halved), "doc_id")
    counts = chosen.select("y", "half", F.explode(spread("text")).alias("w")).groupBy("w", "half").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    size = lambda y: F.coalesce(*[F.when(F.col("half") == h, F.lit(float(max(1, sizes.get((h, y), 0))))) for h in range(HALVES)])
    a, b, share = F.col("a"), F.col("b"), size(1) / (size(0) + size(1))
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((a + b) * p))).otherwise(0.0)
    counts = counts.where(a >= MIN_SUPPORT).withColumns({"odds": F.log((a + 0.5) / (size(1) + 1)) - F.log((b + 0.5) / (size(0) + 1)), "g2": 2 * (part(a, share) + part(b, 1 - share))})
    voter_of = {key: i for i, key in enumerate(itertools.product((0, *BEGINNINGS), range(HALVES)))}
    entries: dict[tuple[str, bool], list[int]] = {}
    for r in counts.where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("g2") >= MIN_STATISTIC)).select("w", "half").collect():
        text, whole = r.w.removesuffix("*"), not r.w.endswith("*")
        entries.setdefault((text, whole), []).append(voter_of[0 if whole else len(text), r.half])
    return [(text, whole, tuple(sorted(v))) for (text, whole), v in sorted(entries.items())]


def vote_moments(docs: DataFrame, signals: Signals) -> tuple[int, np.ndarray, np.ndarray]:
    """Over all documents: how many, how often each voter fires, how often each two do."""
    shared = docs.sparkSession.sparkContext.broadcast(signals.entries)

    def add(batches):
        s = Signals(shared.value)
        m = LEXICON_VOTERS + len(SIGNALS)
        pairs, n = np.zeros((m, m)), 0
        for batch in batches:
            n += batch.num_rows
            for t in batch.column(0):
                v = s.votes(s.of(t.as_py() or ""))
                if v.any():
                    pairs += np.outer(v, v)
        cells = [(i, j, float(pairs[i, j])) for i in range(m) for j in range(m)] + [(-1, -1, float(n))]
        yield pa.RecordBatch.from_pydict({"i": [c[0] for c in cells], "j": [c[1] for c in cells], "n": [c[2] for c in cells]}, pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.float64())]))

    rows = docs.select("text").mapInArrow(add, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    m = LEXICON_VOTERS + len(SIGNALS)
    pairs, total = np.zeros((m, m)), 1
    for r in rows:
        if r.i < 0:
            total = max(1, int(r.n))
        else:
            pairs[r.i, r.j] = r.n
    return total, np.diag(pairs).copy(), pairs


def label_model(total: int, fires: np.ndarray, pairs: np.ndarray, prior: float) -> dict:
    """Firing rates on toxic and clean text, and the log-odds that a vote is worth."""
    m = len(fires)
    rate = fires / total
    cov = pairs / total - np.outer(rate, rate)
    spread = prior * (1 - prior)
    gap = np.zeros(m)
    for i in range(m):
        found = [
            cov[i, j] * cov[i, k] / cov[j, k] / spread
            for j, k in itertools.combinations([x for x in range(m) if x != i], 2)
            if cov[j, k] > 1e-9 and cov[i, j] > 0 and cov[i, k] > 0
        ]
        gap[i] = np.sqrt(np.median(found)) if found else 0.0
    on = np.clip(rate + (1 - prior) * gap, 1e-5, 1 - 1e-4)
    off = np.clip(rate - prior * gap, 1e-5, on)
    inside = cov - spread * np.outer(gap, gap)
    scale = np.sqrt(np.maximum(prior * on * (1 - on) + (1 - prior) * off * (1 - off), 1e-9))
    correlation = np.clip(inside / np.outer(scale, scale), -1, 1)
    np.fill_diagonal(correlation, 0)
    share = 1 / (1 + np.maximum(correlation, 0).sum(1))
    return {"on": on, "off": off, "correlation": correlation, "yes": share * np.log(on / off), "prior": prior}


def posterior(model: dict, votes: np.ndarray) -> np.ndarray:
    """Of being toxic, given who fires.  A lexicon knows one language or one kind of insult, so
    a silent voter abstains: its silence says nothing about what the others have seen."""
    return sigmoid(np.log(model["prior"] / (1 - model["prior"])) + votes @ model["yes"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS) -> dict:
    sample = labelled_sample(labels, label_col, per_class, seed=3, part=MINING_PART)
    entries = mine_entries(docs, sample)
    signals = Signals(entries)
    prior = class_prior(labels, label_col)
    voters = label_model(*vote_moments(docs, signals), prior)
    trained_on = labelled_sample(labels, label_col, per_class, seed=4, part=CALIBRATION_PART)
    found = docs.select("doc_id", "text").join(F.broadcast(trained_on), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", signal_column(docs.sparkSession, entries)("text").alias("p")).collect()
    x = np.zeros((len(found), signals.width))
    for row, r in zip(x, found):
        row[list(r.p)] = 1
    y = np.array([r.y for r in found], float)
    if not len(found):
        weights, slope = np.append(np.full(signals.width, 2.0), -3.0), np.array([1.0, 0.0])
    else:
        soft = posterior(voters, np.array([signals.votes(list(r.p)) for r in found]))
        own = class_weights(y, prior)
        weights = fit_logistic(x, soft, own, l2=0.5)
        margin = x @ weights[:-1] + weights[-1]
        slope = fit_logistic(margin[:, None], y, own, l2=1e-3) if 0 < y.sum() < len(y) else np.array([1.0, 0.0])
    return {"entries": entries, "weights": weights, "slope": slope, "voters": voters}


def signal_column(spark: SparkSession, entries: list):
    shared = spark.sparkContext.broadcast(entries)

    @column_function(pa.list_(pa.int32()))
    def places(text: pa.Array) -> pa.Array:
        s = Signals(shared.value)
        return pa.array([s.of(t.as_py() or "") for t in text], pa.list_(pa.int32()))

    return places


def score_column(spark: SparkSession, model: dict):
    """Column function text -> toxicity in [0, 1]."""
    shared = spark.sparkContext.broadcast({k: model[k] for k in ("entries", "weights", "slope")})

    @column_function(pa.float64())
    def score(text: pa.Array) -> pa.Array:
        m = shared.value
        s, w = Signals(m["entries"]), m["weights"]
        margin = np.array([w[s.of(t.as_py() or "")].sum() + w[-1] for t in text], float)
        return pa.array(sigmoid(m["slope"][0] * margin + m["slope"][1]))

    return score


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    score = score_column(spark, train(docs, read_table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
