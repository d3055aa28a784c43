"""Toxicity scores by non-negative positive-unlabelled learning.

The confirmed toxic documents are positives; all other text is unlabelled, as it holds toxic
documents that nobody has marked. With the class prior, the risk of a classifier on true
negatives is what it risks on unlabelled text less the prior's share of what it risks on
positives. Where that estimate turns negative, the classifier has begun to fit noise, and its
step goes the other way.

Features are the words of a text, present or not. Which of them tell positives from unlabelled
text is decided from document counts over the whole corpus, again corrected by the prior; a
document is then a short list of feature numbers, and scoring looks each of its distinct words up
once. The classifiers are small numpy models trained on the driver from a bounded sample. They
start at the log odds that the corpus gives each feature and descend from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LETTER_RUN, MEMORY_KEY_CHARS, Memory, once_per_worker

#: Bounds of the sample that weights are trained on, documents. Scores, document counts, the choice
#: of features, their log odds and the prior have none.
POSITIVES = 8_000
UNLABELLED = 16_000
#: Up to so many confirmed ids are sent to all executors, so that no text is shuffled.
BROADCAST_IDS = 1_000_000
#: Features hash into this many buckets.
BUCKETS = 1 << 20
#: Buckets that the classifiers see at most; documents of one kind that must hold one; and how
#: many standard deviations it must stand out, so that few of the million do so by chance.
FEATURES = 2_048
LEAST_DOCUMENTS = 4
LEAST_Z = 4.5
#: Least share of a bucket's unlabelled documents that the prior's share of positives explains.
LEAST_PURITY = 0.6
#: Prior share of toxic documents where no labelled row tells it.
DEFAULT_PRIOR = 0.05
CLASSIFIERS = 3
STEPS = 100
RATE = 0.02
PENALTY = 1e-5
#: Of the log odds, the part at which a feature's weight starts.
START = 0.3
#: The negative risk may fall this many priors below zero; beyond, its step is taken back
#: at the discounted rate.
TOLERANCE = 1.0
DISCOUNT = 0.1
#: How much the classifiers' weights of unlabelled documents differ.
BAG = 0.5
#: Score from which a document is predicted to be toxic.
THRESHOLD = 0.3


class Model(NamedTuple):
    buckets: np.ndarray  # of the features, sorted
    weights: np.ndarray  # classifiers by features
    biases: np.ndarray


def word_bucket(word: str) -> int:
    """Bucket of a lower-cased word."""
    return crc32(word.encode()) % BUCKETS


class _Features:
    """Features of texts, by number if a list of buckets is given, else as buckets."""

    def __init__(self, buckets: np.ndarray | None):
        self.number = None if buckets is None else {int(b): i for i, b in enumerate(buckets)}
        self.memory = Memory()

    def of_word(self, word: str) -> int:
        """Number of the word's feature; -1 for none."""
        bucket = word_bucket(word)
        return bucket if self.number is None else self.number.get(bucket, -1)

    def of_text(self, text: str) -> np.ndarray:
        words = set(LETTER_RUN.findall(text.lower()))
        known = self.memory.known
        found = set()
        for word in self.memory.missing(words):
            feature = self.of_word(word)
            if len(word) <= MEMORY_KEY_CHARS:
                known[word] = feature
            else:
                found.add(feature)
        found.update(map(known.get, words))
        found -= {None, -1}
        return np.sort(np.fromiter(found, np.int32, len(found)))


def _sample(ids: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` ids, those of least hash, so that no order takes part."""
    return ids.distinct().withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(bound).select("_id")


class _Counts(NamedTuple):
    """Over all positive and all rows: how many there are, and how many hold each bucket."""

    positives: int
    rows: int
    of_positives: np.ndarray
    of_rows: np.ndarray


def _document_counts(rows: DataFrame) -> _Counts:
    """Counts over rows of (positive, text), in one pass; a task tells at most two numbers a bucket.

    Buckets in fewer than ``LEAST_DOCUMENTS`` rows are left at zero.
    """
    name = f"toxicity counts {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = once_per_worker(name, lambda: _Features(None))
        counts, totals = np.zeros((2, BUCKETS), np.int32), [0, 0]
        for batch in batches:
            for positive, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[positive][own.of_text(text)] += 1
                totals[positive] += 1
        of_rows = counts.sum(0)
        at = np.flatnonzero(of_rows)
        # The row counts go as a bucket of no word.
        told = [np.append(at, -1), np.append(counts[1][at], totals[1]), np.append(of_rows[at], sum(totals))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(told, (np.int32, np.int64, np.int64))], names=["bucket", "p", "u"])

    counted = rows.mapInArrow(run, "bucket int, p bigint, u bigint").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # A row for each bucket at most.
    found = counted.where((F.col("bucket") < 0) | (F.col("u") >= LEAST_DOCUMENTS)).toArrow()
    bucket, p, u = (found.column(c).to_numpy() for c in ("bucket", "p", "u"))
    words, total = bucket >= 0, bucket < 0
    of_positives, of_rows = np.zeros(BUCKETS), np.zeros(BUCKETS)
    of_positives[bucket[words]], of_rows[bucket[words]] = p[words], u[words]
    return _Counts(int(p[total].sum()), int(u[total].sum()), of_positives, of_rows)


def _choose(counts: _Counts, prior: float) -> np.ndarray:
    """Buckets that stand out most between positives and unlabelled text, sorted."""
    p, u = counts.of_positives / counts.positives, counts.of_rows / counts.rows
    pooled = (counts.of_positives + counts.of_rows) / (counts.positives + counts.rows)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / counts.positives + 1 / counts.rows))
    z = np.where(counts.of_rows >= LEAST_DOCUMENTS, np.abs(p - u) / spread, 0.0)
    z[prior * p < LEAST_PURITY * u] = 0.0
    top = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(top[z[top] >= LEAST_Z])


def _log_odds(counts: _Counts, buckets: np.ndarray, prior: float) -> np.ndarray:
    """Of each bucket, between positives and, corrected by the prior, the rest."""
    p, u = counts.of_positives[buckets] / counts.positives, counts.of_rows[buckets] / counts.rows
    rest = np.maximum(u - prior * p, 0) / (1 - prior)
    return np.log((p + 1 / counts.positives) / (rest + 1 / counts.positives))


def train(rows: Sequence[np.ndarray], positive: np.ndarray, log_odds: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """One classifier by the non-negative risk, from each document's feature numbers.

    Features start at a part of their log odds. One that no row holds gets the part that the others
    end at.
    """
    features = len(log_odds)
    rng = np.random.default_rng(seed)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    doc = np.repeat(np.arange(len(rows)), sizes)
    number = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    # Each classifier sees the unlabelled rows with weights of its own.
    drawn = np.zeros(len(rows))
    drawn[u] = 1 + BAG * (rng.exponential(size=len(u)) - 1)
    drawn[u] /= drawn[u].sum()
    share = np.zeros(len(rows))
    share[p] = 1.0 / len(p)
    weights = START * log_odds
    bias = float(np.log(prior / (1 - prior)))
    mean, power = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(doc, weights[number], len(rows)) + bias
        chance = 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))
        loss_negative = np.logaddexp(0, z)
        risk = (drawn * loss_negative).sum() - prior * (share * loss_negative).sum()
        of_negative = (drawn - prior * share) * chance
        slope = prior * share * (chance - 1) + of_negative if risk >= -TOLERANCE * prior else -DISCOUNT * of_negative
        grad = np.append(np.bincount(number, slope[doc], features) + PENALTY * weights, slope.sum())
        mean = 0.9 * mean + 0.1 * grad
        power = 0.999 * power + 0.001 * grad * grad
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    held = np.bincount(number, minlength=features) > 0
    if held.any():
        part = (weights[held] @ log_odds[held]) / max(log_odds[held] @ log_odds[held], 1e-12)
        weights = np.where(held, weights, part * log_odds)
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from documents, of which ``labels`` confirms some as toxic (1).

    Labels other than 1 tell nothing but the class prior: the share of 1 among all labelled
    documents. Repeated labels of an id count as toxic if one of them is 1. Null ids, labels
    and texts are left out of the training. Without a positive the model is empty and scores 0. Document
    counts take every row; the texts are read for them in one pass that shuffles only counts,
    unless there are more than ``BROADCAST_IDS`` positive ids.
    """
    marks = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    marks = marks.groupBy(F.col(id_column).alias("_id")).agg(F.max((F.col(label) == 1).cast("int")).alias("positive"))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).cast("string").alias("text"))
    known, confirmed = marks.agg(F.avg("positive"), F.sum("positive")).first()
    prior = min(max(DEFAULT_PRIOR if known is None else known, 1e-4), 0.5)
    texts = rows.where("_id IS NOT NULL AND text IS NOT NULL")
    toxic = marks.where("positive = 1").select("_id", F.lit(1).alias("positive"))
    joined = texts.join(F.broadcast(toxic) if (confirmed or 0) <= BROADCAST_IDS else toxic, "_id", "left")
    counts = _document_counts(joined.select(F.coalesce("positive", F.lit(0)).alias("positive"), "text"))
    if not counts.positives:
        return Model(np.empty(0, np.int64), np.zeros((1, 0)), np.full(1, -50.0))
    buckets = _choose(counts, prior)
    log_odds = _log_odds(counts, buckets, prior)
    # Ids are chosen first, so that only the texts of the sample move.
    ids = texts.select("_id")
    positive = _sample(ids.join(toxic, "_id", "left_semi"), POSITIVES).withColumn("positive", F.lit(1))
    chosen = positive.unionByName(_sample(ids, UNLABELLED).withColumn("positive", F.lit(0)))
    # At most POSITIVES + UNLABELLED ids are broadcast. An id's repeated rows count once.
    sample = texts.join(F.broadcast(chosen), "_id").dropDuplicates(["_id", "positive"]).select("positive", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Features(buckets)
        for batch in batches:
            found = [own.of_text(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["positive", "features"])

    # Short lists of numbers for the bounded sample.
    got = sample.mapInArrow(features, "positive int, features array<int>").toArrow().to_pydict()
    order = sorted(range(len(got["positive"])), key=lambda i: (got["positive"][i], got["features"][i]))
    lists = [np.array(got["features"][i], np.int32) for i in order]
    positives = np.array([got["positive"][i] == 1 for i in order])
    trained = [train(lists, positives, log_odds, prior, seed) for seed in range(CLASSIFIERS)]
    return Model(buckets, np.array([w for w, _ in trained]), np.array([b for _, b in trained]))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", extra: Sequence[Column] = ()) -> DataFrame:
    """Score of each text, 0 to 1: the id column, ``extra`` columns, ``score`` and ``predicted``.

    The score is the mean over the classifiers. A null text counts as empty; an empty text
    has the score of a text without any feature. Nothing but the text takes part. Repeated
    rows are scored each, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    name = f"toxicity {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weights, biases = shared.value
        own = once_per_worker(name, lambda: _Features(buckets))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            z = np.array([weights[:, own.of_text(t or "")].sum(1) + biases for t in texts]).reshape(len(texts), len(biases))
            scores = (1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))).mean(1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=names,
            )

    kept = [F.col(id_column), *extra]
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(kept)], F.col(text).cast("string").alias("text"))
    names = [*rows.columns[:-1], "score", "predicted"]
    schema = ", ".join([*[f"{c} {t}" for c, t in rows.dtypes[:-1]], "score double, predicted int"])
    out = docs.select(*kept).columns
    return rows.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(out)], "score", "predicted")
