"""Ordinal regression on graded ratings.

Cumulative-link model: P(grade <= k) = sigmoid(threshold_k - w.x). All grades share one weight
vector over hashed text features; the ordered thresholds separate the grades. The expected
grade ranks documents, the tail probability selects them.

Defined results: a null or empty text has only its shape features; ratings that are null are
not used; of several ratings of a document the lowest counts; without ratings every
document gets the middle of the scale and probability 0.5; repeated rows are scored one by
one; columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.llm.common import WHITE, Texts, mix, run_starts, text_chunks

MAX_RATED = 20_000
SLOTS = 1 << 17
GRADES = 3
MARKS = np.zeros(256, bool)
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def grade(quality: Column, toxic: Column) -> Column:
    """0 harmful, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of distinct features: words with marks cut off, mark runs, shape."""
    t = Texts(texts, fold=True)
    starts, ends, owner = t.words()
    # a word's core: without punctuation at its ends
    core = np.flatnonzero(~(WHITE | MARKS)[t.bytes])
    lo, hi = np.searchsorted(core, starts), np.searchsorted(core, ends) - 1
    full = hi >= lo
    parts = [(owner[full], t.hashes(core[lo[full]], core[hi[full]] + 1, 1))]
    tail = full.copy()
    tail[full] = core[hi[full]] + 1 < ends[full]
    parts.append((owner[tail], t.hashes(core[hi[tail]] + 1, ends[tail], 2)))
    parts.append((owner[~full], t.hashes(starts[~full], ends[~full], 3)))
    # shape: share of distinct words, share of words with marks, mean length, each in steps
    n = np.bincount(owner, minlength=t.n)
    words = t.hashes(starts, ends) ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(words, kind="stable")
    distinct = np.bincount(owner[order[run_starts(words[order])]], minlength=t.n)
    marked = np.bincount(owner[tail], minlength=t.n) + np.bincount(owner[~full], minlength=t.n)
    size = np.log2(np.maximum(n, 1)).astype(np.int64)
    every = np.arange(t.n)
    per = np.maximum(n, 1)
    for kind, value in ((11, 20 * distinct // per * 32 + size), (12, 10 * marked // per), (13, t.sizes // per), (14, size)):
        parts.append((every, mix(value.astype(np.uint64) + np.uint64(kind << 40))))
    who = np.concatenate([p[0] for p in parts]).astype(np.int64)
    slot = (np.concatenate([p[1] for p in parts]) % np.uint64(SLOTS)).astype(np.int64)
    key = np.unique(who * SLOTS + slot)
    return key // SLOTS, key % SLOTS


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - margin[:, None], -60, 60)))
        edges = np.concatenate([np.zeros((len(margin), 1)), below, np.ones((len(margin), 1))], 1)
        return np.diff(edges, axis=1)


def fit_ordinal(who: np.ndarray, slot: np.ndarray, y: np.ndarray, grades: int = GRADES, rounds: int = 300, ridge: float = 3e-5, rate: float = 0.5, min_t: float = 4.0) -> Model:
    """Full-batch AdaGrad on the mean negative log likelihood with a ridge.

    Thresholds are a first one and logarithms of positive steps, so they stay in order.
    Only features whose texts' mean grade is ``min_t`` standard errors off the overall mean get
    a weight; the many words of a single text would otherwise be learned by heart.
    """
    n = len(y)
    seen = np.bincount(slot, minlength=SLOTS)
    centred = (y - y.mean()) / max(y.std(), 1e-9)
    pull = np.bincount(slot, centred[who], minlength=SLOTS) / np.sqrt(np.maximum(seen, 1))
    use = (np.abs(pull) >= min_t)[slot] & (seen[slot] >= 3)
    who, slot = who[use], slot[use]
    columns, slot = np.unique(slot, return_inverse=True)
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    cut = np.log(share / (1 - share))
    raw = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 0.1))])
    w, gw, gr = np.zeros(len(columns)), np.full(len(columns), 1e-8), np.full(grades - 1, 1e-8)
    for _ in range(rounds):
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        margin = np.bincount(who, w[slot], minlength=n)
        full = np.concatenate([[-np.inf], theta, [np.inf]])
        upper = 1 / (1 + np.exp(-np.clip(full[y + 1] - margin, -50, 50)))
        lower = 1 / (1 + np.exp(-np.clip(full[y] - margin, -50, 50)))
        upper, lower = np.where(y == grades - 1, 1.0, upper), np.where(y == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = (du - dl) / n  # of the negative log likelihood, by the margin
        grad = np.bincount(slot, slope[who], minlength=len(columns)) + ridge * w
        to_theta = np.zeros(grades + 1)
        np.add.at(to_theta, y + 1, -du / n)
        np.add.at(to_theta, y, dl / n)
        to_theta = to_theta[1:-1]
        to_raw = np.cumsum(to_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
        gw += grad**2
        gr += to_raw**2
        w -= rate * grad / np.sqrt(gw)
        raw -= rate * to_raw / np.sqrt(gr)
    out = np.zeros(SLOTS, np.float32)
    out[columns] = w
    return Model(out, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED) -> Model:
    """A model from at most ``max_rated`` rated documents, chosen by a hash of the id.

    ``ratings`` has doc_id and grade (0 up to GRADES - 1).
    """
    chosen = (
        ratings.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    )

    def hashed(batches):
        for batch, texts in text_chunks(batches):
            who, slot = _features(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(len(texts) + 1)), pa.int32()), pa.array(slot, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["doc_id", "slots", "grade"])

    rated = _rows(docs).join(F.broadcast(chosen), "doc_id")
    got = rated.mapInArrow(hashed, "doc_id long, slots array<int>, grade int").toArrow()
    if not got.num_rows:
        return Model(np.zeros(SLOTS, np.float32), np.zeros(GRADES - 1))
    got = got.sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    lists = got.column("slots").combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    return fit_ordinal(np.repeat(np.arange(len(sizes)), sizes), np.asarray(lists.flatten()).astype(np.int64), np.asarray(got.column("grade")).astype(np.int64))


def classify(docs: DataFrame, model: Model, tail: int = GRADES - 1, min_probability: float = 0.5) -> DataFrame:
    """Expected grade, P(grade >= tail), P(lowest grade) and the selection, per document."""

    def score(batches):
        for batch, texts in text_chunks(batches):
            who, slot = _features(texts)
            p = model.probabilities(np.bincount(who, model.weights[slot].astype(float), minlength=len(texts)))
            p_tail = p[:, tail:].sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(p_tail), pa.array(p[:, 0].copy()), pa.array(p_tail >= min_probability)],
                names=["doc_id", "expected_grade", "p_tail", "p_lowest", "kept"],
            )

    return _rows(docs).mapInArrow(score, "doc_id long, expected_grade double, p_tail double, p_lowest double, kept boolean")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn grades from ``labels`` (doc_id, quality, toxic) and score every document."""
    return classify(docs, fit(docs, labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))))
