"""Learned operators against plain re-statements and ratings that were not learned from; the
pipeline on empty, repeated and nameless documents."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from razao.llm import quality_classifier, quality_rules

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture(scope="module")
def documents(store):
    return store.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(store):
    return store.read.parquet(f"{SF}/labels.parquet")


# ---------------------------------------------------------------- 1


def test_verdicts_follow_the_rules_and_hold_on_other_labels(documents, labels):
    seen = labels.where(F.col("doc_id") % 2 == 0)
    rules = quality_rules.fit(documents, seen)
    out = {r.doc_id: r for r in quality_rules.judge(documents, rules).collect()}
    table = quality_rules.with_features(quality_rules.text_statistics(documents)).select("doc_id", *quality_rules.FEATURES).collect()
    x = np.array([[float(r[f]) for f in quality_rules.FEATURES] for r in table])
    first = np.zeros(len(table), int)
    for i, rule in reversed(list(enumerate(rules, 1))):
        first[rule.mask(x)] = i
    for r, rule in zip(table, first, strict=True):
        assert out[r.doc_id].rule == rule and out[r.doc_id].kept == (rule == 0 and not out[r.doc_id].base_failed)
    other = [(r.quality, out[r.doc_id].rule == 0) for r in labels.where((F.col("doc_id") % 2 == 1) & F.col("quality").isNotNull()).collect() if r.doc_id in out]
    good, bad = ([kept for q, kept in other if q == k] for k in (1, 0))
    assert np.mean(good) > 0.85 and np.mean(bad) < 0.5


def test_of_repeated_labels_the_lowest_counts(store, documents, labels):
    few = labels.where("doc_id < 200").select("doc_id", "quality", "toxic")
    worst = few.withColumn("quality", F.lit(0))
    twice = few.withColumn("quality", F.lit(1)).union(worst)
    assert quality_rules.fit(documents, twice) == quality_rules.fit(documents, worst)
    ratings = few.select("doc_id", (F.col("doc_id") % 3).alias("grade"))
    repeated = ratings.union(ratings).union(ratings.withColumn("grade", F.lit(2)))
    a, b = (quality_classifier.fit(documents, r) for r in (ratings, repeated))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


# ---------------------------------------------------------------- 7


def plain_loss(weights, thresholds, x, y, ridge):
    margin = x @ weights
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    p = 1 / (1 + np.exp(-(edges[y + 1] - margin))) - 1 / (1 + np.exp(-(edges[y] - margin)))
    return -np.log(p).mean() + ridge * (weights**2).sum() / 2


def test_the_fit_is_the_best_of_its_neighbourhood():
    rng = np.random.default_rng(3)
    n, slots = 600, 5
    x = (rng.random((n, slots)) < 0.5).astype(float)
    y = np.digitize(x @ np.array([2.0, -1.5, 1.0, 0.0, -2.0]) + rng.logistic(size=n), [-0.7, 1.1])
    who, slot = np.nonzero(x)
    ridge = 1e-3
    model = quality_classifier.fit_ordinal(who, slot, y, rounds=4000, ridge=ridge, min_t=0.0)
    weights, thresholds = model.weights[:slots].astype(float), model.thresholds
    best = plain_loss(weights, thresholds, x, y, ridge)
    for step in (0.2, 0.05):
        for k in range(slots + 2):
            for sign in (1, -1):
                w, t = weights.copy(), thresholds.copy()
                (w if k < slots else t)[k % slots if k < slots else k - slots] += sign * step
                assert plain_loss(w, t, x, y, ridge) > best - 1e-4
    margin = x @ weights
    below = 1 / (1 + np.exp(-(thresholds[None, :] - margin[:, None])))
    want = np.stack([below[:, 0], below[:, 1] - below[:, 0], 1 - below[:, 1]], 1)
    assert np.allclose(model.probabilities(margin), want)
    assert (np.diff(thresholds) > 0).all()


def test_grades_hold_on_ratings_not_learned_from(documents, labels):
    rated = labels.select("doc_id", quality_classifier.grade(F.col("quality"), F.col("toxic")).alias("grade")).where("grade IS NOT NULL")
    model = quality_classifier.fit(documents, rated.where(F.col("doc_id") % 2 == 0))
    got = {r.doc_id: r.expected_grade for r in quality_classifier.classify(documents, model).collect()}
    other = [(r.grade, got[r.doc_id]) for r in rated.where(F.col("doc_id") % 2 == 1).collect() if r.doc_id in got]
    pairs = [0.5 if x == y else float((a < b) == (x < y)) for i, (a, x) in enumerate(other) for b, y in other[:i] if a != b]
    # measured: 0.77 with half of the 399 labels of this table; chance is 0.5
    assert np.mean(pairs) > 0.7


# ---------------------------------------------------------------- pipeline


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_pipeline_of_next_to_nothing(store, tmp_path, rows):
    store.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(store, str(tmp_path)).collect() == []


def test_pipeline_with_repeated_and_nameless_documents(store, documents, tmp_path):
    part = documents.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in DOCS.split(", ")])
    odd = part.where("doc_id < 30").withColumn("doc_id", F.lit(None).cast("long"))
    rows = part.union(part.where("doc_id < 60")).union(odd)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(store, str(tmp_path)).collect()
    ids = {r.doc_id for r in packed}
    assert packed and ids - {None} <= {r.doc_id for r in documents.select("doc_id").collect()}
