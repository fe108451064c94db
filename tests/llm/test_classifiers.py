"""Held-out accuracy on the given labels, and defined results for odd rows."""

import os
import zlib

import numpy as np
import pytest

from studyflow.llm import classifiers as C
from studyflow.llm import ftrl

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def area(scores, labels):
    good = [s for s, y in zip(scores, labels, strict=True) if y]
    bad = [s for s, y in zip(scores, labels, strict=True) if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


@needs_tables
@pytest.mark.parametrize(
    "train, label, held, at, least", [("train_toxicity", "toxic", (3, 1), 0.7, 0.9), ("train_quality", "quality", (5, 0), 0.3, 0.9)]
)
def test_held_out_accuracy(spark, train, label, held, at, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = C.scored(docs, getattr(C, train)(docs, labels), held, at)
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= at) for r in rows)
    modulus, value = held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == value) for r in rows)
    known = {r.doc_id: r[label] for r in labels.collect()}
    apart = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert area(*zip(*apart, strict=True)) >= least


def test_odd_rows_and_labels(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (2, 1, 1), (3, 1, None), (None, 1, 1), (4, 0, 7), (999, 1, 1)], "doc_id long, quality int, toxic int"
    )
    for train in (C.train_quality, C.train_toxicity):
        model = train(odd_docs, labels)
        rows = ftrl.score(odd_docs, model).collect()
        assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in odd_rows)
        same = {r.score for r in rows if r.doc_id in (4, 5, 6)}
        assert len(same) == 1  # texts without words have the bias alone
        assert ftrl.score(no_docs, model).count() == 0
        assert sorted(ftrl.below(odd_docs, model, 2.0).collect(), key=str) == sorted(odd_docs.collect(), key=str)


def test_no_labels(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = C.train_toxicity(odd_docs, labels)
    assert {r.score for r in ftrl.score(odd_docs, model).collect()} == {0.5}


def test_training_is_repeatable(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 14)], "doc_id long, quality int, toxic int")
    first, second = (C.train_quality(odd_docs, labels).weights for _ in range(2))
    assert np.array_equal(first, second)


def test_l1_leaves_few_weights():
    rule, z, n = ftrl.Ftrl(alpha=1.0, l1=1.0), np.zeros(ftrl.SIZE), np.zeros(ftrl.SIZE)
    rng = np.random.default_rng(3)
    for k in range(400):
        noise = rng.integers(10, 5000, 30)
        rule.learn(z, n, np.unique(np.append(noise, 1 if k % 2 else 2)), 1.0, k % 2)
    weights = rule.weights(z, n)
    assert weights[1] > 0.5 > -0.5 > weights[2] and (weights != 0).sum() < 1500


def test_columns_with_names_of_its_own(spark, odd_docs):
    from pyspark.sql import functions as F

    docs = odd_docs.withColumn("id_", F.lit(5)).withColumn("label_", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 14)], "doc_id long, quality int, toxic int")
    assert np.array_equal(C.train_toxicity(docs, labels).weights, C.train_toxicity(odd_docs, labels).weights)
