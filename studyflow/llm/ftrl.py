"""Hashed logistic regression trained with follow-the-regularised-leader (FTRL-proximal) updates.

Features are 18-bit hashes, so a model is at most 2**18 float32 weights (1 MB): that is the proven
bound of everything here that is collected or broadcast. Training takes at most ``max_rows`` labelled
rows (the smallest hashes of their ids), as whole texts. Each epoch is one Spark job: every partition
streams its rows' features through FTRL updates that start from the common state, and the partitions' changes
are averaged per coordinate over the partitions that touched it (iterative parameter mixing). No
task holds more than one batch of texts and the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow.llm.common import map_batches, raw_texts, record_batch, stored

BITS = 18
SIZE = 1 << BITS
#: The bias has the last coordinate; hashed features may share it.
BIAS = SIZE - 1


@dataclass(frozen=True)
class Ftrl:
    """Per-coordinate rates alpha / (beta + sqrt(sum of squared gradients)), L1 and L2 strength."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.1

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * self.l1 - z
        w = shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, z: np.ndarray, n: np.ndarray, at: np.ndarray, x: float, label: int) -> None:
        """One row with value ``x`` at the distinct coordinates ``at``; changes z and n in place."""
        zs, ns = z[at], n[at]
        w = self.weights(zs, ns)
        g = (sigmoid(w.sum() * x) - label) * x
        grown = ns + g * g
        z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / self.alpha * w
        n[at] = grown


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


@dataclass(frozen=True)
class Model:
    """Weights, and what turns a text into coordinates and a value."""

    weights: np.ndarray
    extractor: Callable[[], Callable[[bytes], tuple[np.ndarray, float]]]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled documents, smallest id hashes first.

    The choice is made on ids alone; texts are read for chosen rows only.
    """
    ids = (
        labels.select(F.col("doc_id").alias("id_"), F.col(label).cast("int").alias("label_"))
        .where(F.col("label_").isin(0, 1) & F.col("id_").isNotNull())
        .groupBy("id_")
        .agg(F.max("label_").alias("label_"))
        .join(docs.select(F.col("doc_id").alias("id_")).distinct(), "id_", "left_semi")
        .orderBy(F.xxhash64("id_"), "id_")
        .limit(max_rows)
    )
    # At most max_rows pairs of numbers are sent; texts stay where they are.
    docs = docs.select("doc_id", "text")
    return docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id_")).select("doc_id", "text", "label_")


def train(
    rows: DataFrame,
    extractor: Callable[[], Callable[[bytes], tuple[np.ndarray, float]]],
    ftrl: Ftrl,
    epochs: int = 5,
    parts: int = 4,
    purpose: str = "ftrl",
) -> Model:
    """Weights from (doc_id, text, label_); all zero without rows (every score is then 0.5).

    Features are taken once and stored; the epochs read those.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = extractor()
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.float64()), ("at", pa.binary())])
        for batch in batches:
            taken = [features(text) for text in raw_texts(batch.column(1))]
            at = [f[f != BIAS].astype("<i4").tobytes() for f, _ in taken]
            yield record_batch(schema, batch.column(0), batch.column(2), [x for _, x in taken], at)

    taken = map_batches(rows, take, "doc_id long, label int, x double, at binary")
    shared = stored(taken.repartition(parts).sortWithinPartitions(F.xxhash64("doc_id"), "at", "label"), purpose)
    z, n = np.zeros(SIZE), np.zeros(SIZE)

    def epoch(state) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z0, n0 = state.value
            z1, n1 = z0.copy(), n0.copy()
            for batch in batches:
                for y, x, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ftrl.learn(z1, n1, np.append(np.frombuffer(at, "<i4"), BIAS), x, y)
            at = np.flatnonzero((z1 != z0) | (n1 != n0)).astype(np.int32)
            schema = pa.schema([("at", pa.int32()), ("dz", pa.float64()), ("dn", pa.float64())])
            yield record_batch(schema, at, (z1 - z0)[at], (n1 - n0)[at])

        return run

    context = rows.sparkSession.sparkContext
    for _ in range(epochs):
        state = context.broadcast((z, n))
        change = (
            map_batches(shared.select("label", "x", "at"), epoch(state), "at int, dz double, dn double")
            .groupBy("at")
            .agg(F.avg("dz").alias("dz"), F.avg("dn").alias("dn"))
            .toArrow()  # at most SIZE rows
        )
        at = change["at"].to_numpy()
        # Averages come in no fixed order; rounding makes sums of the same numbers the same.
        z[at] = np.round(z[at] + change["dz"].to_numpy(), 9)
        n[at] = np.round(n[at] + change["dn"].to_numpy(), 9)
        state.unpersist()
    return Model(ftrl.weights(z, n).astype(np.float32), extractor)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to (doc_id, score): one sparse dot product a text, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    extractor = model.extractor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = extractor(), shared.value
        bias = float(weights[BIAS])
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            scores = []
            for text in raw_texts(batch.column(1)):
                at, x = features(text)
                scores.append(float(sigmoid((float(weights[at[at != BIAS]].sum(dtype=np.float64)) + bias) * x)))
            yield record_batch(schema, batch.column(0), scores)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id long, score double")


def below(docs: DataFrame, model: Model, at: float) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is below ``at``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    extractor, text_at = model.extractor, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = extractor(), shared.value
        bias = float(weights[BIAS])
        for batch in batches:
            scores = []
            for text in raw_texts(batch.column(text_at)):
                places, x = features(text)
                scores.append(sigmoid((float(weights[places[places != BIAS]].sum(dtype=np.float64)) + bias) * x))
            yield batch.filter(pa.array(np.array(scores) < at))

    return map_batches(docs, run, docs.schema)


def id_remainder(modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
