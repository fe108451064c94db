"""Toxicity and quality classifiers over hashed word n-grams.

Toxicity: words without case and outer punctuation; single words, pairs and skip-pairs (one word
between). A feature counts once and with full weight whatever the length of the text, so that a few
words in a long text still show; L1 sparsity leaves weights for telling features only.

Quality: words without case and outer punctuation, plus each word's shape (capitals, small letters,
digits and punctuation of its first two and last three bytes); single shapes and words, and runs of two and three
shapes. The value of a feature is 1 / sqrt(features), so that long and short texts are on one scale.

Null texts count as empty: they have the bias alone, like texts without words. Repeated rows are
scored each; repeated ids in the labels count once (the larger label). Labels other than 0 and 1 and
labels of unknown documents are not used. Extra columns are ignored. No labels: every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyflow.llm.common import Codes
from studyflow.llm.ftrl import BITS, Ftrl, Model, id_remainder, score, train, training_rows

#: A worker's word table is forgotten past this many words.
KNOWN_WORDS = 400_000
#: At most so many labelled rows are learned from.
MAX_ROWS = 16_000

TOXIC_AT, QUALITY_AT = 0.7, 0.3
TOXIC_HELD_OUT, QUALITY_HELD_OUT = (3, 1), (5, 0)

_SHIFT = np.uint64(64 - BITS)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_OUTER = b"".join(bytes([c]) for c in range(128) if not chr(c).isalnum())


def _core(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word.lower().strip(_OUTER), seed=1)


#: Capitals, small letters (and bytes of other scripts) and digits by class; the rest as it is.
_CLASS = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)
)


def _shape(word: bytes) -> int:
    shape = word.translate(_CLASS)
    return xxhash.xxh3_64_intdigest(shape[:2] + b" " + shape[-3:], seed=2)


def _gram(kind: int, *hashes: np.ndarray) -> np.ndarray:
    mixed = np.full(len(hashes[0]), kind, np.uint64)
    for h in hashes:
        mixed = (mixed ^ h) * _MIX[kind % 4]
        mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MIX[(kind + 1) % 4]) >> _SHIFT).astype(np.int32)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    at = np.sort(np.concatenate(parts))
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


@cache
def _cores() -> Codes:
    """One table a worker process; its words outlive a task."""
    return Codes(KNOWN_WORDS, _core)


@cache
def _cores_and_shapes() -> Codes:
    return Codes(KNOWN_WORDS, _core, _shape)


def toxicity_features() -> Callable[[bytes], tuple[np.ndarray, float]]:
    codes = _cores()

    def features(text: bytes) -> tuple[np.ndarray, float]:
        (w,) = codes.look_up(text.split())
        return _distinct([_gram(0, w), _gram(1, w[:-1], w[1:]), _gram(2, w[:-2], w[2:])]), 1.0

    return features


def quality_features() -> Callable[[bytes], tuple[np.ndarray, float]]:
    codes = _cores_and_shapes()

    def features(text: bytes) -> tuple[np.ndarray, float]:
        w, s = codes.look_up(text.split())
        at = _distinct(
            [_gram(0, w), _gram(3, w[:-1], w[1:]), _gram(4, s), _gram(5, s[:-1], s[1:]), _gram(6, s[:-2], s[1:-1], s[2:])]
        )
        return at, 1.0 / np.sqrt(len(at) + 1.0)

    return features


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    modulus, held = TOXIC_HELD_OUT
    rows = training_rows(docs, labels.where(id_remainder(modulus) != held), "toxic", max_rows)
    return train(rows, toxicity_features, Ftrl(alpha=8.0, l1=3.0, l2=0.01), purpose="toxicity")


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    modulus, held = QUALITY_HELD_OUT
    rows = training_rows(docs, labels.where(id_remainder(modulus) != held), "quality", max_rows)
    return train(rows, quality_features, Ftrl(alpha=4.0, l1=0.02, l2=0.001), purpose="quality")


def scored(docs: DataFrame, model: Model, held_out: tuple[int, int], at: float) -> DataFrame:
    modulus, held = held_out
    return score(docs, model).select(
        "doc_id",
        (id_remainder(modulus) == held).alias("held_out"),
        "score",
        (F.col("score") >= at).cast("int").alias("predicted"),
    )
