"""Quality rules: exact text statistics, two base rules, and robust multivariate outliers.

Documents that pass the base rules are held against the minimum-covariance-determinant (MCD) estimate
of their language and source: mean and covariance of the half of the rows with the smallest
determinant, found by concentration steps. A step is one Spark job: squared Mahalanobis distances
under the current estimate fall into logarithmic buckets, and counts, sums and sums of products are
taken per (group, bucket), reduced before the shuffle. The nearest buckets that hold at least ``h`` rows
give the next estimate. Statistics are transformed, put on a grid of 1/1000 and summed as integers, so
results do not depend on the order of rows. A group of any size is only ever seen as its buckets.

Estimates are made for the corpus, then for each language, then for each language and source. Each takes the one before as
PRIOR_ROWS further rows with that mean and covariance, so a group of n rows weighs n / (n + PRIOR_ROWS) against its
language, and a language so against the corpus: large groups are judged by themselves, small ones by what they belong to,
without a threshold, and every row past the base rules has a distance. Steps go on until no determinant falls any more
(STEPS at most). Short texts have noisier statistics; each is weighed by its own noise (NOISE_WORDS). FLOORS are added to the
variances: a statistic that is the same for most rows would otherwise reject every other value.

Cases: a null text has no words and fails the base rules; null language or source is a group of its
own; repeated rows count and are judged each; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow.llm.common import Codes, map_batches, raw_texts, record_batch, stored

SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
KNOWN_WORDS = 400_000
#: What an estimate's parent counts for, in rows.
PRIOR_ROWS = 200
#: Share of a group's rows in the concentrated subset; concentration steps at most, and the fall of a determinant's
#: logarithm that counts as none.
SUBSET, STEPS, STILL = 0.6, 8, 0.01
#: Transformed statistics and the standard deviation added to each.
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "punctuation")
FLOORS = (0.05, 0.08, 0.30, 0.30, 0.05, 0.05)
GRID = 1000
#: A text of n words has statistics 1 + NOISE_WORDS / n times as variable as a very long one; those that count rare
#: things (symbols, repeats) are steadier.
NOISE_WORDS = (400, 50, 400, 400, 400, 400)
#: Quantiles of chi-squared with six degrees of freedom: the median, and one in a million, twice that being
#: the limit, since the statistics of texts have heavier tails than normal ones.
CHI2_MEDIAN, CHI2_CUT = 5.348, 2 * 38.258
BUCKETS_PER_DOUBLING = 16

_STATS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    *[(f, pa.int32()) for f in FEATURES],
]
_CAPITALS = bytes(range(65, 91))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WINDOW)]


@cache
def word_codes() -> Codes:
    """One table a worker process; its words outlive a task."""
    return Codes(KNOWN_WORDS, xxhash.xxh3_64_intdigest)


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for k, power in enumerate(_POWERS):
        windows += hashes[k : k + n] * power
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows
    edges = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(found)
    edges[starts] += 1
    edges[starts + WINDOW] -= 1
    return int((np.cumsum(edges) > 0).sum())


def describe(text: bytes, codes: Codes) -> tuple[int, ...]:
    words = text.split()
    inside = b"".join(words)
    n, chars = len(words), len(inside) if inside.isascii() else len(inside.decode())
    symbols = len(inside) - len(inside.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(codes.look_up(words)[0])
    capitals = len(inside) - len(inside.translate(None, _CAPITALS))
    punctuation = len(inside) - len(inside.translate(None, _PUNCTUATION))
    per = max(chars, 1)
    values = (
        np.log(per / max(n, 1)),
        np.sqrt(symbols / per),
        np.sqrt(dup_lines / max(len(lines), 1)),
        np.sqrt(repeats / max(n, 1)),
        np.sqrt(capitals / per),
        np.sqrt(punctuation / per),
    )
    return n, chars, symbols, dup_lines, repeats, *(int(round(v * GRID)) for v in values)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the statistics, the transformed statistics) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *_STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes()
        for batch in batches:
            rows = [describe(text, codes) for text in raw_texts(batch.column(3))]
            yield record_batch(schema, *batch.columns[:3], *zip(*rows, strict=True)) if rows else record_batch(
                schema, *batch.columns[:3], *[[] for _ in _STATS]
            )

    names = {pa.int64(): "long", pa.int32(): "int"}
    columns = ", ".join(["doc_id long, lang string, source string", *[f"{n} {names[t]}" for n, t in _STATS]])
    rows = docs.select(
        F.col("doc_id").cast("long"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]
    )
    return map_batches(rows, run, columns)


def fit_keys() -> list[Column]:
    """The corpus, the language, and the language and source of a row, as keys; null is a value of its own."""
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("lang_")
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("source_")
    return [F.lit("all"), F.to_json(F.struct(lang)), F.to_json(F.struct(lang, source))]


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _distance() -> Column:
    """Squared Mahalanobis distance from ``centre`` under the inverse covariance ``inverse``, each statistic against the
    noise that a text of this length has."""
    off = [
        (F.col(f) / GRID - F.col("centre")[i]) * F.sqrt(F.col("n_words") / (F.col("n_words") + NOISE_WORDS[i]))
        for i, f in enumerate(FEATURES)
    ]
    terms = [
        off[i] * off[j] * F.col("inverse")[i * len(FEATURES) + j] * (1 if i == j else 2) for i, j in _PAIRS
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))


def _inverse(covariance: np.ndarray) -> list[float]:
    return np.linalg.inv(covariance + np.diag(np.square(FLOORS))).ravel().tolist()


#: Estimate of a group: its key and its parent's, centre, covariance (without floors), inverse, median distance, log determinant.
_ESTIMATE = (
    "fit_ string, parent_ string, centre array<double>, covariance array<double>, inverse array<double>, "
    "median double, logdet double"
)


def _estimate(fit: str, parent: str, centre: np.ndarray, covariance: np.ndarray, median: float) -> dict:
    floored = covariance + np.diag(np.square(FLOORS))
    return {
        "fit_": fit,
        "parent_": parent,
        "centre": centre.tolist(),
        "covariance": covariance.ravel().tolist(),
        "inverse": np.linalg.inv(floored).ravel().tolist(),
        "median": median,
        "logdet": float(np.linalg.slogdet(floored)[1]),
    }


def _blended(n: float, centre, covariance, median: float, prior) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean and covariance of ``n`` rows together with PRIOR_ROWS rows that have the prior's; medians by their logarithms."""
    other = np.array(prior["prior_centre"], float)
    spread = np.array(prior["prior_covariance"], float).reshape(covariance.shape)
    own, rest = n / (n + PRIOR_ROWS), PRIOR_ROWS / (n + PRIOR_ROWS)
    away = np.outer(centre - other, centre - other)
    mixed = own * covariance + rest * spread + own * rest * away
    return own * centre + rest * other, mixed, float(np.exp(own * np.log(median) + rest * np.log(prior["prior_median"])))


def _concentrate(buckets: pd.DataFrame) -> pd.DataFrame:
    """One group's buckets to its next estimate; at most some thousand rows come in."""
    buckets = buckets.sort_values("bucket")
    counts = buckets["n"].to_numpy()
    reached = np.cumsum(counts)
    total = int(reached[-1])
    near = int(np.searchsorted(reached, SUBSET * total)) + 1
    middle = int(np.searchsorted(reached, 0.5 * total))
    n = float(reached[near - 1])
    sums = np.array([buckets[f"s{i}"].iloc[:near].sum() for i in range(len(FEATURES))], float) / GRID
    centre = sums / n
    covariance = np.zeros((len(FEATURES), len(FEATURES)))
    for i, j in _PAIRS:
        product = float(buckets[f"p{i}_{j}"].iloc[:near].sum()) / GRID**2
        covariance[i, j] = covariance[j, i] = product / n - centre[i] * centre[j]
    median = 2.0 ** ((float(buckets["bucket"].iloc[middle]) + 0.5) / BUCKETS_PER_DOUBLING)
    first = buckets.iloc[0]
    if first["prior_centre"] is not None:
        centre, covariance, median = _blended(n, centre, covariance, median, first)
    return pd.DataFrame([_estimate(first["fit_"], first["parent_"], centre, covariance, median)])


_PRIOR = ["prior_centre", "prior_covariance", "prior_median"]


def _bucketed(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    bucket = F.floor(F.log2(F.greatest(_distance(), F.lit(2.0**-10))) * BUCKETS_PER_DOUBLING)
    sums = [F.sum(F.col(f).cast("long")).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [
        F.sum(F.col(FEATURES[i]).cast("long") * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in _PAIRS
    ]
    return (
        rows.join(estimates.select("fit_", "centre", "inverse"), "fit_")
        .groupBy("fit_", bucket.alias("bucket"))
        .agg(F.count("*").alias("n"), *sums, *products)
    )


def estimates(rows: DataFrame, priors: DataFrame | None) -> DataFrame:
    """Estimates of all groups ``fit_`` of ``rows``; ``priors``: those of their parents ``parent_``, none for the corpus."""
    quartiles = rows.groupBy("fit_", "parent_").agg(
        *[F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f) for f in FEATURES],
    )

    def start(row: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in row:
            out = []
            for _, one in frame.iterrows():
                quarters = np.array([np.array(one[f], float) for f in FEATURES]) / GRID
                spread = (quarters[:, 2] - quarters[:, 0]) / 1.349
                out.append(_estimate(one["fit_"], one["parent_"], quarters[:, 1], np.diag(spread * spread), 1.0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ESTIMATE.split(", ")])

    current = stored(quartiles.mapInPandas(start, _ESTIMATE), "mcd")
    if priors is None:
        prior = current.select("fit_", "parent_", *[F.lit(None).alias(c) for c in _PRIOR])
        kinds = ("array<double>", "array<double>", "double")
        prior = prior.select("fit_", "parent_", *[F.col(c).cast(k) for c, k in zip(_PRIOR, kinds, strict=True)])
    else:
        given = priors.select(
            F.col("fit_").alias("of_"), F.col("centre").alias("prior_centre"),
            F.col("covariance").alias("prior_covariance"), F.col("median").alias("prior_median"),
        )
        prior = current.select("fit_", "parent_").join(given, F.col("parent_") == F.col("of_")).drop("of_")
    prior = stored(prior, "mcd-priors")
    for _ in range(STEPS):
        before = current.select("fit_", F.col("logdet").alias("was"))
        buckets = _bucketed(rows, current).join(prior, "fit_")
        current = stored(buckets.groupBy("fit_").applyInPandas(_concentrate, _ESTIMATE), "mcd")
        moved = current.join(before, "fit_").agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        if moved is None or moved < STILL:
            break
    # The last step's median belongs to distances under the estimate before it, by then the same.
    return current


def judged(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed, distance (null where the base rules fail) and kept of every document."""
    table = stored(statistics(docs), "statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    )
    table = table.withColumn("base_failed", failed)
    keys = fit_keys()
    passed = table.where(~F.col("base_failed"))
    current = None
    for level, key in enumerate(keys):
        parent = keys[level - 1] if level else F.lit("")
        rows = stored(passed.select(key.alias("fit_"), parent.alias("parent_"), "n_words", *FEATURES), "fit-rows")
        current = estimates(rows, current)
    distance = _distance() * CHI2_MEDIAN / F.col("median")
    return (
        table.withColumn("fit_", keys[-1])
        .join(current.drop("parent_"), "fit_", "left")
        .withColumn("distance", F.when(~F.col("base_failed"), distance))
        .withColumn("kept", ~F.col("base_failed") & ~(F.coalesce("distance", F.lit(0.0)) > CHI2_CUT))
    )
