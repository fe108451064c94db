import random

import numpy as np
from brute import repeated_words, words
from conftest import prose
from pyspark.sql import functions as F

from studyflow.llm import outliers as O


def test_statistics_against_brute_force(odd_docs, odd_rows):
    got = [tuple(r) for r in O.statistics(odd_docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
    want = []
    for doc, text, *_ in odd_rows:
        w = words(text)
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        want.append((doc, len(w), sum(len(x.decode()) for x in w), symbols, len(lines) - len(set(lines)), repeated_words(w)))
    assert sorted(got) == sorted(want)


def test_repeats_in_long_random_texts(spark):
    rng = random.Random(2)
    for n, letters in ((50, 2), (400, 3), (3000, 5)):
        w = [rng.choice("abcdefgh"[:letters]).encode() for _ in range(n)]
        codes = O.Codes(100, O.xxhash.xxh3_64_intdigest)
        assert O.repeated_words(codes.look_up(w)[0]) == repeated_words(w)


def rows_of(rng, n, source, mean):
    spread = [40, 5, 5, 5, 30, 30]
    return [(source, 400, *[int(rng.normal(m, s)) for m, s in zip(mean, spread, strict=True)]) for _ in range(n)]


def test_estimate_ignores_planted_outliers(spark):
    """A third of a group far away does not move its centre; the classical mean would move."""
    rng = np.random.default_rng(4)
    good, bad = [1600, 20, 0, 0, 150, 200], [1600, 900, 0, 0, 150, 900]
    rows = rows_of(rng, 1200, "a", good) + rows_of(rng, 600, "a", bad) + rows_of(rng, 500, "b", bad)
    frame = spark.createDataFrame(rows, ["fit_", "n_words", *O.FEATURES]).withColumn("parent_", F.lit(""))
    found = {r.fit_: np.array(r.centre) * O.GRID for r in O.estimates(frame, None).collect()}
    assert np.abs(found["a"] - good).max() < 40 and np.abs(found["b"] - bad).max() < 40


def test_verdicts(spark):
    clean = [(k, prose(k, 60 + k % 200), "en", "s") for k in range(400)]
    junk = [(1000 + k, " | ".join(prose(500 + k, 100).upper().split()), "en", "s") for k in range(60)]
    short = [(2000, "too short", "en", "s"), (2001, "again and again " * 30, "en", "s"), (2002, None, None, None)]
    lone = [(3000, prose(900, 100), "xx", "only one")]
    docs = spark.createDataFrame(clean + junk + short + lone, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: (r.base_failed, r.kept) for r in O.judged(docs).collect()}
    assert sum(kept[k][1] for k, *_ in clean) >= 398
    assert not any(kept[k][1] for k, *_ in junk)
    assert all(kept[k] == (True, False) for k, *_ in short)
    assert kept[3000] == (False, True)  # judged by its language and the corpus


def plain_estimates(rows, priors):
    """rows: {group: (parent, n_words, values)}; the concentration steps with numpy, all rows at hand."""
    state, k = {}, len(O.FEATURES)
    floors = np.diag(np.square(O.FLOORS))
    for group, (_, _, x) in rows.items():
        low, mid, high = (np.percentile(x, q, axis=0) / O.GRID for q in (25, 50, 75))
        state[group] = (mid, np.diag(((high - low) / 1.349) ** 2), 1.0)
    for _ in range(O.STEPS):
        moved, new = 0.0, {}
        for group, (parent, n_words, x) in rows.items():
            centre, cov, _ = state[group]
            off = (x / O.GRID - centre) * np.sqrt(n_words[:, None] / (n_words[:, None] + np.array(O.NOISE_WORDS)))
            d = np.maximum(np.einsum("ri,ij,rj->r", off, np.linalg.inv(cov + floors), off), 2.0**-10)
            bucket = np.floor(np.log2(d) * O.BUCKETS_PER_DOUBLING)
            ordered = np.sort(bucket)
            total = len(x)
            within = x[bucket <= ordered[int(np.ceil(O.SUBSET * total)) - 1]] / O.GRID
            n = len(within)
            m, c = within.mean(0), np.cov(within.T, bias=True).reshape(k, k)
            median = 2.0 ** ((ordered[int(np.ceil(0.5 * total)) - 1] + 0.5) / O.BUCKETS_PER_DOUBLING)
            if priors:
                pm, pc, pd = priors[parent]
                w = n / (n + O.PRIOR_ROWS)
                c = w * c + (1 - w) * pc + w * (1 - w) * np.outer(m - pm, m - pm)
                m, median = w * m + (1 - w) * pm, median**w * pd ** (1 - w)
            new[group] = (m, c, median)
            moved = max(moved, abs(np.linalg.slogdet(c + floors)[1] - np.linalg.slogdet(cov + floors)[1]))
        state = new
        if moved < O.STILL:
            break
    return state


def test_distances_and_verdicts_against_plain_steps(spark):
    """Three levels, groups from one row to some hundreds, null language and source."""
    rng = random.Random(8)
    rows = []
    for k in range(700):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("de", "a"), (None, "a"), ("fr", None)])
        text = prose(k, rng.randint(25, 120))
        if k % 9 == 0:
            text = " ".join(f"{w} &" if rng.random() < 0.5 else w.upper() for w in text.split())
        rows.append((k, text, lang, source))
    rows.append((9000, prose(5, 50), "xx", "lone"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in O.judged(docs).collect()}
    passed = [r for r in found.values() if not r.base_failed]
    keys = [lambda r: ("all",), lambda r: (r.lang,), lambda r: (r.lang, r.source)]
    state = None
    for level, key in enumerate(keys):
        groups = {}
        for r in passed:
            groups.setdefault(key(r), []).append(r)
        table = {
            g: (keys[level - 1](rs[0]) if level else None, np.array([r.n_words for r in rs], float), np.array([[r[f] for f in O.FEATURES] for r in rs], float))
            for g, rs in groups.items()
        }
        state = plain_estimates(table, state)
    floors = np.diag(np.square(O.FLOORS))
    for r in passed:
        centre, cov, median = state[keys[2](r)]
        off = (np.array([r[f] for f in O.FEATURES]) / O.GRID - centre) * np.sqrt(r.n_words / (r.n_words + np.array(O.NOISE_WORDS)))
        distance = off @ np.linalg.inv(cov + floors) @ off * O.CHI2_MEDIAN / median
        assert abs(distance - r.distance) <= 1e-6 * max(1, distance)
        assert r.kept == (distance <= O.CHI2_CUT)
    assert any(not r.kept for r in passed) and all(r.distance is None for r in found.values() if r.base_failed)


def test_null_ids_and_empty(null_ids, no_docs):
    assert [r.kept for r in O.judged(null_ids).collect()] == [False] * 3
    assert O.judged(no_docs).count() == 0
