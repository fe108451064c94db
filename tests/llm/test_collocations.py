"""Summaries and their guarantee, exact counts and scores against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from studyflow.llm import collocations as C


def pieces_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[\x20\x09]+", p) if w] for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def plain(rows, threshold=C.THRESHOLD, absorbed=C.ABSORBED, top=C.TOP):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        scored = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and p in [q[i : i + len(p)] for i in range(len(q))]]
            if any(100 * b >= absorbed * a for b in longer):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(docs, **options):
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in C.collocations(docs, **options).select(*columns).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["The", "of", "new", "York", "city", "über", "ÄR", "a-b", "x\xa0y", "\x1cz", "é"]
    made = [
        ("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None, "ü"]))
        for _ in range(150)
    ]
    return [*made, (None, "en"), ("", None), ("New York City " * 500, "en"), ("one two. " * 9, "fr"), ("one two three\n" * 10, "es")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, k, 1, "p", 2) for k, r in enumerate(rows)], "text string, lang string, doc_id long, f int, phrase string, n int")


def test_equals_plain(spark, rows):
    assert found(frame(spark, rows)) == plain(rows)


def test_other_settings(spark, rows):
    assert found(frame(spark, rows), threshold=25, absorbed=80, top=7) == plain(rows, 25, 80, 7)


def test_small_summaries_lose_nothing(spark, rows, monkeypatch):
    """Capacities that force decrements, and partitions that follow."""
    monkeypatch.setattr(C, "HELD", 500)
    monkeypatch.setattr(C, "SLICE", 90)
    assert found(frame(spark, rows), capacity=40) == plain(rows)


def test_empty_and_odd(spark, no_docs, odd_docs, odd_rows):
    assert C.collocations(no_docs).count() == 0
    assert found(odd_docs, threshold=2) == plain([(r[1], r[2]) for r in odd_rows], 2)


def test_summary_guarantee():
    rng = np.random.default_rng(3)
    stream = np.concatenate([rng.integers(0, 4000, 30000), np.repeat(np.arange(5000, 5030), 40), np.zeros(20000, int)]).astype(np.uint64)
    rng.shuffle(stream)
    true = Counter(stream.tolist())
    summary = C.Summary(len(stream) // 20 // 4)
    for part in np.array_split(stream, 37):
        summary.merge(*([x] for x in np.unique(part, return_counts=True)))
        assert len(summary.counts) <= summary.capacity
    assert 0 < summary.error * (summary.capacity + 1) <= summary.mass == len(stream)
    kept = dict(zip(summary.hashes.tolist(), summary.counts.tolist(), strict=True))
    for item, n in true.items():
        assert n - summary.error <= kept.get(item, 0) <= n
    frequent = {item for item, n in true.items() if n >= summary.error + 1}
    assert frequent <= set(summary.survivors(summary.error + 1)[0].tolist())


def test_bit_filter(spark):
    hashes = [0, 1, -1, 1 << 62, -(1 << 63), 12345678901234567]
    bits = C.bit_filter(spark.createDataFrame([(h, 1) for h in hashes], "hash long, counter long"), 1 << 12)
    slots = {(h & 0xFFFFFFFFFFFFFFFF) >> 52 for h in hashes}
    assert {k for k in range(1 << 12) if int(bits[k >> 6]) >> (k & 63) & 1} == slots
    assert not C.bit_filter(spark.createDataFrame([], "hash long, counter long"), 1 << 12).any()


def test_large_counts_are_exact(spark):
    a, left, right = 3_000_000_019, 3_000_000_021, 3_500_000_111
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    out = df.select(C.exact("a") * C.exact("a") * 1000000, C.exact("l") * C.exact("r"))
    assert [int(x) for x in out.first()] == [a * a * 1000000, left * right]
