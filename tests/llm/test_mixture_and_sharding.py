import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import mixture_targets, words
from conftest import prose
from pyspark.sql import functions as F

from studyflow.llm import mixture as M
from studyflow.llm import sharding as S


def check_mix(frame, rows, block=M.BLOCK):
    got = [tuple(r) for r in M.Mix(frame, block).taken().collect()]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    target = mixture_targets(dict(sizes))
    of = defaultdict(int)
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(r[0] for r in rows if r[0] is not None)
    by_size = Counter((len(words(t)), sizes[s], round(target[s], 6)) for _, t, s in rows)
    assert Counter((r[1], r[2], round(r[3], 6)) for r in got) == by_size
    for _, size, source_size, goal, taken in got:
        assert 0 <= taken <= 2 * size
        of[(source_size, round(goal, 6))] += taken
    for key, taken in of.items():
        alike = sum(1 for s in sizes if (sizes[s], round(target[s], 6)) == key)
        assert abs(taken - alike * key[1]) <= alike
    return got


def test_mix_of_odd_rows(odd_docs, odd_rows):
    check_mix(odd_docs, [(r[0], r[1], r[3]) for r in odd_rows])


@pytest.mark.parametrize("block", [1, 7, 128])
def test_mix_of_sizes(spark, block):
    rng = random.Random(block)
    rows = [(k, prose(k, rng.choice((0, 1, 9, 40, 300))) or None, rng.choice(("a", "b", "c", "d", None, "z" * 9, "é"))) for k in range(300)]
    rows += [(1000 + k, prose(5000 + k, 200), "hot") for k in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = check_mix(frame, rows, block)
    again = [tuple(r) for r in M.Mix(frame.repartition(5), block).taken().collect()]
    assert sorted(first) == sorted(again)


def test_mix_empty_and_null(no_docs, null_ids):
    assert M.Mix(no_docs).taken().count() == 0 and M.Mix(no_docs).texts(no_docs).count() == 0
    assert M.Mix(null_ids).taken().count() == 3


def test_mixed_texts_hold_the_taken_words(odd_docs):
    mix = M.Mix(odd_docs, 16)
    texts = mix.texts(odd_docs)
    assert texts.columns == odd_docs.columns
    held, want = Counter(), Counter()
    for r in texts.collect():
        held[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    for r in mix.taken().collect():
        want[r.doc_id] += r.taken
    assert +held == +want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    p = M.Permutation(n, 1, 2)
    out = p(np.arange(n))
    assert sorted(out.tolist()) == list(range(n)) and (p.inverse(out) == np.arange(n)).all()


def test_blocks_are_used_evenly(odd_docs):
    mix = M.Mix(odd_docs, 16)
    used = mix.slots.groupBy("sid", "block").count().agg(F.max("count")).first()[0]
    assert used <= 2
    shards = mix.slots.groupBy("sid", "slot").count().where("count > 1").count()
    assert shards == 0


def check_shards(frame, n):
    rows = S.sharded(frame).collect()
    assert len(rows) == n
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(s, ())) for s in range(S.SHARDS)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(S.SHARDS))
    return rows


def test_shards_of_odd_rows(odd_docs, odd_rows):
    rows = check_shards(odd_docs, len(odd_rows))
    want = sorted((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_groups_stay_together(spark):
    """Small groups as wholes, a group of a third of all rows in as few shards as hold it."""
    texts = [f"text {k // 4}" for k in range(800)] + ["hot"] * 800 + [f"alone {k}" for k in range(800)]
    random.Random(1).shuffle(texts)
    rows = check_shards(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), 2400)
    text_of = dict(enumerate(texts))
    where = defaultdict(Counter)
    for r in rows:
        where[text_of[r.doc_id]][r.shard] += 1
    small = [w for t, w in where.items() if t.startswith("text")]
    assert sum(len(w) == 1 for w in small) >= 0.8 * len(small)
    assert sum(sorted(where["hot"].values())[-8:]) >= 0.7 * 800


def test_shards_empty_and_null(no_docs, null_ids):
    assert check_shards(no_docs, 0) == []
    check_shards(null_ids, 3)
