import os
import random
from collections import defaultdict

import numpy as np
import pytest
from brute import jaccard_components, words
from conftest import prose

import corpus_pipeline as P
from studyflow.llm import decontaminate as D
from studyflow.llm.common import stored

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


def smith_waterman(a, b):
    """The textbook recurrence."""
    rows, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, rows[j] + (D.MATCH if x == y else D.MISMATCH), rows[j + 1] - D.GAP, new[j] - D.GAP))
        rows, best = new, max(best, *new)
    return best


def test_alignment_against_the_recurrence():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert D.align(a, b)[0] == smith_waterman(a.tolist(), b.tolist())


def edited(rng, text, share):
    out = []
    for w in text.split():
        roll = rng.random()
        out += [] if roll < share / 3 else ["other"] if roll < 2 * share / 3 else [w, "more"] if roll < share else [w]
    return " ".join(out)


@pytest.fixture(scope="module")
def leaks(spark):
    """Documents with exact, edited, doubled and very many copies of items, and clean ones."""
    rng = random.Random(3)
    items = [(k, prose(7000 + k, 30 + k)) for k in range(20)] + [(90, None), (91, ""), (92, "two words")]
    docs, want = [], set()
    for k in range(200):
        text = prose(k, 150)
        if k % 4 == 0:
            item = items[k % 20]
            cut = text.split()
            text = " ".join(cut[:70]) + " " + edited(rng, item[1], 0.15 if k % 8 else 0).upper() + ".\n" + " ".join(cut[70:])
            want.add((k, item[0]))
        docs.append((k, text))
    docs += [(300 + k, f"{prose(400 + k, 20)} {items[1][1]}") for k in range(100)]
    want |= {(300 + k, 1) for k in range(100)}
    docs += [(500, None), (501, ""), (502, items[3][1]), (502, items[3][1])]
    want.add((502, 3))
    return items, docs, want


def frames(spark, items, docs):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_finds_leaks_and_nothing_else(spark, leaks):
    items, docs, want = leaks
    found = D.contaminations(*frames(spark, items, docs)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    texts, targets = defaultdict(list), dict(items)
    for i, t in docs:
        texts[i].append(t)
    codes = D.word_codes()
    for r in found:
        (doc,), (item,) = (codes.look_up([w.lower() for w in words(t)]) for t in (texts[r.doc_id][0], targets[r.item_id]))
        assert r.score == smith_waterman(item.tolist(), doc.tolist())
        assert smith_waterman(item.tolist(), doc[r.first_word : r.end_word].tolist()) == r.score


def test_blocks_change_nothing(spark, leaks, monkeypatch):
    items, docs, want = leaks
    monkeypatch.setattr(D, "BLOCK_WORDS", 200)
    found = D.contaminations(*frames(spark, items, docs)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want


def test_no_rows(spark, leaks, no_docs, odd_docs):
    items, docs, _ = leaks
    some, benchmark = frames(spark, items, docs)
    assert D.contaminations(no_docs, benchmark).count() == 0
    assert D.contaminations(some, benchmark.limit(0)).count() == 0
    assert D.contaminations(odd_docs, benchmark).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    """Each stage against what it should do with all that the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    rows = {}
    for name, stage in P.STAGES:
        kept = stored(stage(spark, kept, SF), "test")
        rows[name] = kept.collect()
        if name != "sharding":
            assert kept.columns == columns
    names = [n for n, _ in P.STAGES]
    before = [(r.doc_id, r.text) for r in rows[names[0]]]
    first = {i for i, c in jaccard_components(before).items() if i == c}
    assert {r.doc_id for r in rows[names[1]]} == first
    assert {r.doc_id for r in rows[names[2]]} <= first and len(rows[names[2]]) >= 0.8 * len(first)
    total = sum(len(words(r.text)) for r in rows[names[2]])
    assert abs(sum(len(words(r.text)) for r in rows[names[3]]) - 1.5 * total) <= 25
    assert len(rows[names[4]]) == len(rows[names[3]])
    assert P.run(spark, SF).count() == len(rows[names[4]])


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_on_odd_rows(spark, odd_docs, no_docs, name, stage):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    assert stage(spark, no_docs, SF).count() == 0
    found = stage(spark, odd_docs, SF)
    assert found.count() > 0
    if name != "sharding":
        assert found.columns == odd_docs.columns


def test_an_intact_gram_between_rarer_ones_is_a_seed(spark):
    """A copy with every third word replaced, whose only intact 3-grams are more frequent than those around."""
    words = [f"w{k}" for k in range(40)]
    copy = [w if k == 11 or k % 3 < 2 else f"x{k}" for k, w in enumerate(words)]
    docs = [(1, " ".join(copy)), (2, " ".join(words[9:14])), (3, " ".join(words[9:14]))]
    found = D.contaminations(*frames(spark, [(7, " ".join(words))], docs)).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in found] == [(1, 7, smith_waterman(words, copy))]


def test_rows_without_an_id_of_their_own(spark):
    """Equal rows leave one, whatever their ids; others of the same id stay; columns may have any name."""
    text, other, empty = "one two three four five six seven eight", "nothing of the kind is said in this one", "  "
    rows = [(1, text), (1, text), (None, text), (2, text), (1, other), (None, None), (None, empty), (None, empty), (3, "a b c d e f g h")]
    docs = spark.createDataFrame([(*r, "en", "s", 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, row_key int, id_shared int, id int")
    kept = P.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    found = sorted(map(str, (r.text for r in kept.collect())))
    assert found == sorted(map(str, [text, other, None, empty, empty, "a b c d e f g h"]))


def test_contaminated_rows_without_an_id_go(spark, tmp_path):
    passage = " ".join(f"word{k}" for k in range(60))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"before it {passage} and after"), (None, "clean words of another text altogether"), (5, passage), (5, "clean again"), (6, "clean")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, gone_ int")
    kept = P.drop_benchmark_copies(spark, docs, str(tmp_path))
    assert sorted(r.text for r in kept.collect()) == sorted(["clean words of another text altogether", "clean again", "clean"])
