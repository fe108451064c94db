import random

import pytest
from brute import jaccard_components, shingle_set
from conftest import prose

from studyflow.llm import jaccard_join as J


def results(docs):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in J.linked_components(docs).collect()]


def check(spark, rows):
    got = results(spark.createDataFrame(rows, "doc_id long, text string"))
    want = jaccard_components(rows)
    assert sorted(got) == sorted((i, len(shingle_set(t)), want[i]) for i, t in rows)


def test_odd_rows(odd_docs, odd_rows):
    want = jaccard_components([r[:2] for r in odd_rows])
    assert sorted(results(odd_docs)) == sorted((r[0], len(shingle_set(r[1])), want[r[0]]) for r in odd_rows)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + rng.randint(0, 2)] = [f"w{rng.randrange(1000)}"] * rng.randint(0, 2)
    return words


def test_chains_of_edits_around_the_limit(spark):
    """Copies at every distance, so that clusters, their pivots and open pairs all have work to do."""
    rng, rows = random.Random(5), []
    for base in range(12):
        words = prose(base + 50, rng.choice((6, 12, 40, 120, 300))).split()
        for step in range(14):
            rows.append((len(rows) * 3, " ".join(words)))
            rows.append((len(rows) * 3, " ".join(edited(rng, words, 1 + step % 4))))
            words = edited(rng, words, max(1, len(words) // 60))
    rng.shuffle(rows)
    check(spark, rows)


def test_shared_passages_do_not_link(spark):
    passage = prose(9, 60)
    rows = [(k, f"{prose(100 + k, 15 + k % 30)} {passage}") for k in range(60)]
    check(spark, rows)


def test_loose_clusters_lose_no_link(spark, monkeypatch):
    """Grouping by any similarity at all must not change the result."""
    monkeypatch.setattr(J, "ALIKE", 0.3)
    test_chains_of_edits_around_the_limit(spark)
    test_shared_passages_do_not_link(spark)


@pytest.mark.parametrize(
    ("shifts", "groups"),
    [
        ({1: 0, 2: 9, 3: 18}, [(3, 1)]),  # a stray of the first cluster links to the second pivot
        ({1: 0, 2: 9, 3: 18}, [(1, 3)]),
        ({1: 0, 2: 10, 3: -20, 4: -30}, [(3, 1), (4, 2)]),  # strays of both clusters link to each other alone
    ],
)
def test_strays_of_linked_pivots(spark, monkeypatch, shifts, groups):
    """Pivots that link leave the members that do not link to their own pivot to be compared."""
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(words[40 + at : 40 + at + 94])) for i, at in shifts.items()]
    monkeypatch.setattr(J, "clusters", lambda sets: spark.createDataFrame(groups, "rep long, cluster long"))
    check(spark, rows)


def test_null_ids(null_ids):
    assert sorted(results(null_ids), key=str) == sorted([(None, 2, None), (3, 2, 3), (None, 0, None)], key=str)


def test_empty_table(no_docs):
    assert results(no_docs) == []


def loose_group(copies, seed):
    """Copies of one text 0.05 to 0.35 apart from it; few of the far ones link to any other."""
    rng, base, rows = random.Random(seed), [f"b{k}" for k in range(150)], [(0, " ".join(f"b{k}" for k in range(150)))]
    for i in range(1, copies):
        words = list(base)
        for k in rng.sample(range(150), rng.randint(1, 6)):
            words[k] = f"x{i}_{k}" if rng.random() < 0.8 else ""
        rows.append((i, " ".join(words)))
    return rows


def test_a_large_loose_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Hubs and lost tokens settle most of a loose group; no link is lost."""
    compared, exact, copies = [], J.similarities, 600

    def counted(pairs, sets):
        compared.append(pairs.count())
        return exact(pairs, sets)

    monkeypatch.setattr(J, "similarities", counted)
    check(spark, loose_group(copies, 3))
    assert sum(compared) < copies * copies // 10


def test_far_copies_link_to_each_other_alone(spark):
    """Pairs that share their edits, too far from the text of all others to link to it."""
    rng, rows = random.Random(8), loose_group(120, 4)
    for k in range(30):
        words = [f"b{k}" for k in range(150)]
        for at in rng.sample(range(150), 9):
            words[at] = f"y{k}_{at}"
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, " ".join([*words[:-1], f"end{k}"]))]
    check(spark, rows)


def test_sets_that_only_share_a_passage_are_not_made(spark, monkeypatch):
    """Rare passages shared with a set of another size: no pair can link, so no whole set is written or shuffled."""
    made, compared, whole, exact = [], [], J.whole_sets, J.similarities

    def written(docs, ids):
        made.append(whole(docs, ids).count())
        return whole(docs, ids)

    def counted(pairs, sets):
        compared.append(pairs.count())
        return exact(pairs, sets)

    monkeypatch.setattr(J, "whole_sets", written)
    monkeypatch.setattr(J, "similarities", counted)
    tails, rows = [" ".join(f"{t}{k}" for k in range(n)) for t, n in (("short", 60), ("long", 120))], []
    for k in range(20):
        passage = " ".join(f"p{k}_{i}" for i in range(60))
        rows += [(2 * k + i, f"{passage} {tail}") for i, tail in enumerate(tails)]
    check(spark, rows)
    assert sum(made) < 4
    assert sum(compared) < 4


def test_rows_among_ids(spark):
    """A first look: every row that is asked for, and few others."""
    rows = spark.range(-5000, 5000).selectExpr("id", "id % 7 AS other")
    ids = spark.range(-5000, 5000, 50).union(spark.range(0, 100, 50))
    found = [(r.id, r.other) for r in J.among(rows, "id", ids).collect()]
    assert {i for i, _ in found} >= set(range(-5000, 5000, 50))
    assert len(found) == len(set(found)) < 210
    assert {o for _, o in found} <= {r.other for r in rows.collect()}
    assert J.among(rows, "id", ids.limit(0)).count() == 0
