"""The trie and its rolled-up totals against plain Python, with rounds on Spark and within tasks."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from studyflow.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, up string, mass string"


def plain(rows):
    """Nodes of the trie by the contract's words."""
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    turns = {c: [(r.decode(), x.decode()) for *_, r, x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(base, [])[:h] + mine[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = {}
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(node))))
        out[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None,
            len(convs),
            sum(len(n) == len(node) + 1 for n in below),
            len(leaf),
            saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def spark_nodes(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return {(r[0], r[1]): tuple(r[2:]) for r in P.trie(df).collect()}


ODD = [
    (5, 0, "user", "a"), (5, 1, "assistant", "b"), (5, 1, "assistant", "b"), (5, None, None, "first"), (5, 2, "user", None),
    (6, 0, "user", "a"), (6, 3, "user", "é" * 20000), (7, 0, "user", ""), (10, 0, None, None), (11, 0, None, None),
    (-7, 0, "user", "x"), (-5, 0, "user", "x"), (-5, 1, "b", "y"), (-5, 1, "a", "y"), (None, 0, "user", "lost"), (4, 0, "z", "z"),
]


def test_odd_rows(spark):
    assert spark_nodes(spark, ODD) == plain(ODD)


def test_empty(spark):
    assert spark_nodes(spark, []) == {}


@pytest.fixture(scope="module")
def many():
    """Copies, a long chain, and a bushy trie over two turns."""
    rng = random.Random(4)
    rows = [(c, t, "user", rng.choice("ab")) for c in range(60) for t in range(rng.randint(1, 14))]
    rows += [(c, t, "user", f"line {t}") for c in (100, 200) for t in range(90)]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(10)]
    return rows


@pytest.mark.parametrize("local_mass", [3, 40, 10**6])
def test_totals_by_rounds_and_in_tasks(spark, many, monkeypatch, local_mass):
    solved = P.subtree_totals
    monkeypatch.setattr(P, "subtree_totals", lambda nodes, paths, values: solved(nodes, paths, values, local_mass))
    assert spark_nodes(spark, many) == plain(many)


def test_running_totals_across_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.randint(-5, 9)) for k in range(4000)]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    got = {r["k"]: r["v"] for r in P.running_totals(df, "g", ["k"], ["v"], ["k"], "test").collect()}
    sums = defaultdict(int)
    for g, k, v in rows:
        sums[g] += v
        assert got[k] == sums[g]


def test_member_lists_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_BYTES", 100)
    df = spark.createDataFrame([(1, 2, m) for m in range(500)] + [(4, 0, 9)], "conv_id long, depth long, member long")
    got = {r[0]: r[2] for r in P.end_digests(df).collect()}
    assert got[1] == hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    assert got[4] == hashlib.sha256(b"9").hexdigest()
