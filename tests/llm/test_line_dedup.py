import hashlib

from brute import line_dedup as brute
from pyspark.sql import functions as F

from studyflow.llm import line_dedup as L


def results(docs):
    found = L.apply_bitmaps(docs, L.keep_bitmaps(docs)).withColumn("sha", F.sha2("kept_text", 256))
    return [(r.doc_id, (r.n_lines, r.n_dropped, r.sha)) for r in found.collect()]


def test_against_brute_force(odd_docs, odd_rows):
    got = results(odd_docs)
    assert len(got) == len(odd_rows)
    want = brute([r[:2] for r in odd_rows])
    assert all(value == want[doc] for doc, value in got)


def test_hot_keys_change_nothing(odd_docs, monkeypatch):
    many = sorted(results(odd_docs))
    monkeypatch.setattr(L, "HOT_KEYS", 1)
    assert sorted(results(odd_docs)) == many


def test_bitmap_runs_cover_kept_lines(odd_docs):
    for r in L.keep_bitmaps(odd_docs).collect():
        kept = sum(run.length for run in r.kept_runs)
        assert kept == r.n_lines - r.n_dropped and r.n_dropped > 0
        ends = [run.start + run.length for run in r.kept_runs]
        assert all(a < b.start for a, b in zip(ends, r.kept_runs[1:], strict=False))


def test_null_ids_come_last(null_ids):
    got = sorted(results(null_ids), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert (3, (1, 0, hashlib.sha256(b"shared line of text and more").hexdigest())) in got
    assert got.count((None, (1, 1, empty))) == 1 and got.count((None, (1, 0, empty))) == 1


def test_empty_table(no_docs):
    assert results(no_docs) == []
