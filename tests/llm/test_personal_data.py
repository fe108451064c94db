"""Anchored parsers against a search with the base patterns, added kinds, redaction and odd rows."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studyflow.llm import personal_data as P


def searched(text):
    """The base spans by regular expression, as the contract states them."""
    out = []
    for kind, pattern in P.BASE_PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }
            if fits[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return [s for s in P.spans_of(text) if s[0] in P.BASE_KINDS]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aB@.+- ()0123459%_é\n=:/", max_size=60))
def test_base_spans_equal_a_search(text):
    assert base(text) == searched(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0125.- +", max_size=70))
def test_base_spans_of_numbers_equal_a_search(text):
    assert base(text) == searched(text)


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("write to root@localhost now", "mailbox", "root@localhost"),
        ("an jörg@müller.de.", "mailbox", "jörg@müller.de"),
        ("see https://bob:pw@host.com/x?y=1.", "url", "https://bob:pw@host.com/x?y=1"),
        ("IBAN: DE89 3704 0044 0532 0130 00 and", "account", "DE89 3704 0044 0532 0130 00"),
        ("my SSN is 123-45-6789.", "account", "123-45-6789"),
        ("Account no. 12345678", "account", "12345678"),
        ('TOKEN = "B44E15E09FD311C3CF31"!!', "secret", "B44E15E09FD311C3CF31"),
    ],
)
def test_added_kinds(text, kind, value):
    (span,) = [s for s in P.spans_of(text) if s[0] == kind]
    assert text[span[1] : span[2]] == value


@pytest.mark.parametrize(
    "text",
    ["a @ b", "IBAN: DE89 3704 0044 0532 0130 01", "tokens of 1234567890123456", "https://host.com/a", "the account is closed",
     "secretary of state0123456789abcdef", "3.14 and 2.71", ""],
)
def test_nothing_personal(text):
    assert P.spans_of(text) == []


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 300_000, "a@b" * 100_000, "://" * 100_000, "token " * 50_000):
        assert base(text) == [] or len(base(text)) > 0


def test_redaction():
    assert P.redact("mail a.b@c.org or +1 (499) 555-6503.") == "mail [EMAIL] or [PHONE]."
    assert P.redact(None) is None
    assert P.redact("https://bob@host.com/x") == "[URL]"


def test_rows_and_digest(spark, odd_docs, no_docs, null_ids):
    found = P.digest(P.personal_spans(odd_docs))
    assert found.count() == odd_docs.count()
    assert P.digest(P.personal_spans(no_docs)).count() == 0
    assert P.personal_spans(null_ids).where("doc_id is null").count() == 2
    docs = spark.createDataFrame([(1, "é a@b.co 1.2.3.4 root@here", "x"), (2, None, "y")], "doc_id long, text string, spans string")
    one, two = P.digest(P.personal_spans(docs)).orderBy("doc_id").collect()
    assert one["spans"] == "email:2:8,ip:9:16,mailbox:17:26" and (one["n_email"], one["n_ip"], one["n_mailbox"]) == (1, 1, 1)
    assert two["spans"] == "" and two["n_email"] == 0
    hashed = spark.range(1).select(F.sha2(F.lit("email:2:8,ip:9:16"), 256)).first()[0]
    assert one["base_sha256"] == hashed
    assert [r["text"] for r in P.redacted(docs).orderBy("doc_id").collect()] == ["é [EMAIL] [IP] [MAILBOX]", None]


def test_query_equals_a_search_on_all_documents(spark):
    import hashlib

    from studyflow.llm.queries import op12_personal_data

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12_personal_data(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = searched(texts[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in expected)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.BASE_KINDS] == [sum(s[0] == k for s in expected) for k in P.BASE_KINDS]
        assert set(text.split(",")) <= set(r["spans"].split(",")) | {""}
