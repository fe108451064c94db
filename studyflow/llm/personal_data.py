"""Personal data by anchor expansion: spans of e-mail addresses, network addresses, card, phone and account numbers.

One Aho-Corasick automaton finds the places where something personal may be: at-signs, schemes, plus signs before a
digit, dots and links between digits, and identifier cues (``iban``, ``token``, ...). From each anchor a
small deterministic parser grows the span to both sides and validates it (octets, Luhn, number of digits, IBAN
remainder). Parsers only walk over the run of characters their anchor sits in, and runs of one kind do not overlap, so
a text costs time in proportion to its length, where a backtracking search for an address may take the square.

``email``, ``ip``, ``card`` and ``phone`` are the base kinds; each equals the leftmost non-overlapping matches of its
pattern (BASE_PATTERNS), of which those that fail validation are dropped. The method adds what patterns alone do not
tell: ``mailbox`` (at-sign with a host of one label or with letters beyond ASCII), ``url`` (a scheme whose authority
names a user), ``account`` (IBAN, social security or account number after its cue) and ``secret`` (key material after
its cue). Kinds are searched independently; spans of different kinds may overlap.

Defined results: a null or empty text has no spans; whole texts are searched whatever their length; repeated rows and
null ids give a row each; an empty table gives an empty table; other columns are ignored. Offsets count code points,
ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow.llm.common import map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "mailbox", "url", "account", "secret")
# The patterns of the base kinds, whose matches the parsers reproduce.
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cues and the kind they announce; each is looked for in lower, upper and title case.
CUES = {
    "account": ("iban", "ssn", "social security", "account", "acct", "konto", "compte", "cuenta", "passport"),
    "secret": ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "access_key", "bearer"),
}

DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + DIGITS + "._%+-")
SCHEME = LOCAL - frozenset("_%")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ANY_HOST = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*")
OCTETS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"[\x20().0-9-]*")
AUTHORITY = re.compile(r"[^\s/?#\"'<>@]+@[^\s/?#\"'<>@]+")
URL_REST = re.compile(r"[^\s\"'<>]*")
LINK = re.compile(r"[\x20\t]*(?:(?:no\.?|number|nr\.?|is)[\x20\t]*)?[:=#]?[\x20\t]*[\"']?", re.IGNORECASE)
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}")
SOCIAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
NUMBER = re.compile(r"[A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])")
KEY = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")

AT, PLUS, DOT, LINKED, SCHEMED = range(5)
Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """The automaton of all anchors; values are the sort of anchor and its length, or a cue's kind and length."""
    found = ahocorasick.Automaton()
    found.add_word("@", (AT, 1))
    found.add_word("://", (SCHEMED, 3))
    for a in DIGITS:
        found.add_word(f"+{a}", (PLUS, 2))
        for b in DIGITS:
            found.add_word(f"{a}.{b}", (DOT, 3))
            for between in ("", " ", "-"):
                found.add_word(f"{a}{between}{b}", (LINKED, 2 + len(between)))
    for kind, cues in CUES.items():
        for cue in cues:
            for written in (cue, cue.upper(), cue.title(), cue.capitalize()):
                found.add_word(written, (kind, len(written)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    moved = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and short <= "255")


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign; its local part starts at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    host = HOST.match(text, at + 1) if start < at else None
    return (start, host.end()) if host else None


def mailbox_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and (text[start - 1] in LOCAL or text[start - 1].isalnum()):
        start -= 1
    while start < at and not text[start].isalnum():
        start += 1
    host = ANY_HOST.match(text, at + 1) if start < at else None
    return (start, host.end()) if host and host.end() - at > 2 else None


def octets_from(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """Valid addresses in the chain of dotted numbers that begins at ``start``, four numbers each, and its end."""
    chain = OCTETS.match(text, start)
    parts, at, found = chain.group().split("."), start, []
    for k, part in enumerate(parts):
        if k % 4 == 0:
            first, valid = at, True
        valid = valid and _octet(part)
        at += len(part)
        if k % 4 == 3 and valid:
            found.append((first, at))
        at += 1
    return found, chain.end()


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    run = DIALLED.match(text, plus + 2)
    end = plus + 2 + len(run.group().rstrip(" ().-"))
    digits = sum(c in DIGITS for c in text[plus:end]) if end - plus <= 64 else sum(map(text[plus:end].count, DIGITS))
    return (plus, end) if end >= plus + 4 and 9 <= digits <= 15 else None


def url_at(text: str, colon: int) -> tuple[int, int] | None:
    """A web address with a user in its authority."""
    start = colon
    while start > 0 and text[start - 1] in SCHEME:
        start -= 1
    while start < colon and not text[start].isalpha():
        start += 1
    authority = AUTHORITY.match(text, colon + 3) if start < colon else None
    if not authority:
        return None
    end = URL_REST.match(text, authority.end()).end()
    return start, start + len(text[start:end].rstrip(".,;:!?)"))


def after_cue(text: str, kind: str, start: int, end: int) -> tuple[int, int] | None:
    """The value that a cue announces, if it is one."""
    if (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return None
    at = LINK.match(text, end).end()
    if kind == "secret":
        key = KEY.match(text, at)
        value = key.group().rstrip(".") if key else ""
        mixed = any(c in DIGITS for c in value) and any(c.isalpha() for c in value)
        return (at, at + len(value)) if len(value) >= 16 and mixed else None
    found = IBAN.match(text, at)
    if found:
        # The blanks of an IBAN may lead into the next word: the longest prefix of whole groups that is valid.
        value = found.group()
        for cut in [len(value), *(k for k in range(len(value) - 1, 14, -1) if value[k] == " ")]:
            if iban_valid(value[:cut].replace(" ", "").upper()):
                return at, at + cut
        return None
    found = SOCIAL.match(text, at) or NUMBER.match(text, at)
    return (at, found.end()) if found else None


def spans_of(text: str) -> list[Span]:
    """All spans of a text, by kind as in KINDS, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = mailbox_end = octets_end = chain_end = url_end = 0
    for last, (sort, length) in anchors().iter(text):
        start = last + 1 - length
        if sort == LINKED:
            if start >= chain_end:
                chain = CHAIN.match(text, start)
                chain_end = chain.end()
                # 19 digits with a separator after each have 37 characters.
                digits = chain.group().replace(" ", "").replace("-", "") if chain_end - start <= 37 else ""
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((start, chain_end))
        elif sort == AT:
            span = email_at(text, last, email_end)
            if span:
                found["email"].append(span)
                email_end = span[1]
            elif last >= max(email_end, mailbox_end):
                span = mailbox_at(text, last, max(email_end, mailbox_end))
                if span:
                    found["mailbox"].append(span)
                    mailbox_end = span[1]
        elif sort == DOT:
            if start >= octets_end:
                while start > 0 and text[start - 1] in DIGITS:
                    start -= 1
                more, octets_end = octets_from(text, start)
                found["ip"] += more
        elif sort == PLUS:
            span = phone_at(text, start)
            if span:
                found["phone"].append(span)
        elif sort == SCHEMED:
            span = url_at(text, start) if start >= url_end else None
            if span:
                found["url"].append(span)
                url_end = span[1]
        else:
            span = after_cue(text, sort, start, last + 1)
            if span and (not found[sort] or span[0] >= found[sort][-1][1]):
                found[sort].append(span)
    return [(k, a, b) for k in KINDS for a, b in found[k]]


SPAN_TYPE = "array<struct<kind string, start bigint, end bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def personal_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end) of every row."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPAN_TYPE}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(text or "")]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, _ARROW_SPANS)], names=["doc_id", "spans"]
            )

    return map_batches(docs.select("doc_id", "text"), scan, schema)


def redact(text: str | None) -> str | None:
    """``text`` with its spans replaced by their kind in brackets. Overlapping spans go as a whole, under the kind of
    the first (the longest, of those that begin together)."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += (text[at:a], f"[{kind.upper()}]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted texts; all other columns as they are."""
    at = docs.columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            columns = [texts if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_batches(docs, replace, docs.schema)


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_text(of(*BASE_KINDS)), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS[len(BASE_KINDS) :]],
    )
