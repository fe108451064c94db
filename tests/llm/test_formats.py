"""Token files and chat formatting: exact round trips."""

import zlib

import numpy as np
import pytest

from studyflow.llm import chat, token_files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.vocabulary_path())


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_encode_like_whole_texts(tokenizer, odd_rows):
    encoder = token_files.Encoder(token_files.vocabulary_path(), 2)
    odd = ["İstanbul ΑΣ ΑΣ. don't It'S 123 <|ENDOFTEXT|> <|endoftext|>x a<|startoftext|>b", "á ́b ﬁ \x1c q", "K Å"]
    for text in [r[1] or "" for r in odd_rows] + odd:
        assert np.frombuffer(encoder(text.encode()), encoder.dtype).tolist() == whole(tokenizer, text)


def test_round_trip(spark, odd_docs, odd_rows, tokenizer):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(spark, odd_docs).collect())
    want, start = [], 0
    for doc, text, *_ in sorted(odd_rows, key=lambda r: r[0]):
        ids = whole(tokenizer, text)
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_short_document_access(odd_docs, odd_rows, tokenizer):
    manifest = token_files.write(odd_docs, token_files.vocabulary_path(), 2)
    texts = {r[0]: r[1] for r in odd_rows}
    for row in manifest.collect():
        file = token_files.TokenFile(row.file)
        for doc in set(file.doc_ids.tolist()):
            assert file.find(doc).tolist() == whole(tokenizer, texts[doc])
        with pytest.raises(KeyError):
            file.find(10**9)


def test_other_dictionary_is_refused(odd_docs):
    row = token_files.write(odd_docs, token_files.vocabulary_path(), 2).first()
    folder = row.file.rsplit("/", 1)[0]
    fs, path = token_files.filesystem(folder)
    with fs.open_output_stream(f"{path}/dictionary") as out:
        out.write(b"another")
    with pytest.raises(ValueError):
        token_files.TokenFile(row.file)


def test_token_files_null_ids_and_empty(spark, null_ids, no_docs):
    got = [(r.doc_id, r.n_tokens) for r in token_files.round_trip(spark, null_ids).collect()]
    assert sorted(d for d, _ in got if d is not None) == [3] and len(got) == 3 and min(n for _, n in got) == 1
    assert token_files.round_trip(spark, no_docs).count() == 0


TURNS = "conv_id long, turn int, role string, text string, segment int, length string"


def test_chat_texts_come_back(spark):
    rows = [
        (1, 1, "assistant", "### user: </turn>\n\\ <|image:0|> \\", 0, "x"),
        (1, 0, "user", None, 0, "x"),
        (1, 0, "user", None, 0, "x"),
        (1, None, None, "", 0, "x"),
        (None, 0, "a:b#<", "ü\n" * 3, 0, "x"),
        (2, 5, "assistant", "x" * 100_000 + "#", 0, "x"),
    ]
    frame = spark.createDataFrame(rows, TURNS)
    made = chat.format_chats(chat.text_parts(frame)).collect()
    read = {r.conv_id: chat.parse(r.formatted) for r in made}
    assert read[1] == [("", ""), ("user", ""), ("user", ""), ("assistant", rows[0][3])]
    assert read[None] == [("a:b#<", "ü\n" * 3)]
    for r in made:
        masked = "".join(chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans)
        assert masked == "".join(t for role, t in read[r.conv_id] if role == "assistant")
    assert chat.round_trip(chat.text_parts(frame.limit(0))).count() == 0


def test_control_strings(spark):
    frame = chat.with_control(spark.createDataFrame([], TURNS))
    row = chat.round_trip(chat.text_parts(frame)).first()
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-7, 2, len(chat.CONTROL_ROWS[1][3]))


def test_parts_become_placeholders(spark):
    parts = [
        ("text", "a b", None, None, None, None, None),
        ("image", None, "img/1", 56, 29, None, None),
        ("audio", None, "snd/1", None, None, 2.0, None),
        ("document", None, "doc/1", None, None, None, 3),
        ("text", "<end>", None, None, None, None, None),
    ]
    frame = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn int, role string, parts {chat.PARTS}")
    row = chat.format_chats(frame).first()
    assert row.formatted == "### assistant: a b<|image:0|><|audio:1|><|document:2|>\\<end> </turn>\n"
    got = [(a.attachment["kind"], a.attachment["ref"], a.attachment["tokens"]) for a in row.attachments]
    assert got == [("image", "img/1", 4), ("audio", "snd/1", 50), ("document", "doc/1", 1536)]
    assert row.tokens == 3 + 4 + 50 + 1536


def test_ids_of_capitals_with_marks():
    """A capital and a mark may compose to nothing where the small letter and the mark do."""
    import random

    encoder = token_files.Encoder(token_files.vocabulary_path(), 2)
    rng = random.Random(11)
    letters = "TJHWYaeiouİIſßÄ\u0308\u030c\u0331\u030a\u0323\u0345Ωσς\u1e9e中\u00a0\u2003<.,-"
    texts = ["T\u0308 J\u030c", "", " ", "<s> T\u0308", "A\u030aB"] + [
        "".join(rng.choice(letters + " \n") for _ in range(rng.randint(1, 40))) for _ in range(3000)
    ]
    for text, data in zip(texts, encoder.many([t.encode() for t in texts]), strict=True):
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(data, encoder.dtype).tolist() == [*whole, 2], repr(text)


def test_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 50)
    encoder = token_files.Encoder(token_files.vocabulary_path(), 2)
    texts = ["some words, and more\tof them. " * 20, "x" * 300, " a  b ", "", "y z" * 30]
    for text, data in zip(texts, encoder.many([t.encode() for t in texts]), strict=True):
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(data, encoder.dtype).tolist() == [*whole, 2]


def test_smallest_id_is_not_null(spark):
    docs = spark.createDataFrame([(-(2**63), "a"), (None, "b"), (0, "c")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_files.round_trip(spark, docs).collect()}
    assert set(got) == {None, -(2**63), 0}
