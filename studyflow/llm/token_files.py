"""Token ids as binary files: one zstandard frame a document, a shared dictionary, an offset index.

Layout of a file: a header (magic, bytes an id, SHA-256 of the dictionary), the documents' frames in
ascending order of (doc_id, text hash), a compressed index (doc_id, frame offset, ids so far) and a
footer that says where the index begins and how many documents, the first ones, have no id. A reader takes the index with two small reads and then any
single document with one more. The dictionary lies beside the files and is checked against its hash.

Texts are range-partitioned by id and sorted before they are encoded, so a file is one partition and
a task holds one Arrow batch, one frame and its index. Each attempt of a task writes a file of its own
name; only files named by the manifest count, and Spark commits the manifest's rows, so a repeated
task or a lost executor leaves at most an unused file. Ids before a file come from one total per file.

Encoding goes by distinct words through a bounded table, which is right for vocabularies that drop white
space; ``whole_text=True`` encodes texts as one.

Cases: null and empty texts have the end id alone; null ids come first and are read back as null;
repeated rows are kept each; an empty table gives a manifest without rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyflow.llm.common import map_batches, raw_texts, record_batch, stored
from studyflow.session import shared_dir

MAGIC = b"TOKIDS1\n"
FOOTER = "<QQQ8s"
LEVEL = 3
#: The dictionary: its size, and the documents (smallest id hashes) and bytes of ids it is trained on.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES, PIECE_BYTES = 64 << 10, 1000, 8 << 20, 4 << 10
#: A worker's table of encoded words is forgotten past this many words.
KNOWN_WORDS = 1_000_000
#: Bytes of text whose words are looked up together.
SLICE = 8 << 20
WHITE = re.compile(rb"[ \t-\r]")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Encoder:
    """Texts to serialised ids (little-endian, as wide as the vocabulary needs), ``end_id`` appended."""

    def __init__(self, vocabulary: str, end_id: int, whole_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.whole_text = whole_text
        self.dtype = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.end = np.array([end_id], self.dtype).tobytes()
        lowers = '"type":"Lowercase"' in self.tokenizer.to_str(pretty=False)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Words may be looked up in lower case unless a text may hold an added token.
        self.lower_unless = b"<" if lowers and all(t.startswith(b"<") for t in added) else None
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        #: Which ids end a word; None where ids do not tell.
        self.ends = None
        if suffix:
            vocabulary_ids = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary_ids.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary_ids.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids. Plain words (letters, and a full stop or comma) go through the tokenizer as one text, which takes half the
        time, and are told apart by the ids that end a word."""
        plain: list[str] = []
        lengths, rest = [], []
        for word in words if self.ends is not None else []:
            if word.isalpha():
                plain.append(word)
                lengths.append(1)
            elif word[-1] in ".," and word[:-1].isalpha():
                plain.append(word)
                lengths.append(2)
            else:
                rest.append(word)
        if len(plain) > 1:
            found = self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)
            ids = np.array(found[0].ids)
            ends = np.flatnonzero(self.ends[ids]) + 1
            lasts = np.cumsum(lengths)
            if len(ends) == lasts[-1]:
                data = ids.astype(self.dtype).tobytes()
                cuts = [0, *(ends[lasts - 1] * self.dtype.itemsize).tolist()]
                yield from zip(plain, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True)
                words = rest
        yield from zip(words, self._encode(words), strict=True)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def __call__(self, text: bytes) -> bytes:
        return next(self.many([text]))

    def many(self, texts: list[bytes]) -> Iterator[bytes]:
        """Serialised ids of each text, with the end id. Texts are taken together up to SLICE bytes, longer ones in
        slices cut at white space: distinct words are looked up once a slice and gathered with arrays."""
        if self.whole_text:
            yield from (self._encode([text.decode()])[0] + self.end for text in texts)
            return
        held, size = [], 0
        for text in texts:
            if len(text) > SLICE:
                yield from self._together(held)
                held, size = [], 0
                yield b"".join(x[: -len(self.end)] for x in self._together(slices(text))) + self.end
                continue
            held.append(text)
            size += len(text)
            if size > SLICE:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _lowered(self, text: bytes) -> bytes:
        """A-Z in lower case where that changes no id: the tokenizer lower-cases too, but composes characters before
        it does, and a capital may have no composed form with a mark that its small letter has one with. Marks that compose
        with ASCII letters lie in U+0300 to U+036F, so their UTF-8 begins with these two bytes."""
        if self.lower_unless is None or self.lower_unless in text or b"\xcc" in text or b"\xcd" in text:
            return text
        return text.lower()

    def _together(self, texts: list[bytes]) -> Iterator[bytes]:
        if not texts:
            return
        column = pa.array(list(map(self._lowered, texts)), pa.binary()).cast(pa.string())
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
                new = words
            self.known[""] = b""
            self.known.update(self._encode_words([w for w in new if w]))
        parts = [*map(self.known.__getitem__, words), self.end]
        pool = np.frombuffer(b"".join(parts), self.dtype)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        # The end id is a word of its own behind the words of each text.
        ends = split.offsets.to_numpy()[1:]
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(parts) - 1)
        lengths = sizes[codes]
        after = np.cumsum(lengths)
        ids = pool[np.repeat(starts[codes] - (after - lengths), lengths) + np.arange(after[-1])]
        cuts = [0, *after[ends + np.arange(len(ends))].tolist()]
        yield from (ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False))


def slices(text: bytes) -> list[bytes]:
    """A long text in parts of about SLICE bytes, cut at white space."""
    out, start = [], 0
    while len(text) - start > SLICE:
        space = WHITE.search(text, start + SLICE)
        if not space:
            break
        out.append(text[start : space.start()])
        start = space.start()
    return [*out, text[start:]]


@cache
def shared_encoder(vocabulary: str, end_id: int, whole_text: bool) -> Encoder:
    """One encoder a worker process, whose words outlive a task."""
    return Encoder(vocabulary, end_id, whole_text)


def id_type(vocabulary_size: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary_size <= 1 << 16 else "<u4")


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, whole_text: bool) -> bytes:
    """A zstandard dictionary from at most SAMPLE_ROWS documents; plain ids where training finds too
    little, nothing without ids. One task trains; at most DICTIONARY_BYTES come back."""
    ids = (
        docs.select(F.col("doc_id").alias("id_")).distinct().orderBy(F.xxhash64("id_"), "id_").limit(SAMPLE_ROWS)
    )
    sample = stored(
        docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("id_")), "left_semi").select("doc_id", "text"), "token-sample"
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces, size = shared_encoder(vocabulary, end_id, whole_text), [], 0
        for batch in batches:
            for text in raw_texts(batch.column(1)):
                data = encoder(text)
                for at in range(0, len(data), PIECE_BYTES):
                    if size < SAMPLE_BYTES:
                        pieces.append(data[at : at + PIECE_BYTES])
                        size += len(pieces[-1])
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
        except zstandard.ZstdError:  # too few pieces
            dictionary = b"".join(pieces)[:DICTIONARY_BYTES]
        yield record_batch(pa.schema([("dictionary", pa.binary())]), [dictionary])

    rows = sample.coalesce(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    return next((bytes(r["dictionary"]) for r in map_batches(rows, train, "dictionary binary").collect()), b"")


def compression_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write(
    docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, whole_text: bool = False
) -> DataFrame:
    """Write token files under ``folder`` (shared) and return the manifest:
    (part, file, n_docs, n_tokens, base), base being the ids in all files before."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    dictionary = train_dictionary(docs, vocabulary, end_id, whole_text)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary") as out:
        out.write(dictionary)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, path = filesystem(folder)
        name = f"{path}/ids-{part:06d}-{os.urandom(8).hex()}.bin"
        encoder = shared = compressor = out = None
        ids, offsets, counts = [], [], []
        at = nulls = 0
        for batch in batches:
            if out is None:
                encoder = shared_encoder(vocabulary, end_id, whole_text)
                shared = compression_dictionary(dictionary)
                compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
                out = fs.open_output_stream(name)
                header = MAGIC + bytes([encoder.dtype.itemsize]) + hashlib.sha256(dictionary).digest()
                out.write(header)
                at = len(header)
            nulls += batch.column(0).null_count
            encoded = encoder.many(raw_texts(batch.column(1)))
            for doc_id, data in zip(batch.column(0).to_pylist(), encoded, strict=True):
                frame = compressor.compress(data)
                out.write(frame)
                ids.append(doc_id or 0)
                offsets.append(at)
                counts.append(len(data) // encoder.dtype.itemsize)
                at += len(frame)
        if out is None:
            return
        index = np.array(ids, "<i8").tobytes() + np.array(offsets, "<u8").tobytes() + np.array(counts, "<u8").tobytes()
        out.write(zstandard.compress(index))
        out.write(struct.pack(FOOTER, at, len(ids), nulls, MAGIC))
        out.close()
        schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        yield record_batch(schema, [part], [os.path.basename(name)], [len(ids)], [sum(counts)])

    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .withColumn("tie_", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie_")
        .sortWithinPartitions("doc_id", "tie_")
        .select("doc_id", "text")
    )
    files = stored(
        map_batches(ordered, save, "part int, file string, n_docs long, n_tokens long"), "token-manifest"
    )
    # One row a file: small however large the corpus.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        "part",
        F.concat(F.lit(f"{folder}/"), "file").alias("file"),
        "n_docs",
        "n_tokens",
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"),
    )


class TokenFile:
    """Random access to one file: ``ids(k)`` reads the k-th document's frame only."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        with fs.open_input_stream(f"{os.path.dirname(path)}/dictionary") as file:
            dictionary = file.read()
        header = self.file.read_at(len(MAGIC) + 33, 0)
        if header[: len(MAGIC)] != MAGIC or header[-32:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a token file of this dictionary")
        self.dtype = np.dtype(f"<u{header[len(MAGIC)]}")
        size, footer = self.file.size(), struct.calcsize(FOOTER)
        end, n, self.nulls, magic = struct.unpack(FOOTER, self.file.read_at(footer, size - footer))
        if magic != MAGIC:
            raise ValueError(f"{uri}: cut short")
        index = zstandard.decompress(self.file.read_at(size - footer - end, end))
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.offsets = np.append(np.frombuffer(index, "<u8", n, 8 * n).astype(np.int64), end)
        self.counts = np.frombuffer(index, "<u8", n, 16 * n).astype(np.int64)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=compression_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        frame = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        return np.frombuffer(self.decompressor.decompress(frame), self.dtype)

    def find(self, doc_id: int) -> np.ndarray:
        """Ids of the first document with this id, by binary search in the index."""
        k = self.nulls + int(np.searchsorted(self.doc_ids[self.nulls :], doc_id))
        if k == len(self.doc_ids) or self.doc_ids[k] != doc_id:
            raise KeyError(doc_id)
        return self.ids(k)


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        )
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(uri)
                sums = []
                for k in range(len(file.doc_ids)):
                    ids = file.ids(k)
                    if len(ids) != file.counts[k]:
                        raise ValueError(f"{uri}: document {k} has {len(ids)} ids, its index says {file.counts[k]}")
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                starts = base + np.cumsum(file.counts) - file.counts
                doc_ids = pa.array(file.doc_ids, mask=np.arange(len(file.doc_ids)) < file.nulls)
                yield record_batch(schema, doc_ids, starts, file.counts, sums)

    files = manifest.select("file", "base")
    # One task a file; the manifest alone is too small for Spark to see the work.
    files = files.repartitionByRange(max(1, min(manifest.count(), 1 << 16)), "file")
    return map_batches(files, load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(spark: SparkSession, docs: DataFrame, end_id: int = 2) -> DataFrame:
    return read(write(docs, vocabulary_path(), end_id))
