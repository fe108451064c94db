"""Chat formatting: typed content parts flattened by a visitor, a reversible template, a loss mask.

A turn is a list of parts: text, image, audio or document. A visitor turns each into its place in
the text: text is escaped, an attachment becomes a placeholder numbered within its turn. Beside the
text it records the attachments' references in order and the tokens the turn expands to. Turns are
rendered where they are; one shuffle by conversation then places them, by a running sum of their
lengths, and joins them. A conversation is one output record, so it meets in one task; nothing else does.

Template: ``### role: text </turn>`` and a line break per turn. Backslashes, ``#`` and ``<`` inside texts
and roles (and ``:`` in roles) get a backslash, so none of the template's strings can occur in a text,
and taking the backslashes away gives the text again. The loss mask holds the [start, end) of each
assistant turn's text, in code points.

Cases: null texts and parts without a value are empty; a null role is empty; turns with one number are
ordered by role and content, null numbers first; repeated rows are turns each; a null conversation id
is a conversation; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyflow.llm.common import map_batches, record_batch, stored

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
LOSS_ROLE = "assistant"
#: Expansion of attachments: image patches of PATCH x PATCH pixels, audio frames a second, tokens a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def escape(text: str, more: str = "") -> str:
    for c in "\\#<" + more:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class PartVisitor:
    """Flattens one turn's parts, in order."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[tuple[int, str, str | None, int]] = []
        self.tokens = 0

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part['kind']}", None)
        if method is None:
            raise ValueError(f"unknown part {part['kind']!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        text = part["text"] or ""
        self.pieces.append(escape(text))
        self.tokens += len(text.encode().split())

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, math.ceil((part[x] or 0) / PATCH)) for x in ("width", "height"))
        self._attach(part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, max(1, math.ceil((part["seconds"] or 0.0) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(1, part["pages"] or 0) * PAGE_TOKENS)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append((len(self.attachments), part["kind"], part["ref"], tokens))
        self.pieces.append(f"<|{part['kind']}:{len(self.attachments) - 1}|>")
        self.tokens += tokens


def text_parts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the text as the turn's only part."""
    part = "named_struct('kind', 'text', 'text', CAST(text AS STRING), 'ref', NULL, 'width', NULL, 'height', NULL, 'seconds', NULL, 'pages', NULL)"
    return conversations.select("conv_id", "turn", "role", F.expr(f"CAST(array({part}) AS {PARTS})").alias("parts"))


_ATTACHMENTS = pa.list_(
    pa.struct([("at", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
)


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to one formatted segment a turn."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("turn", pa.int64()),
            ("role", pa.string()),
            ("segment", pa.string()),
            ("length", pa.int64()),
            ("masked", pa.list_(pa.int64())),
            ("attachments", _ATTACHMENTS),
            ("tokens", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, masks, attachments, tokens = [], [], [], []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                visitor = PartVisitor()
                for part in parts or []:
                    if part is not None:
                        visitor.visit(part)
                head = f"### {escape(role or '', ':')}: "
                body = "".join(visitor.pieces)
                segments.append(f"{head}{body} </turn>\n")
                masks.append([len(head), len(head) + len(body)] if role == LOSS_ROLE else None)
                attachments.append(
                    [dict(zip(("at", "kind", "ref", "tokens"), a, strict=True)) for a in visitor.attachments]
                )
                tokens.append(visitor.tokens)
            lengths = [len(s) for s in segments]
            yield record_batch(schema, *batch.columns[:3], segments, lengths, masks, attachments, tokens)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "parts")
    return map_batches(
        rows,
        run,
        "conv_id long, turn long, role string, segment string, length long, masked array<long>, "
        "attachments array<struct<at:int,kind:string,ref:string,tokens:long>>, tokens long",
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, tokens) a conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "segment")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = render(turns).select(
        "*", F.row_number().over(order).alias("at"), (F.sum("length").over(so_far) - F.col("length")).alias("offset")
    )
    span = F.when(
        F.col("masked").isNotNull(),
        F.struct((F.col("offset") + F.col("masked")[0]).alias("start"), (F.col("offset") + F.col("masked")[1]).alias("end")),
    )
    references = F.transform("attachments", lambda a: F.struct(F.col("turn").alias("turn"), a.alias("attachment")))
    joined = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "segment"))).alias("segments"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
        F.sort_array(F.collect_list(F.struct("at", references.alias("of")))).alias("references"),
        F.sum("tokens").alias("tokens"),
    )
    return joined.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["segment"]), "").alias("formatted"),
        "loss_spans",
        F.flatten(F.transform("references", lambda r: r["of"])).alias("attachments"),
        "tokens",
    )


TURN = re.compile(r"### ((?:\\.|[^\\:#<])*): ((?:\\.|<\||[^\\<])*) </turn>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; raises if anything is left over."""
    turns, at = [], 0
    while at < len(formatted):
        match = TURN.match(formatted, at)
        if match is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when read back: turns, hashes, text under the mask."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                said = "".join(f"{role}\n{content}\n" for role, content in turns)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), _sha256(said), len(learned), _sha256(learned), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield record_batch(schema, batch.column(0), *columns)

    return map_batches(
        formatted.select("conv_id", "formatted", "loss_spans"),
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def round_trip(turns: DataFrame) -> DataFrame:
    return digests(stored(format_chats(turns), "chats"))


#: A conversation whose texts hold the template's own strings.
CONTROL_ROWS = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def with_control(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    return rows.unionByName(rows.sparkSession.createDataFrame(CONTROL_ROWS, rows.schema))


SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
    SELECT *, 4 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 2
           + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 9 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
