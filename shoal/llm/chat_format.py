"""Chat formatting of messages made of typed content parts.

A message's content is a list of parts: text, image, audio or document. A visitor walks the
parts and flattens them into one string with an ordered placeholder for each attachment; it
records what each placeholder refers to, where it stands and how many tokens it expands to.
Turns are marked with control strings. Adjacent text parts are one run of text, and anything
in a run that could be read as a control string is escaped by a backslash after its ``<``.
No control string can therefore arise where parts meet, and the output can be parsed back
into runs of text and attachments exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|line|>"
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")
_MARK = re.compile(r"<\|(image|audio|document)_(\d+)\|>")

PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.IntegerType()),
    ]
)
ATTACHMENT = "array<struct<placeholder:string,type:string,ref:string,turn:int,start:bigint,tokens:bigint>>"


def escaped(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


@dataclass(frozen=True)
class Template:
    """Token costs of attachments; ``trained`` are the roles whose text is under the loss mask."""

    trained: tuple[str, ...] = ("assistant",)
    image_patch: int = 28
    image_least: int = 4
    audio_rate: float = 25.0
    page_tokens: int = 1024


@dataclass
class PartVisitor:
    """Flattens the parts of a conversation's messages, in order.

    ``out`` is the string so far, in pieces, ``at`` its length; ``runs`` are the spans of the
    current message's runs of text. A run is escaped as a whole, when an attachment or the
    message's end closes it.
    """

    template: Template
    out: list[str] = field(default_factory=list)
    at: int = 0
    attachments: list[dict] = field(default_factory=list)
    runs: list[tuple[int, int]] = field(default_factory=list)
    turn: int = 0
    _run: list[str] = field(default_factory=list)

    def write(self, piece: str) -> None:
        self.out.append(piece)
        self.at += len(piece)

    def message(self, role: str | None, parts: list[dict] | None) -> list[tuple[int, int]]:
        """Writes one message; returns the spans of its runs of text."""
        self.runs = []
        self.write(START + escaped(role or "").replace("\n", LINE) + "\n")
        for part in parts or []:
            self.visit(part or {})
        self._close()
        self.write(END + "\n")
        self.turn += 1
        return self.runs

    def visit(self, part: dict) -> None:
        handle: Callable[[dict], None] | None = getattr(self, f"visit_{part.get('type') or 'text'}", None)
        if handle is None:
            raise ValueError(f"no such part type: {part.get('type')}")
        handle(part)

    def visit_text(self, part: dict) -> None:
        self._run.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        patch = self.template.image_patch
        across, down = (-(-(part.get(side) or 0) // patch) for side in ("width", "height"))
        self._attach("image", part, max(self.template.image_least, across * down))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, int(-(-(part.get("seconds") or 0.0) * self.template.audio_rate // 1)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.template.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._close()
        mark = f"<|{kind}_{len(self.attachments)}|>"
        found = {"placeholder": mark, "type": kind, "ref": part.get("ref"), "turn": self.turn, "start": self.at, "tokens": tokens}
        self.attachments.append(found)
        self.write(mark)

    def _close(self) -> None:
        if self._run:
            start = self.at
            self.write(escaped("".join(self._run)))
            self.runs.append((start, self.at))
            self._run = []


@dataclass(frozen=True)
class Formatted:
    text: str
    loss: list[tuple[int, int]]
    attachments: list[dict]


def format_conversation(messages: list[tuple[str | None, list[dict]]], template: Template) -> Formatted:
    """(role, parts) messages to the marked string and the spans of trained text in it.

    A trained message gives a span for each run of its text; attachments are not in them.
    """
    visitor, loss = PartVisitor(template), []
    for role, parts in messages:
        runs = visitor.message(role, parts)
        if (role or "") in template.trained:
            loss += runs
    return Formatted("".join(visitor.out), loss, visitor.attachments)


@dataclass(frozen=True)
class Attached:
    """An attachment read back: its type and its number in the conversation."""

    type: str
    number: int


def parse(formatted: str) -> list[tuple[str, list[str | Attached]]]:
    """The (role, content) turns of a formatted string; content is runs of text (not empty,
    unescaped) and attachments, in order."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        if not formatted.startswith(START, at) or formatted[end + len(END)] != "\n":
            raise ValueError("not a formatted conversation")
        role = formatted[at + len(START) : line].replace(LINE, "\n")
        turns.append((unescaped(role), _content(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def _content(body: str) -> list[str | Attached]:
    # The pattern's groups make split() give text, type and number by turns.
    pieces = _MARK.split(body)
    out: list[str | Attached] = []
    for i in range(0, len(pieces), 3):
        if pieces[i]:
            out.append(unescaped(pieces[i]))
        if i + 2 < len(pieces):
            out.append(Attached(pieces[i + 1], int(pieces[i + 2])))
    return out


def said(content: list[str | Attached]) -> str:
    """The text of a parsed turn, without attachments."""
    return "".join(x for x in content if isinstance(x, str))


def formatted_conversations(
    messages: DataFrame, template: Template | None = None, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", parts_col: str | None = None
) -> DataFrame:
    """Per conversation: conv_id, n_turns, formatted, loss_spans, attachments.

    Rows of a conversation are ordered by turn, then role, then text (nulls first); repeated
    rows stay. ``parts_col`` holds arrays of PART structs; without it each row is one text
    part. Null texts, roles and parts are empty. Each row with a null conv_id is a
    conversation of its own. Rows arrive sorted and are formatted as they stream by: a task
    holds one conversation at a time, the size of an output row, however long its texts. An
    empty table gives no rows.
    """
    template = template or Template()
    order = [F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role")]
    content = F.col(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("type"), F.col(text_col).cast("string").alias("text")))
    rows = messages.select(*order, (F.col(text_col).cast("string") if parts_col is None else F.to_json(content)).alias("tie"), content.alias("parts"))
    # Rows without a conversation don't belong together.
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "tie")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("alone", alone).repartition("conv_id", "alone")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "tie").select("conv_id", "role", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, done, size = None, [], [], 0
        for batch in batches:
            for conv, role, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (conv is None or conv != current):
                    done.append((current, len(held), format_conversation(held, template)))
                    size += len(done[-1][2].text)
                    held = []
                    if size > 4_000_000:
                        yield packed(done)
                        done, size = [], 0
                current = conv
                held.append((role, parts))
        if held:
            done.append((current, len(held), format_conversation(held, template)))
        yield packed(done)

    def packed(done: list) -> pa.RecordBatch:
        columns = {
            "conv_id": pa.array([d[0] for d in done], pa.int64()),
            "n_turns": pa.array([d[1] for d in done], pa.int64()),
            "formatted": pa.array([d[2].text for d in done], pa.string()),
            "loss_spans": pa.array([[{"start": a, "end": b} for a, b in d[2].loss] for d in done], spans),
            "attachments": pa.array([d[2].attachments for d in done], attached),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    attached = pa.list_(
        pa.struct([("placeholder", pa.string()), ("type", pa.string()), ("ref", pa.string()), ("turn", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64())])
    )
    schema = f"conv_id long, n_turns long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, attachments {ATTACHMENT}"
    return rows.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when read back: turns, their digest, and the masked text's.

    Attachments count for neither digest. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                whole = "".join(f"{role}\n{said(content)}\n" for role, content in turns)
                masked = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                out.append((conv, len(turns), _sha(whole), len(masked), _sha(masked), len(text)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
