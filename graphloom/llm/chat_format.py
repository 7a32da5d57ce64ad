"""Chat formatting with typed content parts.

A turn's content is a list of parts. A visitor flattens them in order: text is escaped, and each image, audio or
document part becomes a placeholder, with a record of its reference, its offset in the formatted turn and the tokens
that it will be expanded to. The template marks every turn with its role; control strings inside texts and roles are
escaped so that the output reads back to exactly what went in.

A conversation is digested as a stream: rows are dealt by conversation, sorted by turn within each partition and read
once with a running hash, so memory does not grow with a conversation's length.

Null texts and roles are empty; rows with a null conversation id form one conversation; equal turn numbers are ordered
by role and text; repeated rows are repeated turns; an empty table has no conversations; texts of any length are kept
whole. A digest needs a conversation's turns one after another, so a conversation is read by one task, in constant
memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens an attachment is expanded to: image patches of so many pixels a side, audio frames a second, document tokens a page.
PATCH, FRAMES, PAGE_TOKENS = 28, 25, 512
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """No ``<|`` is left: every ``<``, backslashes, ``|`` gets one more backslash."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_in(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_out(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Attachment:
    kind: str
    ref: str
    offset: int
    tokens: int


@dataclass
class Flattener:
    """Visits parts in order; ``visit_<type>`` appends to the text and records attachments."""

    text: list[str] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)
    length: int = 0
    waiting: list[str] = field(default_factory=list)  # texts that stand side by side are escaped as one

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def _add(self, piece: str) -> None:
        self.text.append(piece)
        self.length += len(piece)

    def visit_text(self, part: dict) -> None:
        self.waiting.append(part.get("text") or "")

    def flush(self) -> None:
        self._add(escape("".join(self.waiting)))
        self.waiting.clear()

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.flush()
        self.attachments.append(Attachment(kind, part.get("ref") or "", self.length, tokens))
        self._add(PLACEHOLDERS[kind])

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, max(1, ceil((part.get("width") or 0) / PATCH) * ceil((part.get("height") or 0) / PATCH)))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, ceil((part.get("seconds") or 0) * FRAMES)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown content part {part.get('type')!r}")


def format_turn(role: str | None, parts: Iterable[dict]) -> tuple[str, tuple[int, int], list[Attachment]]:
    """The formatted turn, the code points of it under the loss mask (an assistant's content), and its attachments."""
    header = f"{START}{_role_in(role or '')}\n"
    flat = Flattener(length=len(header))
    for part in parts:
        flat.visit(part)
    flat.flush()
    mask = (len(header), flat.length) if role == "assistant" else (0, 0)
    return f"{header}{''.join(flat.text)}{END}\n", mask, flat.attachments


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted string; placeholders stay as they are."""
    return [(_role_out(role), unescape(text)) for role, text in _TURN.findall(formatted)]


PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def text_parts(text_col: str = "text"):
    """A plain text column as a list of one text part."""
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("type"), F.col(text_col).alias("text"), *empty.values())).cast(PARTS)


def format_turns(turns: DataFrame, parts_col: str = "parts", role_col: str = "role") -> DataFrame:
    """Columns of ``turns`` but the parts, with formatted, mask_first, mask_last and attachments; no shuffle."""
    @F.pandas_udf("formatted string, mask_first int, mask_last int, attachments array<struct<kind:string,ref:string,offset:int,tokens:int>>")
    def formatted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for roles, parts in batches:
            done = [format_turn(r, ps if ps is not None else ()) for r, ps in zip(roles, parts, strict=True)]
            yield pd.DataFrame({"formatted": [d[0] for d in done], "mask_first": [d[1][0] for d in done], "mask_last": [d[1][1] for d in done], "attachments": [[vars(a) for a in d[2]] for d in done]})

    kept = [c for c in turns.columns if c != parts_col]
    return turns.select(*kept, formatted(role_col, parts_col).alias("__turn")).select(*kept, "__turn.*")


class _Digest:
    """What the query says about a conversation, read back from formatted turns."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, first: int, last: int) -> None:
        self.chars += len(formatted)
        for role, text in read_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if last > first:
            text = unescape(formatted[first:last])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self, conversation) -> tuple:
        return conversation, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def conversation_digests(formatted: DataFrame, id_col: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """One row per conversation from its formatted turns in order."""
    columns = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = object()
        current, digest = nothing, _Digest()
        for frame in frames:
            rows = []
            for conversation, text, first, last in zip(frame["id"], frame["formatted"], frame["mask_first"], frame["mask_last"], strict=True):
                if conversation != current:
                    if current is not nothing:
                        rows.append(digest.row(current[1:] or None))
                    current, digest = conversation, _Digest()
                digest.add(text, first, last)
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        if current is not nothing:
            yield pd.DataFrame([digest.row(current[1:] or None)], columns=columns)

    # ids travel as strings: a null among integers would turn pandas columns into floats
    ordered = formatted.withColumn("id", F.concat(F.lit("k"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).repartition("id").sortWithinPartitions("id", *order)
    found = ordered.select("id", "formatted", "mask_first", "mask_last").mapInPandas(run, f"{id_col} string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return found.withColumn(id_col, F.col(id_col).cast(kind))
