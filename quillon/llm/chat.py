"""Chat formatting: a visitor flattens typed content parts into one marked string with loss spans and attachments."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The strings that the template or a tokenizer could take for marks, and the marks used here.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
OPEN, MIDDLE, CLOSE = "<|turn:", "|>", "<|end|>"
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256  # pixels a patch side, tokens a second, tokens a page

_MARK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\?)")
_SEGMENT = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(MIDDLE) + r"(.*)" + re.escape(CLOSE), re.S)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document|unknown):(\d+)\|>")

PART = "struct<kind string, text string, ref string, width int, height int, seconds double, pages int>"


def escape(text: str) -> str:
    """Doubles backslashes, then puts one behind the first character of each control string, which breaks it."""
    return _MARK.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattened:
    """The visitor: one method for each kind of part. ``tokens`` counts what placeholders expand to."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind']}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        side = lambda n: math.ceil((n or 0) / IMAGE_PATCH)
        self._attach("image", part, side(part["width"]) * side(part["height"]))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part["seconds"] or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part["pages"] or 0) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        """A part of another kind, or null: an attachment without tokens, so that nothing is lost silently."""
        self._attach("unknown", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.pieces.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append((len(self.attachments), kind, part["ref"] or "", tokens))
        self.tokens += tokens


def segment(role: str | None, parts: list[dict] | None) -> tuple[str, int, int, Flattened]:
    """A turn's string, and where the text between its marks starts and ends."""
    flat = Flattened()
    for part in parts or []:
        flat.visit(part or {"kind": None, "ref": None})
    head, body = f"{OPEN}{escape(role or '')}{MIDDLE}", "".join(flat.pieces)
    return head + body + CLOSE, len(head), len(head) + len(body), flat


def read_parts(formatted: str) -> tuple[str, list[tuple[str, str | int]]]:
    """(role, parts) of a turn's string: ("text", text) and, for an attachment, (its kind, its position).

    A placeholder is told from a text that says the same, as control strings inside texts are escaped.
    """
    role, body = _SEGMENT.fullmatch(formatted).groups()
    found = _PLACEHOLDER.split(body)  # text, kind, position, text, ...
    parts: list[tuple[str, str | int]] = [("text", unescape(found[0]))] if found[0] else []
    for kind, position, text in zip(found[1::3], found[2::3], found[3::3], strict=True):
        parts += [(kind, int(position)), *([("text", unescape(text))] if text else [])]
    return unescape(role), parts


def read_back(formatted: str) -> tuple[str, str]:
    """(role, text) of a turn's string, without its attachments."""
    role, parts = read_parts(formatted)
    return role, "".join(value for kind, value in parts if kind == "text")


FORMATTED = "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long, attachments array<struct<position int, kind string, ref string, tokens int>>, attachment_tokens long"


def text_parts(turns: DataFrame) -> DataFrame:
    """Turns with a plain ``text`` column, as one text part each; null text is empty."""
    nothing = "cast(null as string) ref, cast(null as int) width, cast(null as int) height, cast(null as double) seconds, cast(null as int) pages"
    part = F.expr(f"array(named_struct('kind', 'text', 'text', coalesce(text, ''), {', '.join(repr(x.split()[-1]) + ', ' + x.rsplit(' ', 1)[0] for x in nothing.split(', '))}))")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", part.cast(f"array<{PART}>").alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row for each turn (conv_id, turn, role, parts): ``FORMATTED``.

    A conversation is the concatenation of its turns' strings in order; loss_start and loss_end span an
    assistant's text and are null elsewhere. Null roles and parts are empty; other columns are ignored,
    whatever their names. An empty table gives no rows.
    Turns are formatted one by one, so a conversation of any length needs no more memory than a turn.
    """
    schema = turns.select(F.lit(None).cast("struct<" + FORMATTED.replace(" long", ": long").replace(" string", ": string").replace("attachments array", "attachments: array") + ">").alias("x")).select("x.*").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "formatted": pa.string(), "loss_start": pa.int64(), "loss_end": pa.int64(), "attachments": pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])), "attachment_tokens": pa.int64()}
        for batch in batches:
            columns = {name: [] for name in ("formatted", "loss_start", "loss_end", "attachments", "attachment_tokens")}
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                string, start, end, flat = segment(role, parts)
                learn = role == "assistant"
                row = (string, start if learn else None, end if learn else None, [dict(zip(("position", "kind", "ref", "tokens"), a, strict=True)) for a in flat.attachments], flat.tokens)
                for values, value in zip(columns.values(), row, strict=True):
                    values.append(value)
            arrays = [batch.column(n) for n in ("conv_id", "turn", "role")] + [pa.array(columns[n], type=types[n]) for n in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=list(types))

    return turns.select("conv_id", "turn", "role", "parts").mapInArrow(run, schema)


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the strings.

    Rows are dealt out by conversation and sorted by turn (null first, equal turns by their strings), then
    hashed as they stream by: a conversation of any length takes the memory of one batch. Null ids make
    one conversation; repeated turns are turns. An empty table gives no rows. A text of any length is one turn's
    string.
    """
    dealt = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current, state = None, None
        for batch in batches:
            done = []
            for conv, string, start, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, *_closed(state)))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(string)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(string)
                if start is not None:
                    learnt = unescape(string[start:end])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], type=t) for i, t in enumerate(types)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip((current, *_closed(state)), types, strict=True)], names=names)

    return dealt.mapInArrow(run, schema)


def _closed(state: list) -> tuple:
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
