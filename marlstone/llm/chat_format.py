"""Chat formatting over typed content parts.

Every turn is a list of parts: text, image, audio or document.  A turn that comes as plain text is parted at its web
addresses: each is an image, audio or document part by its ending.  A visitor flattens the parts, in order, into one body: text is
escaped, each attachment becomes a placeholder `<KIND:TURN.NUMBER>` and is recorded with its reference and the tokens it expands to.
Reading back puts the references of parted texts in the placeholders' places, so the text is whole again.
A turn is `<turn:ROLE>` newline BODY newline `</turn>` newline; in texts a backslash becomes two and `<` becomes `\\l`, so no
control string can occur in a body and the escape is undone without loss.  The loss mask covers the bodies of assistant turns.

A turn is formatted by itself, in the partition it lies in, and a conversation is its turns' pieces in order; digests read a
conversation's pieces back as a stream, so no task holds a whole conversation.

Defined results: a null text is empty; a null role is empty; a null turn sorts first, and turns with one number sort by role,
then text; repeated rows are repeated turns; rows with a null conv_id form one conversation; no rows, no result rows.
Columns other than conv_id, turn, role, text and parts are ignored, whatever their names, and so is a column parts of another
type than PARTS; a part of an unknown type is an error.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ByteBpe, loaded

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
LOSS_ROLE = "assistant"
ADDRESS = r"https?://[^\x00-\x20<>\"']+"
_ADDRESS = re.compile(ADDRESS)
ENDINGS = {"image": ("png", "jpg", "jpeg", "gif", "webp"), "audio": ("mp3", "wav", "ogg", "flac")}
_PLACEHOLDER = re.compile(r"<(?:image|audio|document):-?[0-9]*\.([0-9]+)>")
_TURN = re.compile(r"<turn:([^>]*)>\n(.*?)\n</turn>\n", re.S)
_UNDO = {"\\\\": "\\", "\\l": "<", "\\g": ">", "\\n": "\n"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escape_role(role: str) -> str:
    return escape(role).replace(">", "\\g").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lgn]", lambda m: _UNDO[m[0]], text)


def parts_of(text: str) -> list[dict]:
    """Text and attachment parts of a plain text; their texts and references, joined, are the text."""
    out, at = [], 0
    for m in _ADDRESS.finditer(text):
        ending = m[0].rpartition(".")[2].lower()
        kind = next((k for k, ends in ENDINGS.items() if ending in ends), "document")
        out += [{"type": "text", "text": text[at : m.start()]}, {"type": kind, "ref": m[0]}]
        at = m.end()
    return [*out, {"type": "text", "text": text[at:]}]


@dataclass
class Costs:
    """What attachments expand to, in tokens."""

    image_tile: int = 512
    tokens_per_tile: int = 170
    tokens_per_image: int = 85
    tokens_per_second: float = 25.0
    tokens_per_page: int = 1024


@dataclass
class PartVisitor:
    """count gives a text's tokens; without it texts count none."""

    turn: int | None = None
    costs: Costs = field(default_factory=Costs)
    count: Callable[[str], int] | None = None
    body: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.body.append(escape(text))
        self.tokens += self.count(text) if self.count else 0

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or 1) / self.costs.image_tile) * math.ceil((part.get("height") or 1) / self.costs.image_tile)
        self._attach("image", part, self.costs.tokens_per_image + tiles * self.costs.tokens_per_tile)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 1) * self.costs.tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * self.costs.tokens_per_page)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"content part of type {part['type']!r}")

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.attachments) + 1
        self.body.append(f"<{kind}:{'' if self.turn is None else self.turn}.{number}>")
        self.attachments.append((number, kind, part.get("ref") or "", tokens))
        self.tokens += tokens


def format_turn(role: str, parts: list[dict], turn: int | None = None, costs: Costs | None = None, count: Callable[[str], int] | None = None) -> tuple[str, list, int, int, int]:
    """The piece, its attachments, its expanded tokens, and the loss mask's span in it (empty unless the role is trained on)."""
    visitor = PartVisitor(turn, costs or Costs(), count)
    for part in parts:
        visitor.visit(part)
    head, body = f"<turn:{escape_role(role)}>\n", "".join(visitor.body)
    end = len(head) + len(body) if role == LOSS_ROLE else len(head)
    return f"{head}{body}\n</turn>\n", visitor.attachments, visitor.tokens, len(head), end


def restored(body: str, refs: list[str] | None = None) -> str:
    """The text of a body; with references, each in its placeholder's place."""
    if not refs:
        return unescape(body)
    pieces = _PLACEHOLDER.split(body)
    return "".join(unescape(x) if i % 2 == 0 else refs[int(x) - 1] for i, x in enumerate(pieces))


def read_turns(formatted: str, refs: list[str] | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn in formatted text; without references placeholders stay as they are."""
    return [(unescape(m[1]), restored(m[2], refs)) for m in _TURN.finditer(formatted)]


_PIECES = "conv_id long, turn long, role string, piece string, loss_start int, loss_end int, tokens long, attachments array<struct<number:int,kind:string,ref:string,tokens:long>>"
_ATTACHED = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_turns(conversations: DataFrame, costs: Costs | None = None, tokenizer: tuple | None = None) -> DataFrame:
    """A formatted piece for each row: conv_id, turn, role, piece, loss_start and loss_end (code points), tokens, attachments.

    tokens counts attachments, and with a tokenizer (the arguments of ByteBpe) texts too.
    """
    typed = "parts" in conversations.columns and conversations.schema["parts"].dataType.simpleString() == PARTS
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), "text", *(["parts"] if typed else []))

    def run(batches):
        encoder = loaded(ByteBpe, *tokenizer) if tokenizer else None
        count = (lambda text: len(encoder.encode(text)) // 4) if encoder else None
        for b in batches:
            roles, turns, texts = b["role"].to_pylist(), b["turn"].to_pylist(), b["text"].to_pylist()
            parts = b["parts"].to_pylist() if typed else [None] * len(texts)
            made = [format_turn(r, parts_of(t or "") if p is None else p, n, costs, count) for r, n, t, p in zip(roles, turns, texts, parts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b["conv_id"], b["turn"], b["role"], pa.array([m[0] for m in made], pa.string()), pa.array([m[3] for m in made], pa.int32()), pa.array([m[4] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int64()),
                    pa.array([[dict(zip(("number", "kind", "ref", "tokens"), a, strict=True)) for a in m[1]] for m in made], _ATTACHED),
                ],
                names=["conv_id", "turn", "role", "piece", "loss_start", "loss_end", "tokens", "attachments"],
            )

    return rows.mapInArrow(run, _PIECES)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("tokens", pa.int64())])


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the pieces of format_turns()."""
    order = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece").select("conv_id", "piece", "loss_start", "loss_end", "tokens", F.col("attachments.ref").alias("refs"))

    def run(batches):
        state, done = None, []

        def close():
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6], state[7]))

        for b in batches:
            for conv, piece, a, z, tokens, refs in zip(*(b[c].to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end", "tokens", "refs")), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in read_turns(piece, refs):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                loss = restored(piece[a:z], refs)
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(piece)
                state[6] += len(refs)
                state[7] += tokens
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)

    return order.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, tokens long")
