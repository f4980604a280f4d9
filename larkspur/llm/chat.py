r"""Chat formatting of typed content parts.

A message is a role and ordered parts: text, image, audio or document. A visitor turns each part into text or into a
numbered placeholder, and notes each attachment's reference and the tokens that it will expand to. A turn is

    <|turn|>ROLE<|says|>BODY<|end|>

and a conversation's text is its turns in order. Control strings of this and of other common templates can't occur in
ROLE or BODY: a backslash is put after their first character, and backslashes are doubled. ``read_turn`` undoes this.
The loss mask covers the bodies of assistant turns.

Cases: a null text is an empty one, a null role an empty role; a null list of parts has none. Turns are ordered by
number, nulls first, then by their formatted text. A null conv_id is a conversation. An unknown kind of part raises an
error. Extra columns are ignored.

Scale: messages are formatted and read back where they lie. Only the digests need a conversation in order: they read
it as a stream of sorted batches, so a conversation of any length takes the memory of one batch. A SHA-256 of a
conversation is sequential by nature: its hashing alone can't be split among tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROLS = ("<|", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>")
PART = "struct<kind:string,value:string,units:bigint>"
ATTACHMENT = "struct<slot:int,kind:string,ref:string,tokens:bigint>"
_GUARD = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_UNGUARD = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.S)
_SLOT = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    return _GUARD.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNGUARD.sub(r"\1", text)


@dataclass
class Flatten:
    """Visits a message's parts in order. Units are pixels of an image, milliseconds of audio, pages of a document."""

    body: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind']}")(part)

    def visit_text(self, part: dict) -> None:
        self.body.append(escape(part["value"] or ""))

    def visit_image(self, part: dict) -> None:
        self._attach(part, max(1, -(-(part["units"] or 0) // 784)))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, max(1, -(-(part["units"] or 0) // 40)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, 512 * max(1, part["units"] or 0))

    def _attach(self, part: dict, tokens: int) -> None:
        slot = len(self.attachments)
        self.body.append(f"<|{part['kind']}:{slot}|>")
        self.attachments.append({"slot": slot, "kind": part["kind"], "ref": part["value"], "tokens": tokens})


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, list[dict]]:
    """The turn's text and its attachments."""
    seen = Flatten()
    for part in parts:
        seen.visit(part)
    return f"{TURN}{escape(role or '')}{SAYS}{''.join(seen.body)}{END}", seen.attachments


def read_turn(formatted: str) -> tuple[str, list[dict]]:
    """Role and parts of a formatted turn; attachments by slot."""
    role, body = _TURN.fullmatch(formatted).groups()
    parts, at = [], 0
    for m in _SLOT.finditer(body):
        if m.start() > at:
            parts.append({"kind": "text", "value": unescape(body[at : m.start()])})
        parts.append({"kind": m[1], "slot": int(m[2])})
        at = m.end()
    if at < len(body):
        parts.append({"kind": "text", "value": unescape(body[at:])})
    return unescape(role), parts


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [format_turn(role, parts or []) for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        shape = pa.list_(pa.struct([("slot", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
        loss = pa.array([role == "assistant" for role in batch.column(2).to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in done], pa.string()), loss, pa.array([a for _, a in done], shape)], ["conv_id", "turn", "formatted", "loss", "attachments"])


def format_messages(messages: DataFrame, parts: str | None = None, text: str = "text") -> DataFrame:
    """conv_id, turn, formatted, loss, attachments, expanded_tokens for each message. parts: a column of arrays of
    ``PART``; without one, the text is the only part."""
    own = F.col(parts) if parts else F.array(F.struct(F.lit("text").alias("kind"), F.col(text).alias("value"), F.lit(None).cast("long").alias("units")))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", own.cast(f"array<{PART}>").alias("parts"))
    done = rows.mapInArrow(_format, f"conv_id long, turn long, formatted string, loss boolean, attachments array<{ATTACHMENT}>")
    return done.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns, said = [], []
        for formatted in batch.column(2).to_pylist():
            role, parts = read_turn(formatted)
            text = "".join(p["value"] for p in parts if p["kind"] == "text")
            turns.append(f"{role}\n{text}\n")
            said.append(len(role) + 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turns, pa.string()), pa.array(said, pa.int32())], [*batch.schema.names, "told", "said_at"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal conv_id in sorted rows; holds hash states, never a conversation."""
    key: list = []
    state: dict = {}
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def done() -> list:
        return [key[0], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["length"]]

    def out(rows: list[list]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        rows = []
        for conv, length, loss, told, at in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if not key or key[0] != conv:
                if key:
                    rows.append(done())
                key[:] = [conv]
                state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0}
            state["n"] += 1
            state["turns"].update(told.encode())
            state["length"] += length
            if loss:
                text = told[at:-1]
                state["chars"] += len(text)
                state["loss"].update(text.encode())
        if rows:
            yield out(rows)
    if key:
        yield out([done()])


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted turns."""
    read = formatted.select("conv_id", "turn", "formatted", "loss").mapInArrow(_read_back, "conv_id long, turn long, formatted string, loss boolean, told string, said_at int")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "told"]
    rows = read.select("conv_id", "turn", F.length("formatted").cast("long").alias("length"), "loss", "told", "said_at").repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "length", "loss", "told", "said_at").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
