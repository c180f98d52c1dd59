"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns of a conversation are read in order from a sorted partition, one at a time, so a conversation of any
length needs memory for one turn only. Every turn gives text segments with a loss flag each; joined, the segments
of a conversation are its formatted text, from which ``read_back`` recovers roles and texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``opening`` role ``after_role`` text ``closing`` for each turn.

    Inside roles and texts, ``escape`` is put before itself and before each character that a marker starts with, so no
    marker can occur there and taking the escapes away gives the text back.
    """

    opening: str = "### "
    after_role: str = ": "
    closing: str = "</turn>\n"
    escape: str = "\\"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state -> role -> next state; a role that is not listed leads to ``invalid``
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: frozenset[str] = frozenset({"answered"})

    def protect(self, text: str) -> str:
        firsts = {m[0] for m in (self.opening, self.after_role, self.closing, self.escape)}
        return re.sub("[" + re.escape("".join(sorted(firsts))) + "]", lambda m: self.escape + m[0], text)

    def plain(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def turn_pattern(self) -> re.Pattern:
        """One formatted turn; a marker's first character is never an escaped one."""
        e = re.escape(self.escape)
        body = lambda marker: f"((?:[^{e}{re.escape(marker[0])}]++|{e}.)*+)"
        return re.compile(re.escape(self.opening) + body(self.after_role) + re.escape(self.after_role) + body(self.closing) + re.escape(self.closing), re.DOTALL)


def format_conversations(convs: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments (conv_id, segment, text, loss, state), in order inside their partition.

    All conversations are formatted, whatever their turn order; ``state`` is the machine's state after the turn, and a
    conversation is valid if it ends in an accepting state. Null roles and texts are empty, a null turn comes first, turns with one
    number follow by role and text, repeated rows are turns of their own, null identifiers are one conversation.
    """
    rows = convs.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, state = (), 0, "start"
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if current != (conv,):
                    current, number, state = (conv,), 0, "start"
                state = template.turns.get(state, {}).get(role, "invalid")
                head = template.opening + template.protect(role) + template.after_role
                for piece, loss in ((head, False), (template.protect(text), role in template.loss_roles), (template.closing, False)):
                    out.append((conv, number, piece, loss, state))
                    number += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.bool_(), pa.string()))], ["conv_id", "segment", "text", "loss", "state"])

    id_type = rows.schema["conv_id"].dataType.simpleString()
    return order.mapInArrow(run, f"conv_id {id_type}, segment long, text string, loss boolean, state string")


def read_back(segments: DataFrame, template: Template = Template(), in_order: bool = False) -> DataFrame:
    """One row per conversation from its formatted text: counts and digests of the turns and of the text under the loss mask.

    ``in_order`` says that the segments come straight from ``format_conversations``; others are sorted first.
    """
    rows = segments if in_order else segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = template.turn_pattern()
        current = None

        def row():
            if current["rest"]:
                raise ValueError(f"conversation {current['conv'][0]} doesn't read back: {current['rest'][:80]!r}")
            return (current["conv"][0], current["turns"], current["all"].hexdigest(), current["chars"], current["loss"].hexdigest(), current["length"], current["state"] in template.accepting)

        kind = None
        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for conv, text, loss, state in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "state"))):
                if current is None or current["conv"] != (conv,):
                    if current:
                        out.append(row())
                    current = {"conv": (conv,), "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0, "rest": "", "state": ""}
                current["length"] += len(text)
                current["state"] = state
                if loss:
                    plain = template.plain(text)
                    current["chars"] += len(plain)
                    current["loss"].update(plain.encode())
                current["rest"] += text
                if text.endswith(template.closing) and (turn := pattern.fullmatch(current["rest"])):
                    current["turns"] += 1
                    current["all"].update("".join(template.plain(x) + "\n" for x in turn.groups()).encode())
                    current["rest"] = ""
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types(kind))], names)
        if current:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), types(kind))], names)

    def types(kind):
        return (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    id_type = segments.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
