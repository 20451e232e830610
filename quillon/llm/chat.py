"""Chat formatting: a finite-state machine over roles, a declarative template, per-segment loss flags.

Each turn becomes three segments (head, body, end); the body of a role in `loss` is under the loss mask.
Bodies are escaped, so no control string of the template stands in one, and reading back is exact.
Turns are ordered by turn (nulls first), then role and text, so ties have a defined order. Null roles and
texts are empty. Turns that the machine refuses are formatted all the same; the conversation is then marked
not valid. Conversations are streamed from sorted partitions: memory is a few times the longest turn's text.
Repeated rows are turns each. Rows without conv_id are one conversation, of no id. An empty table gives no rows.
Only conv_id, turn, role and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, partitions_for


@dataclass(frozen=True)
class Template:
    head: str = "### {role}: "
    end: str = " </turn>\n"
    escape: str = "\\"
    #: Characters that get the escape before them in bodies and roles: the first of each control string.
    guarded: str = "\\#<:"
    loss: frozenset = frozenset({"assistant"})
    #: state -> role -> next state; a conversation is valid if no turn is refused and it ends in a final state.
    moves: dict = field(default_factory=lambda: {"start": {"system": "primed", "user": "asked"}, "primed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: frozenset = frozenset({"answered"})

    def guard(self, text: str) -> str:
        return re.sub(f"([{re.escape(self.guarded)}])", lambda m: self.escape + m[1], text)

    def plain(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def turn(self) -> re.Pattern:
        """One formatted turn; its groups are the guarded role and body."""
        free = f"((?:{re.escape(self.escape)}.|[^{re.escape(self.guarded)}])*)"
        before, after = self.head.split("{role}")
        return re.compile(re.escape(before) + free + re.escape(after) + free + re.escape(self.end), re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        before, after = self.head.split("{role}")
        return [(before + self.guard(role) + after, False), (self.guard(text), role in self.loss), (self.end, False)]


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("refused", pa.bool_())])


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, seq, text, loss, refused: the segments of every conversation, in order of seq.

    refused marks the head of a turn that the machine refuses, and the end of a last turn in no final state.
    """
    n = partitions_for(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, state, seq = none, "start", 0
        held: list[tuple] = []

        def end() -> None:
            if now is not none:
                c, s, t, loss, _ = held[-1]
                held[-1] = (c, s, t, loss, state not in template.final)

        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                role, text = role or "", text or ""
                if conv != now:
                    end()
                    now, state, seq = conv, "start", 0
                after = template.moves.get(state, {}).get(role)
                for k, (segment, loss) in enumerate(template.segments(role, text)):
                    held.append((conv, seq, segment, loss, not k and after is None))
                    seq += 1
                state = after or state
            if len(held) > 1:
                yield batch_of(held[:-1])
                del held[:-1]
        end()
        if held:
            yield batch_of(held)

    rows = turns.select("conv_id", "turn", "role", "text").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, seq long, text string, loss boolean, refused boolean")


def batch_of(rows: list[tuple], schema: pa.Schema = SEGMENTS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def read_conversations(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid: parsed from the formatted text."""
    n = partitions_for(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, none = template.turn(), object()
        now, acc = none, None
        out: list[tuple] = []

        def end() -> None:
            if now is not none:
                n_turns, turns, loss, loss_chars, chars, valid, _ = acc
                out.append((now, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))

        for batch in batches:
            for conv, text, masked, refused in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "refused")), strict=True):
                if conv != now:
                    end()
                    now, acc = conv, [0, hashlib.sha256(), hashlib.sha256(), 0, 0, True, ""]
                acc[4] += len(text)
                acc[5] &= not refused
                acc[6] += text
                if masked:
                    plain = template.plain(text)
                    acc[2].update(plain.encode())
                    acc[3] += len(plain)
                if text == template.end and not masked:
                    m = pattern.fullmatch(acc[6])
                    if m is None:
                        raise ValueError(f"conversation {conv}: the formatted text is not a sequence of turns")
                    acc[0] += 1
                    acc[1].update(f"{template.plain(m[1])}\n{template.plain(m[2])}\n".encode())
                    acc[6] = ""
            if out:
                yield batch_of(out, READ)
                out.clear()
        end()
        if out:
            yield batch_of(out, READ)

    rows = segments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def chat_report(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """read_conversations of format_conversations' written output."""
    return read_conversations(materialize(format_conversations(turns, template), "chat"), template)


PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def with_probe(turns: DataFrame) -> DataFrame:
    """conversations and one of control strings, id -7."""
    probe = turns.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(probe)
