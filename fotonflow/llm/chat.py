"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine checks the order of turns; the template turns each one into text segments with a loss flag.
Control strings inside texts are escaped with a backslash, which can be undone. Conversations pass
through sorted partitions as streams, so a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])


@dataclass(frozen=True)
class Template:
    """Marks of the turns, which roles are trained on, and which role may follow which.

    ``other`` opens a turn of a role without a mark of its own; the escaped role and ``named`` follow.
    ``order`` maps a state to the roles it accepts; the role accepted is the next state.
    """

    opens: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Role: "
    named: str = " </role> "
    close: str = " </turn>\n"
    trained: frozenset[str] = frozenset({"assistant"})
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def controls(self) -> list[str]:
        marks = [*self.opens.values(), self.other, self.named, self.close]
        return sorted((m.strip() for m in marks), key=len, reverse=True)

    def machine(self) -> dict[tuple[str, str], str]:
        return {(state, role): role for state, roles in self.order.items() for role in roles}


class Formatter:
    """Compiled form of a template."""

    def __init__(self, template: Template):
        self.template = template
        self.controls = re.compile("|".join(map(re.escape, ["\\", *template.controls()])))
        self.roles = {mark: role for role, mark in template.opens.items()}
        marks = sorted([*self.roles, template.other, template.named, template.close], key=len, reverse=True)
        self.scan = re.compile(r"\\(?s:.)|" + "|".join(map(re.escape, marks)))
        self.steps = template.machine()

    def escape(self, text: str) -> str:
        return self.controls.sub(lambda m: "\\" + m[0], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of one turn; only the text of a trained role carries the loss flag."""
        t = self.template
        head = t.opens[role] if role in t.opens else t.other + self.escape(role) + t.named
        return [(head, False), (self.escape(text), role in t.trained), (t.close, False)]

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a formatted text. Marks count only where no backslash escapes them."""
        role, at = None, 0
        named = False
        for m in self.scan.finditer(formatted):
            mark = m[0]
            if mark[0] == "\\":
                continue
            if mark in self.roles or mark == self.template.other:
                role, named, at = self.roles.get(mark), mark == self.template.other, m.end()
            elif mark == self.template.named and named:
                role, named, at = self.unescape(formatted[at : m.start()]), False, m.end()
            elif mark == self.template.close:
                yield role, self.unescape(formatted[at : m.start()])


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn: (conv_id, nth, in_order, segments).

    Turns of a conversation go by (turn, role, text), nulls first; repeated rows are turns of their own. A
    null text or role counts as empty; rows with a null conv_id make up one conversation. ``in_order`` is
    false from the first turn that the machine refuses; such conversations are still formatted in full.
    Extra columns are not read; an empty table gives no rows. Rows come partitioned and sorted by conversation.
    """
    shared = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Formatter(shared)
        now, state, nth = object(), "start", 0
        for batch in batches:
            places, orders, cut = [], [], []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != now:
                    now, state, nth = conv, "start", 0
                role = role or ""
                state = work.steps.get((state, role), "refused")
                cut.append([{"text": t, "loss": loss} for t, loss in work.turn(role, text or "")])
                places.append(nth)
                orders.append(state != "refused")
                nth += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), pa.array(orders, pa.bool_()), pa.array(cut, pa.list_(SEGMENT))], names=["conv_id", "nth", "in_order", "segments"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, nth long, in_order boolean, segments array<struct<text: string, loss: boolean>>")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read from the rows of ``format_turns`` in their order.

    Roles and texts are parsed from the formatted text, the trained texts taken from the flagged segments:
    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, in_order).
    """
    shared = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Formatter(shared)
        done: list[tuple] = []
        now, open_ = None, False

        def end() -> None:
            done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, fine))

        for batch in batches:
            for conv, in_order, segments in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if not open_ or conv != now:
                    if open_:
                        end()
                    now, open_, n, chars, loss_chars, fine = conv, True, 0, 0, 0, True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                whole = "".join([s["text"] for s in segments])
                for role, text in work.parse(whole):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for s in segments:
                    if s["loss"]:
                        plain = work.unescape(s["text"])
                        loss.update(plain.encode())
                        loss_chars += len(plain)
                chars += len(whole)
                fine = fine and in_order
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 7, kinds)], names=names)
            done.clear()
        if open_:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean")
