"""Chat formatting in budgeted windows, and reading the formatted text back.

Turns are written as ``### role: text </turn>`` with a line feed after each. Inside roles and texts
the characters that marks are made of get a backslash, so no text can look like a mark.

A conversation is cut into windows of whole turns. Prefix sums of the turns' tokens choose how far a
window reaches. Each starts with the conversation's system turn and repeats a limited number of
tokens of the turns just before it. The loss mask covers what the assistant says for the first time;
repeated turns aren't learned again.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a window and of the history that it repeats.
BUDGET, HISTORY = 2048, 512

_ESCAPE = str.maketrans({c: "\\" + c for c in "\\#<:\n"})
_ESCAPE_TEXT = str.maketrans({c: "\\" + c for c in "\\#<"})
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_END = " </turn>\n"


def escape(text: str) -> str:
    return text.translate(_ESCAPE_TEXT)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where in it the escaped text stands."""
    head = f"### {role.translate(_ESCAPE)}: "
    body = escape(text)
    return head + body + _END, len(head), len(head) + len(body)



def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, text and the span of the escaped text of each turn; ValueError where a mark is missing."""
    out, at = [], 0
    while at < len(formatted):
        head = formatted.find(": ", at)
        # A role's own colons are escaped, so the first bare one ends it.
        while head > 0 and (head - at - len(formatted[at:head].rstrip("\\"))) % 2:
            head = formatted.find(": ", head + 1)
        end = formatted.find(_END, at)
        if not formatted.startswith("### ", at) or head < 0 or end < head + 2:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(formatted[at + 4 : head]), unescape(formatted[head + 2 : end]), head + 2, end))
        at = end + len(_END)
    return out


@dataclass
class Window:
    """One training example: ``repeated`` leading turns were shown before; ``mask`` are spans of ``text``."""

    first_turn: int
    turns: int
    repeated: int
    tokens: int
    text: str
    mask: list[tuple[int, int]] = field(default_factory=list)


class Windows:
    """Takes a conversation's turns in order and gives its windows; holds a window and its history at most."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.past: list[tuple[str, str, int]] = []
        self.turns: list[tuple[str, str, int]] = []
        self.sums = [0]
        self.number = 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[Window]:
        self.turns.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)
        while self.turns and self._lead()[1] + self.sums[-1] > self.budget and len(self.turns) > 1:
            yield self._cut()

    def close(self) -> Iterator[Window]:
        while self.turns:
            yield self._cut()

    def _lead(self) -> tuple[list[tuple[str, str, int]], int]:
        """The system turn and the history before the pending turns, as far as the first of these still fits."""
        lead = [self.system] if self.system else []
        used = sum(t[2] for t in lead)
        room = min(self.history, self.budget - used - (self.turns[0][2] if self.turns else 0))
        past: list[tuple[str, str, int]] = []
        for turn in reversed(self.past):
            if turn[2] > room:
                break
            room -= turn[2]
            past.append(turn)
        return lead + past[::-1], used + sum(t[2] for t in past)

    def _cut(self) -> Window:
        lead, used = self._lead()
        take = max(1, bisect_right(self.sums, self.budget - used) - 1)  # a turn above the budget stands alone
        new, self.turns = self.turns[:take], self.turns[take:]
        at, parts, mask = 0, [], []
        for k, (role, text, _) in enumerate(lead + new):
            made, a, b = turn_text(role, text)
            if k >= len(lead) and role == "assistant":
                mask.append((at + a, at + b))
            parts.append(made)
            at += len(made)
        window = Window(self.number, take, len(lead), used + self.sums[take], "".join(parts), mask)
        self.number += take
        base = self.sums[take]
        self.sums = [s - base for s in self.sums[take:]]
        for turn in new:
            if turn[0] == "system" and self.system is None:
                self.system = turn
            else:
                self.past.append(turn)
        kept, total = 0, 0
        for turn in reversed(self.past):
            total += turn[2]
            if total > self.history:
                break
            kept += 1
        self.past = self.past[len(self.past) - kept :]
        return window


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with each conversation's rows in one partition, in order.

    Rows are streamed: a conversation of any length passes through its task without being held.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


_WINDOW = "conv_id long, window long, first_turn long, n_turns long, n_repeated long, n_tokens long, formatted string, mask array<struct<start:long,end:long>>"
_KINDS = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
_NAMES = ["conv_id", "window", "first_turn", "n_turns", "n_repeated", "n_tokens", "formatted", "mask"]


def format_conversations(conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of each conversation (conv_id, turn, role, text), in order within a partition.

    Null texts and roles are empty. Turns of one number (repeated rows) are all kept, ordered by role
    and text; null turn numbers come first. Rows with a null conv_id are one conversation. The first
    system turn counts as the system turn from where it stands. A turn longer than the budget is a
    window by itself, with the system turn before it. Other columns are ignored; an empty table gives
    no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        current: object = ...
        windows, n = Windows(budget, history), 0
        out: list[list] = [[] for _ in _KINDS]

        def put(made: Iterator[Window]) -> None:
            nonlocal n
            for w in made:
                mask = [{"start": a, "end": b} for a, b in w.mask]
                for column, value in zip(out, (current, n, w.first_turn, w.turns, w.repeated, w.tokens, w.text, mask), strict=True):
                    column.append(value)
                n += 1

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _KINDS, strict=True)], names=_NAMES)
            for c in out:
                c.clear()
            return made

        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                ids, roles, texts = (part.column(i).to_pylist() for i in (0, 2, 3))
                counts = [len(e.ids) for e in tokenizer.encode_batch([turn_text(r, t)[0] for r, t in zip(roles, texts, strict=True)], add_special_tokens=False)]
                for conv, role, text, tokens in zip(ids, roles, texts, counts, strict=True):
                    if conv != current or current is ...:
                        if current is not ...:
                            put(windows.close())
                        current, windows, n = conv, Windows(budget, history), 0
                    put(windows.add(role, text, tokens))
                yield batch()
        if current is not ...:
            put(windows.close())
        yield batch()

    return ordered(conversations).mapInArrow(run, _WINDOW)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, read back from the formatted text alone.

    Takes the windows as ``format_conversations`` gives them: a conversation's in one partition and in
    order. Hashes run along, so no conversation is held whole. Windows in any other order fail the job, as
    their hashes would be wrong. No windows give no rows.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = ...
        state: list = []
        wanted = 0
        rows: list[tuple] = []

        def close() -> None:
            n, turns, chars, loss, size = state
            rows.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for conv, number, repeated, formatted, mask in zip(*(b.column(c).to_pylist() for c in ("conv_id", "window", "n_repeated", "formatted", "mask")), strict=True):
                if conv != current or current is ...:
                    if current is not ...:
                        close()
                    current, state, wanted = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], 0
                if number != wanted:
                    raise ValueError(f"windows of conversation {conv} aren't in order")
                wanted += 1
                for role, text, _, _ in parse(formatted)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in mask:
                    learned = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)
            rows = []
        if current is not ...:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
