"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens choose spans of whole turns. Every window after a conversation's first
repeats the system turn and a limited history of the turns before it, both masked, so that each assistant
turn is a training target exactly once. A task reads its conversations as a sorted stream and holds
no more of one than fills a window, however long the conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillon.llm.bpe import Encoder, Vocabulary, slices
from quillon.llm.common import needs, texts_of

OPEN, CLOSE = "<s>", "</s>"
# Control strings of this and of other templates. A first character occurs in none of them again.
CONTROL = (OPEN, CLOSE, "[INST]", "[/INST]", "[SYS]", "[/SYS]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
MARK = "\u2060"


def control_strings(marks: str) -> re.Pattern:
    """The marks behind the first character of a control string, a given number of them."""
    return re.compile("|".join(f"(?<={re.escape(c[0])}){MARK}{marks}(?={re.escape(c[1:])})" for c in CONTROL))


ESCAPE, UNESCAPE = control_strings("*"), control_strings("+")
TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(CLOSE)}", re.S)

WINDOW_FIELDS = (
    "window long, text string, n_tokens long, n_context long, n_new long, targets array<struct<start: long, end: long>>"
)


def escape(text: str) -> str:
    """A mark more behind the first character of whatever reads as a control string once its marks are left out."""
    return ESCAPE.sub(lambda found: found[0] + MARK, text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda found: found[0][1:], text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn in the template, and where its text begins."""
    head = OPEN + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n"
    return head + escape(text) + CLOSE, len(head)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    turns = []
    for body in TURN.findall(text):
        role, _, said = body.partition("\n")
        role = re.sub(r"\\(.)", lambda found: "\n" if found[1] == "n" else found[1], role)
        turns.append((unescape(role), unescape(said)))
    return turns


@dataclass
class Turn:
    role: str
    formatted: str
    begin: int
    tokens: int


class Windows:
    """Cuts one conversation, given turn by turn. A system turn of more than `repeated` tokens is a turn like any other."""

    def __init__(self, budget: int, history: int, repeated: int):
        self.budget, self.history, self.repeated = budget, history, repeated
        self.system: Turn | None = None
        self.past: list[Turn] = []
        self.turns: list[Turn] = []
        self.waiting = self.number = self.seen = 0

    def add(self, turn: Turn) -> Iterator[tuple]:
        if not self.seen and turn.role == "system" and turn.tokens <= self.repeated:
            self.system = turn
        self.seen += 1
        self.turns.append(turn)
        self.waiting += turn.tokens
        if self.waiting > 16 * self.budget:
            yield from self.cut(last=False)

    def context(self) -> list[Turn]:
        """System turn and the latest turns within the history limit."""
        if not self.number:
            return []
        newest_first = np.cumsum([t.tokens for t in reversed(self.past)])
        many = int(np.searchsorted(newest_first, self.history, "right"))
        return [*([self.system] if self.system else []), *self.past[len(self.past) - many :]]

    def cut(self, last: bool = True) -> Iterator[tuple]:
        sums = np.append(0, np.cumsum([t.tokens for t in self.turns]))
        at = 0
        while at < len(self.turns):
            context = self.context()
            used = sum(t.tokens for t in context)
            end = int(np.searchsorted(sums, sums[at] + self.budget - used, "right")) - 1
            end = max(end, at + 1)  # a turn over the budget has a window of its own
            if not last and end >= len(self.turns):
                break
            yield self.window(context, self.turns[at:end])
            self.past += [t for t in self.turns[at:end] if t is not self.system]
            keep = int(np.searchsorted(np.cumsum([t.tokens for t in reversed(self.past)]), self.history, "right"))
            self.past = self.past[len(self.past) - keep :]
            at = end
        self.turns = self.turns[at:]
        self.waiting = int(sums[-1] - sums[at])

    def window(self, context: list[Turn], new: list[Turn]) -> tuple:
        position, targets = 0, []
        for i, turn in enumerate([*context, *new]):
            if i >= len(context) and turn.role == "assistant":
                targets.append({"start": position + turn.begin, "end": position + len(turn.formatted) - len(CLOSE)})
            position += len(turn.formatted)
        out = (
            self.number, "".join(t.formatted for t in [*context, *new]), sum(t.tokens for t in [*context, *new]), len(context), len(new), targets,
        )
        self.number += 1
        return out


def formatted(
    conversations: DataFrame,
    vocabulary: Vocabulary,
    budget: int = 2048,
    history: int = 512,
    key: str = "conv_id",
    turn: str = "turn",
    repeated: int = 1024,
) -> DataFrame:
    """One row per window: key, number, text, tokens, turns of context and new turns, target spans in code points.

    Windows after the first repeat the system turn if it has at most `repeated` tokens (half of the usual budget); a longer
    one would crowd out the turns, so it stands in its own place alone, in a window of its own once it is over the budget.

    Null text is empty, a null role is the empty role, a null turn sorts first; turns of equal number are ordered
    by role and text, and repeated rows are repeated turns. Rows without a key form one conversation. Other columns are not
    read. The windows of a conversation follow each other in one partition.
    """
    needs(conversations, key, turn, "role", "text")
    rows = conversations.select(key, turn, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(key).sortWithinPartitions(key, turn, "role", "text")
    shared = conversations.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL(WINDOW_FIELDS).fields])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), spans]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, own, state, out, held, kind = Encoder(shared.value), object(), None, [], 0, None

        def made() -> pa.RecordBatch:
            keys, rows = zip(*out)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *columns], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            keys, roles, texts = batch.column(0).to_pylist(), texts_of(batch.column(2)), texts_of(batch.column(3))
            for a, b in slices(list(map(len, texts)), 1 << 20):
                turns = [format_turn(role, text) for role, text in zip(roles[a:b], texts[a:b])]
                tokens = np.diff(encoder.encode([t for t, _ in turns])[1]).tolist()
                for conv, role, (text, begin), n in zip(keys[a:b], roles[a:b], turns, tokens):
                    if conv != own or state is None:
                        if state is not None:
                            out += [(own, w) for w in state.cut()]
                        own, state = conv, Windows(budget, history, repeated)
                    out += [(own, w) for w in state.add(Turn(role, text, begin, n))]
                    held += len(text)
                    if held > 1 << 22 and out:
                        yield made()
                        out, held = [], 0
        if state is not None:
            out += [(own, w) for w in state.cut()]
        if out:
            yield made()

    return rows.mapInArrow(windows, schema)


def read_back(windows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation, parsed from its windows: number of turns, digests of turns and of target text, sizes.

    Expects the windows of a conversation in order in one partition, as `formatted` gives them.
    """
    rows = windows.select(key, "text", "n_context", "targets")
    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL(fields).fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, kind = None, None, None

        def made(done: list) -> pa.RecordBatch:
            columns = list(zip(*[(k, n, a.hexdigest(), chars, b.hexdigest(), size) for k, (n, a, chars, b, size) in done]))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv, text, context, targets in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or conv != own:
                    if state is not None:
                        done.append((own, state))
                    own, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse_turns(text)[context:]
                state[0] += len(turns)
                state[4] += len(text)
                for role, said in turns:
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in targets:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
            if done:
                yield made(done)
        if state is not None:
            yield made([(own, state)])

    return rows.mapInArrow(read, schema)
