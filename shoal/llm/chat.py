"""Chat formatting in budgeted windows.

A conversation's turns are laid out in windows of at most ``budget`` tokens, counted by a public tokenizer. Prefix sums of the
turns' tokens choose where a window ends, always between turns; a turn longer than the budget has a
window of its own. Each later window repeats the system turn and the latest earlier turns that fit
into ``history`` tokens; repeated turns are marked and never trained on. The loss mask covers each
assistant text once, in the window where it is new.

Control strings inside roles and texts are escaped by one more backslash before them (and before the
backslashes that already stand there), which is undone exactly when reading. Roles are kept on one
line by escaping their line breaks.

Conversations are streamed turn by turn, sorted within their partition: a task holds one window, of
the budget's size or of one turn, so a conversation of any number of turns is formatted in bounded memory.

Defined results: null roles and texts count as empty; null turns come first; turns with equal numbers
are ordered by role and text; rows with a null id are one conversation; an empty table gives an empty
result; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shoal.llm import scratch, tokencount

VOCABULARY = tokencount.VOCABULARY
BUDGET, HISTORY = 2048, 512
NEW, AGAIN, END = "<|im_start|>", "<|im_again|>", "<|im_end|>"
_CONTROL = r"<\|im_(?:start|again|end)\|>|</?s>|\[/?(?:INST|SYS)\]|<</?SYS>>"
_ESCAPE = re.compile(rf"\\*(?:{_CONTROL})")
_UNESCAPE = re.compile(rf"\\(\\*(?:{_CONTROL}))")
_BLOCK = re.compile(r"<\|im_(start|again)\|>([^\n]*)\n(.*?)\n<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


MARKS = 4  # tokens around a turn


def _counter(vocabulary: str) -> tokencount.Counter:
    return scratch.held(("tokens", vocabulary), lambda: tokencount.Counter(vocabulary))


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a public tokenizer, and four for the marks around a turn."""
    return int(_counter(vocabulary).count([text])[0]) + MARKS


@dataclass
class Window:
    text: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)  # of characters that are trained on
    n_new: int = 0


def windows(turns: Iterator[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[str], int] = count_tokens) -> Iterator[Window]:
    """(role, text) in order -> windows."""
    return _windows(((role, text, tokens(text)) for role, text in turns), budget, history)


def _windows(turns: Iterator[tuple[str, str, int]], budget: int, history: int) -> Iterator[Window]:
    """(role, text, tokens) in order -> windows."""
    system: tuple[str, str, int] | None = None
    before: list[tuple[str, str, int]] = []  # turns to repeat in the next window
    new: list[tuple[str, str, int]] = []

    def made() -> Window:
        repeated = [*([system] if system and (before or first_done) and new and new[0] is not system else []), *before]
        w, parts, at = Window(n_new=len(new)), [], 0
        for turn, mark in [*((t, AGAIN) for t in repeated), *((t, NEW) for t in new)]:
            role, text = escape_role(turn[0]), escape(turn[1])
            start = at + len(mark) + len(role) + 1
            if mark == NEW and turn[0] == "assistant":
                w.spans.append((start, start + len(text)))
            parts.append(f"{mark}{role}\n{text}\n{END}\n")
            at += len(parts[-1])
        w.text = "".join(parts)
        return w

    first_done, used = False, 0
    for turn in turns:
        if system is None and not first_done and not new and turn[0] == "system":
            system = turn
        if new and used + turn[2] > budget:
            yield made()
            first_done = True
            last = [t for t in [*before, *new] if t is not system]
            sums = list(accumulate((t[2] for t in last), initial=0))
            room = min(history, budget - turn[2] - (system[2] if system else 0))
            before = last[bisect_left(sums, sums[-1] - room) :] if room > 0 else []
            new, used = [], (system[2] if system else 0) + sum(t[2] for t in before)
        new.append(turn)
        used += turn[2]
    if new:
        yield made()


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per window, in order within a conversation: ``id_col``, window, text, loss (spans of characters)."""
    slim = turns.select(F.col(id_col).alias("_id"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"))
    dealt = slim.repartition("_id").sortWithinPartitions("_id", "_turn", "_role", "_text")

    def counted(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                i, r, t = (b.column(c).slice(k, 2000).to_pylist() for c in (0, 2, 3))
                n = _counter(vocabulary).count(t)
                yield from ((i, r or "", t or "", int(n) + MARKS) for i, r, t, n in zip(i, r, t, n, strict=True))

    def run(batches):
        rows = counted(batches)
        out: list[tuple] = []
        size = 0
        for i, own in _groups(rows):
            for k, w in enumerate(_windows(own, budget, history)):
                out.append((i, k, w.text, [{"start": a, "end": b} for a, b in w.spans]))
                size += len(w.text)
                if size > 4_000_000:
                    yield _batch(out, kinds)
                    out, size = [], 0
        if out:
            yield _batch(out, kinds)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [("_id", to_arrow_type(slim.schema["_id"].dataType)), ("window", pa.int64()), ("text", pa.string()), ("loss", span)]
    schema = f"_id {slim.schema['_id'].dataType.simpleString()}, window long, text string, loss array<struct<start:bigint,end:bigint>>"
    return dealt.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _batch(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


def _groups(rows):
    """(id, iterator of (role, text, tokens)) for each run of equal ids; one row is held at a time."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def own():
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(rows, None)

        yield key, own()


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the windows hold: ``id_col``, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``formatted`` must have a conversation's windows in order within one partition, as ``format_conversations`` leaves them.
    """
    slim = formatted.select(F.col(id_col).alias("_id"), "window", "text", "loss")

    def run(batches):
        out: list[tuple] = []
        state = None
        for b in batches:
            for i, k, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k == 0:
                    if state:
                        out.append(_closed(state))
                    state = [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                for m in _BLOCK.finditer(text):
                    if m.start() != at:
                        raise ValueError("a window can't be read")
                    at = m.end()
                    if m[1] == "start":
                        state[1] += 1
                        state[2].update(f"{unescape_role(m[2])}\n{unescape(m[3])}\n".encode())
                if at != len(text):
                    raise ValueError("a window can't be read")
                for s in loss:
                    part = unescape(text[s["start"] : s["end"]])
                    state[3] += len(part)
                    state[4].update(part.encode())
                state[5] += len(text)
            if len(out) > 5000:
                yield _batch(out, kinds)
                out = []
        if state:
            out.append(_closed(state))
        if out:
            yield _batch(out, kinds)

    kinds = [("_id", to_arrow_type(slim.schema["_id"].dataType)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema = f"_id {slim.schema['_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return slim.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _closed(s: list) -> tuple:
    return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]
