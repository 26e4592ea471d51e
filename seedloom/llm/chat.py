r"""Chat formatting whose text reads back as the turns it came from.

A turn is ``### Role: text``, a line break and ``</turn>``. The parser takes
every header and every end mark as control, unless a backslash stands right
before it; that backslash is then dropped. A turn is rendered as it is, parsed
again and compared; where that differs, its control strings get a backslash
each, until what is parsed is what was meant.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</turn>"
LEARNED = "assistant"

_MARK = r"### [A-Za-z0-9%=._~-]+: |</turn>"
_CONTROL = re.compile(rf"(\\?)({_MARK})")
_PLAIN_ROLE = re.compile(r"[a-z]+")


def _label(role: str) -> str:
    return role.capitalize() if _PLAIN_ROLE.fullmatch(role) else "=" + quote(role, safe="")


def _role(label: str) -> str:
    return unquote(label[1:]) if label.startswith("=") else label.lower()


def _escaped(text: str, level: int) -> str:
    """Level 0 is the text itself; level 1 has a backslash before each control string."""
    return re.sub(rf"({_MARK})", r"\\\1", text) if level else text


def unescaped(text: str) -> str:
    return re.sub(rf"\\({_MARK})", r"\1", text)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered text; ValueError where it breaks the grammar."""
    turns: list[tuple[str, str]] = []
    role, start = None, 0
    for m in _CONTROL.finditer(rendered):
        if m[1]:
            continue
        if role is None:
            if m[2] == END or m.start() != start:
                raise ValueError("a turn starts with a header")
            role, start = _role(m[2][4:-2]), m.end()
        else:
            body = rendered[start : m.start()]
            if m[2] != END or not body.endswith("\n") or rendered[m.end() : m.end() + 1] != "\n":
                raise ValueError("a turn ends with its mark on a line")
            turns.append((role, unescaped(body[:-1])))
            role, start = None, m.end() + 1
    if role is not None or start != len(rendered):
        raise ValueError("the last turn has no end")
    return turns


class Piece(NamedTuple):
    """A rendered turn and the part of it that holds its text."""

    text: str
    start: int
    end: int
    level: int


def render(role: str | None, text: str | None) -> Piece:
    """One turn, escaped as far as its round trip needs; null counts as empty."""
    role, text = role or "", text or ""
    head = f"### {_label(role)}: "
    for level in (0, 1):
        body = _escaped(text, level)
        rendered = f"{head}{body}\n{END}\n"
        try:
            same = parse(rendered) == [(role, text)]
        except ValueError:
            same = False
        if same:
            return Piece(rendered, len(head), len(head) + len(body), level)
    raise AssertionError("escaped control strings always read back")


_RENDERED = "formatted string, mask_start int, mask_end int, escape_level int"


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` and the rendered turn with its text's place.

    Narrow. A conversation is its rendered turns in order, joined by nothing:
    each starts and ends between turns, so what reads back turn by turn reads
    back as a whole. The span holds the text to learn where ``role`` is
    assistant. Null role and text count as empty.
    """

    @F.pandas_udf(_RENDERED)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for roles, texts in batches:
            yield pd.DataFrame(
                [render(r, t) for r, t in zip(roles, texts, strict=True)],
                columns=["formatted", "mask_start", "mask_end", "escape_level"],
            )

    chosen = turns.select("conv_id", "turn", "role", "text")
    return chosen.withColumn("r", of("role", "text")).select(*chosen.columns, "r.*")


class _Reader:
    """Reads one conversation back, turn by turn, keeping digests only."""

    def __init__(self) -> None:
        self.turns = self.chars = self.loss_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, piece: str, start: int, end: int) -> None:
        self.chars += len(piece)
        for role, text in parse(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == LEARNED:
                learned = unescaped(piece[start:end])
                self.loss_chars += len(learned)
                self.loss.update(learned.encode("utf-8", "surrogatepass"))

    def row(self, key: str | None) -> tuple:
        return key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_READ = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its rendered text parses to.

    Turns go by ``turn``, those with the same number by role and text. Each
    task streams sorted turns and holds one turn and two digests, however long
    a conversation is; a digest over a whole conversation is made by one task,
    since SHA-256 runs from front to back. A null conv_id is a conversation of
    its own.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, reader = None, None
        columns = [c.split()[0] for c in _READ.split(", ")]
        for batch in batches:
            done = []
            for key, *piece in batch.itertuples(index=False, name=None):
                if reader is None or key != current:
                    if reader is not None:
                        done.append(reader.row(current))
                    current, reader = key, _Reader()
                reader.take(*piece)
            yield pd.DataFrame(done, columns=columns)
        if reader is not None:
            yield pd.DataFrame([reader.row(current)], columns=columns)

    kind = dict(formatted.dtypes)["conv_id"]
    keyed = formatted.withColumn("conv_id", F.col("conv_id").cast("string"))
    ordered = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    read = ordered.select("conv_id", "formatted", "mask_start", "mask_end").mapInPandas(digests, _READ)
    return read.withColumn("conv_id", F.col("conv_id").cast(kind))


# A conversation whose texts are made of control strings.
HOSTILE_ID = -7
HOSTILE_TEXT = r"\### Assistant: </turn> ok"


def with_hostile(conversations: DataFrame) -> DataFrame:
    turns = conversations.select("conv_id", "turn", "role", "text")
    rows = [(HOSTILE_ID, n, role, HOSTILE_TEXT) for n, role in enumerate(("user", "assistant"))]
    return turns.unionByName(conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
