"""Conversations as training text, datasets as JSON text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.functions.expr import whole_div
from seedloom.operators.numbering import number_within


@dataclass(frozen=True)
class ChatStyle:
    """How a turn becomes text; ``{role}`` stands for its role."""

    # The marks that models expect around a turn.
    header: str = "<|start_header_id|>{role}<|end_header_id|>\n\n"
    end: str = "<|eot_id|>"
    role_names: Mapping[str, str] = field(default_factory=lambda: {"tool": "ipython"})
    answering: str = "assistant"
    asking: Sequence[str] = ("user", "tool")

    def turn(self, role: Column, text: Column, last: Column) -> Column:
        """One turn; the last answer stays open and a last question is cued."""
        shown = role
        for name, other in self.role_names.items():
            shown = F.when(role == name, other).otherwise(shown)
        before, _, after = self.header.partition("{role}")
        head = F.concat(F.lit(before), shown, F.lit(after))
        open_end = last & (role == self.answering)
        cue = before + self.answering + after
        tail = F.when(open_end, "").otherwise(self.end)
        cued = F.when(last & role.isin(*self.asking), cue).otherwise("")
        return F.concat(head, F.coalesce(text, F.lit("")), tail, cued)


def render_turns(
    df: DataFrame, conversation: str, turn: str, role: str, text: str, style: ChatStyle = ChatStyle()
) -> DataFrame:
    """Training text of every turn: (conversation, turn_no, piece).

    A conversation is its pieces in order, joined by nothing. No task holds a
    conversation, so it may have any length; ``write_rendered`` puts the
    pieces into files.
    """
    numbered = number_within(
        df.select(conversation, turn, role, text), [conversation], [turn], name="turn_no", size_name="__n"
    )
    last = F.col("turn_no") == F.col("__n") - 1
    piece = style.turn(F.col(role), F.col(text), last)
    return numbered.select(conversation, "turn_no", piece.alias("piece"))


def render_parts(
    df: DataFrame, conversation: str, turn: str, role: str, text: str, style: ChatStyle = ChatStyle(), *, per_part: int = 256
) -> DataFrame:
    """Training text of ``per_part`` turns at a time: (conversation, part, rendered).

    Most conversations are one part. A longer one is its parts in order, so no
    row holds more than a part of a conversation of any length.
    """
    pieces = render_turns(df, conversation, turn, role, text, style)
    listed = F.sort_array(F.collect_list(F.struct("turn_no", "piece"))).alias("__p")
    parts = pieces.groupBy(conversation, whole_div(F.col("turn_no"), per_part).alias("part")).agg(listed)
    return parts.select(conversation, "part", F.array_join(F.col("__p.piece"), "").alias("rendered"))


def render_conversations(
    df: DataFrame, conversation: str, turn: str, role: str, text: str, style: ChatStyle = ChatStyle(), *, per_part: int = 256
) -> DataFrame:
    """Training text of whole conversations: (conversation, rendered), one row for each.

    A long one is put together from the texts of its parts, never from its
    turns, so a task holds little more than the text it returns. Use
    ``render_parts`` where a conversation may be larger than a row.
    """
    parts = render_parts(df, conversation, turn, role, text, style, per_part=per_part)
    listed = F.sort_array(F.collect_list(F.struct("part", "rendered"))).alias("__p")
    return parts.groupBy(conversation).agg(listed).select(conversation, F.array_join(F.col("__p.rendered"), "").alias("rendered"))


def render_array(turns: Column, style: ChatStyle = ChatStyle()) -> Column:
    """Training text of a conversation held as an array of (role, text). Narrow."""
    count = F.size(turns)
    pieces = F.transform(turns, lambda t, i: style.turn(t["role"], t["text"], i == count - 1))
    return F.array_join(pieces, "")


def write_rendered(pieces: DataFrame, path: str, conversation: str, *, mode: str = "error") -> None:
    """Ordered text parts of rendered turns, conversation after conversation."""
    ranged = pieces.repartitionByRange(conversation, "turn_no").sortWithinPartitions(conversation, "turn_no")
    ranged.select(F.col("piece").alias("value")).write.mode(mode).text(path, lineSep="\n")


def _json_value(value: Column, kind: T.DataType, depth: int) -> Column:
    pad, close = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    if isinstance(kind, T.StructType):
        shown = json_record({f.name: value.getField(f.name) for f in kind.fields}, kind, depth)
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda v: _json_value(v, kind.elementType, depth + 1))
        inner = F.concat(F.lit("[" + pad), F.array_join(items, "," + pad), F.lit(close + "]"))
        shown = F.when(F.size(value) == 0, "[]").otherwise(inner)
    else:
        boxed = F.to_json(F.array(value))
        shown = F.substring(boxed, F.lit(2), F.length(boxed) - 2)
    return F.when(value.isNull(), F.lit("null")).otherwise(shown)


def json_record(values: Mapping[str, Column], schema: T.StructType, depth: int = 0) -> Column:
    """Named values as JSON indented by two spaces."""
    pad, close = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    parts: list[Column] = []
    for i, f in enumerate(schema.fields):
        name = f.name.replace("\\", "\\\\").replace('"', '\\"')
        parts += [
            F.lit(("," if i else "{") + pad + f'"{name}": '),
            _json_value(values[f.name], f.dataType, depth + 1),
        ]
    return F.concat(*parts, F.lit(close + "}")) if parts else F.lit("{}")


def split_records(
    df: DataFrame, split: Sequence[str], *, keep: Sequence[str] = (), name: str = "config_split"
) -> DataFrame:
    """Each row as indented JSON under the name of its split.

    Write it with ``write_splits``: one text per split, records in order and
    a blank line between them.
    """
    columns = [f for f in df.schema.fields if f.name not in split]
    record = json_record({f.name: F.col(f.name) for f in columns}, T.StructType(columns))
    return df.select(split_name(split).alias(name), *keep, record.alias("record"))


def split_name(split: Sequence[str]) -> Column:
    """Parts joined by ``_``, different for different parts.

    A ``%`` becomes ``%25``, a ``_`` before the last part ``%5F``, and a null ``%00``.
    """
    parts = []
    for n, c in enumerate(split, 1):
        shown = F.replace(F.col(c).cast("string"), F.lit("%"), F.lit("%25"))
        shown = shown if n == len(split) else F.replace(shown, F.lit("_"), F.lit("%5F"))
        parts.append(F.coalesce(shown, F.lit("%00")))
    return F.concat_ws("_", *parts)


def write_splits(
    records: DataFrame, path: str, order_by: Sequence[str], *, name: str = "config_split", mode: str = "error"
) -> None:
    """A folder per split with ordered text parts; large splits have many parts."""
    ranged = records.repartitionByRange(name, *order_by).sortWithinPartitions(name, *order_by)
    writer = ranged.select(name, F.col("record").alias("value")).write.partitionBy(name).mode(mode)
    writer.text(path, lineSep="\n\n")
