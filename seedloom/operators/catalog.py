"""Training rows from a catalog of commands, and command blocks checked against one.

A catalog has ``command`` and ``description``; its parameters are a table of
``command, parameter, kind`` (``text``, ``integer`` or ``choice``), and the
values that choices may take one of ``command, parameter, value``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.functions.expr import whole_div
from seedloom.operators.exchange import Exchange
from seedloom.operators.numbering import with_row_id
from seedloom.sources.staging import stage

# The marks around a command to run.
BLOCK_OPEN, BLOCK_CLOSE = "<runCommand>", "</runCommand>"


class Phrasing(NamedTuple):
    """A question and its answer; ``{command}``, ``{description}``, ``{parameter}`` and ``{value}`` are filled in."""

    question: str
    answer: str


def _filled(template: str, values: dict[str, Column]) -> Column:
    """The template with its names replaced once; what is filled in is not filled again."""
    parts, rest = [], template
    while rest:
        found = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = min(found)
        parts += [F.lit(rest[:at]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def _expanded(rows: DataFrame, task: str, phrasings: Sequence[Phrasing], values: dict[str, Column]) -> DataFrame:
    """A row per phrasing. Phrasings are settings, so nothing is joined: each row is copied where it is."""
    each = [
        F.struct(
            F.lit(task).alias("task"), F.lit(n).alias("phrasing"), _filled(p.question, values).alias("input"), _filled(p.answer, values).alias("output")
        )
        for n, p in enumerate(phrasings)
    ]
    return rows.select("command", F.inline(F.array(*each)))


def describe(catalog: DataFrame, phrasings: Sequence[Phrasing]) -> DataFrame:
    """``command, task, phrasing, input, output``: what each command does, asked in every way."""
    return _expanded(catalog, "describe", phrasings, {c: F.col(c) for c in ("command", "description")})


def command_block(command: Column, arguments: Column) -> Column:
    """A command and its arguments as a block to run."""
    return F.concat(F.lit(BLOCK_OPEN + "\n"), F.to_json(F.struct(command.alias("command"), arguments.alias("arguments"))), F.lit("\n" + BLOCK_CLOSE))


def intents(choices: DataFrame, questions: Sequence[str]) -> DataFrame:
    """A row per choice and question; the answer is the block that runs the command with that value."""
    block = command_block(F.col("command"), F.map_from_arrays(F.array("parameter"), F.array("value")))
    values = {c: F.col(c) for c in ("command", "parameter", "value")} | {"block": block}
    return _expanded(choices, "intent", [Phrasing(q, "{block}") for q in questions], values)


def listing(catalog: DataFrame, per_part: int = 1000) -> DataFrame:
    """``part, text``: all commands, one to a line and in order, in parts of ``per_part``.

    Parts joined by line breaks are the whole list; no task holds more than
    parts, however long the catalog is.
    """
    numbered = with_row_id(catalog.select("command").filter("command is not null").distinct(), ["command"], name="__n")
    lines = F.sort_array(F.collect_list(F.struct("__n", "command")))
    parts = numbered.groupBy(whole_div(F.col("__n"), per_part).alias("part")).agg(lines.alias("l"))
    return parts.select("part", F.array_join(F.col("l.command"), "\n").alias("text"))


def validity(asked: DataFrame, catalog: DataFrame, known: str, unknown: str) -> DataFrame:
    """``asked`` with ``valid`` and an ``answer``: ``known`` or ``unknown`` with ``{command}`` filled in.

    Names are looked up without a leading slash, outer blanks and case. Null is not valid.
    """

    def name(c: str) -> Column:
        return F.lower(F.trim(F.regexp_replace(F.trim(F.col(c)), "^/", "")))

    names = catalog.select(name("command").alias("__name")).filter("__name is not null").distinct().withColumn("__known", F.lit(True))
    found = asked.withColumn("__name", name("command")).join(names, "__name", "left")
    valid = F.coalesce("__known", F.lit(False))
    values = {"command": F.col("command")}
    answer = F.when(valid, _filled(known, values)).otherwise(_filled(unknown, values))
    return found.select(*asked.columns, valid.alias("valid"), answer.alias("answer"))


def command_blocks(
    df: DataFrame, text: str, catalog: DataFrame, parameters: DataFrame, choices: DataFrame, *, row_id: str = "row_id"
) -> Exchange:
    """The command blocks of a text column: whole ones, and the others with a reason for each fault.

    Rows are ``row_id, block, command, arguments``, with arguments as text by
    name. Rejects are ``row_id, block, parameter, reason``: ``not json``, ``no
    command``, ``unknown command``, ``arguments`` that are no object, and per
    parameter ``unknown parameter``, ``not an integer`` or ``not a choice``; a
    text with more openings than closings has a reject ``unclosed``, without a
    block number. Arguments are values of the block: a string, number or
    boolean is taken as its text, anything else as its JSON. Lookups are joins
    by command, parameter and value, so catalogs may have any size.
    """
    marked = F.coalesce(F.col(text).cast("string"), F.lit(""))
    inside = F.regexp_extract_all(marked, F.lit(f"(?s){BLOCK_OPEN}(.*?){BLOCK_CLOSE}"), F.lit(1))
    found = df.select(row_id, F.posexplode(inside).alias("block", "json")).withColumn("v", F.try_parse_json("json"))
    name = F.try_variant_get("v", "$.command", "string")
    arguments = F.try_variant_get("v", "$.arguments", "map<string, string>")
    shape = F.schema_of_variant(F.try_variant_get("v", "$.arguments", "variant"))
    read = found.select(
        row_id,
        "block",
        name.alias("command"),
        F.coalesce(arguments, F.create_map().cast("map<string, string>")).alias("arguments"),
        F.when(F.col("v").isNull(), "not json")
        .when(name.isNull(), "no command")
        .when(shape.isNotNull() & ~shape.startswith("OBJECT") & (shape != "VOID"), "arguments")
        .alias("fault"),
    )
    names = catalog.select("command", F.lit(True).alias("__known")).filter("command is not null").distinct()
    judged = stage(read.join(names, "command", "left"), "command-blocks")
    fault = F.when(F.col("fault").isNull() & F.col("__known").isNull(), "unknown command").otherwise(F.col("fault"))
    nothing = F.lit(None).cast("string").alias("parameter")
    whole = judged.select(row_id, "block", nothing, fault.alias("reason")).filter("reason is not null")

    each = judged.filter(fault.isNull()).select(row_id, "block", "command", F.explode("arguments").alias("parameter", "value"))
    kinds = parameters.select("command", "parameter", "kind").distinct()
    allowed = choices.select("command", "parameter", "value", F.lit(True).alias("__allowed")).distinct()
    looked = each.join(kinds, ["command", "parameter"], "left").join(allowed, ["command", "parameter", "value"], "left")
    unfit = (
        F.when(F.col("kind").isNull(), "unknown parameter")
        .when((F.col("kind") == "integer") & ~F.coalesce(F.col("value").rlike(r"^-?[0-9]{1,18}$"), F.lit(False)), "not an integer")
        .when((F.col("kind") == "choice") & F.col("__allowed").isNull(), "not a choice")
    )
    single = looked.select(row_id, "block", "parameter", unfit.alias("reason")).filter("reason is not null")
    faults = stage(whole.unionByName(single), "block-faults")
    good = judged.join(faults, [row_id, "block"], "left_anti").select(row_id, "block", "command", "arguments")

    def times(mark: str) -> Column:
        return F.size(F.split(marked, mark)) - 1

    unclosed = df.filter(times(BLOCK_OPEN) > times(BLOCK_CLOSE))
    unclosed = unclosed.select(row_id, F.lit(None).cast("int").alias("block"), nothing, F.lit("unclosed").alias("reason"))
    return Exchange(good, faults.unionByName(unclosed))
