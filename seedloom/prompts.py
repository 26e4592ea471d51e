"""Prompt sets and how a prompt becomes a column."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from seedloom.sources.settings_store import load_setting, save_setting, setting_names

_GIVEN = "Text: {text}\nReference values: {reference_values}\nQuestion: {is_question}\n\n"

# kind -> (system prompt, user prompt); users replace them with a PromptSet.
DEFAULT_PROMPTS: dict[str, tuple[str, str]] = {
    "generate": (
        "You write rows for a training dataset. Vary the wording, keep the facts, "
        "and respect the reference values you are given.",
        _GIVEN + "Write a new value for the column '{column}' that says the same "
        "and uses the reference values. Answer with the value only.",
    ),
    "generate:input": (
        "",
        _GIVEN + "Ask the same thing in other words, as one question that begins "
        "with a question word, ends with a question mark and uses the reference "
        "values. Answer with the question only.",
    ),
    "generate:output": (
        "",
        _GIVEN + "State the same thing in other words, as plain sentences that end "
        "with a full stop and use the reference values. Answer with the statement only.",
    ),
    "paraphrase": (
        "You reword text without losing any detail and without adding remarks.",
        "Text: {text}\nReference values: {reference_values}\n\nReword the text. Keep a "
        "question a question and a statement a statement. Answer with the new text only.",
    ),
    "verify": (
        "You check reworded text against its source and correct it where it differs.",
        "Source: {original}\nReworded: {generated}\nReference values: {reference}\n"
        "Question: {is_question}\n\nIf meaning, form and reference values are right, "
        "repeat the reworded text, else correct it. Answer with the text only.",
    ),
    "verify_paraphrase": (
        "You check a paraphrase against its source and correct it where it differs.",
        "Source: {original}\nParaphrase: {generated}\nReference values: {reference}\n"
        "Question: {is_question}\n\nIf meaning, form and reference values are right, "
        "repeat the paraphrase, else correct it. Answer with the text only.",
    ),
    "plain_paraphrase": (
        "You reword text with a different structure and the same meaning.",
        "Reword this text:\n{text}\nAnswer with the new text only.",
    ),
    "command_question": (
        "You turn notes into clear questions about a command.",
        "Note: {text}\nCommand: {command}\n\nAsk one short question about what the "
        "command does.",
    ),
    "tag_cells": (
        'You mark up text with $("...") around each value.',
        'Wrap every value of the text below as $("value"), in the order {columns}, '
        "starting over after the last. Change nothing inside a value, keep its line "
        "breaks, and leave text that is no value unmarked.\n\n{text}",
    ),
    "data_point": (
        "You invent data. Answer with one valid JSON value and nothing else.",
        "Invent a value for {column}: {prompt}",
    ),
    "similar": (
        "You invent data. Answer with the value only.",
        "Write a {column} like this one, with other words and the same meaning: {text}",
    ),
}


@dataclass
class PromptSet:
    """Prompts of one job; whatever is left out falls back to the defaults."""

    system: str = ""
    columns: dict[str, dict[str, str]] = field(default_factory=dict)
    kinds: dict[str, dict[str, str]] = field(default_factory=dict)

    def system_prompt(self, kind: str, column: str | None = None) -> str:
        """Prompt of the column, else of the job, else of the kind."""
        own = self.columns.get(column or "", {}) if kind == "generate" else {}
        if kind == "generate":
            return own.get("system") or self.system or DEFAULT_PROMPTS[kind][0]
        return self.kinds.get(kind, {}).get("system") or DEFAULT_PROMPTS[kind][0]

    def user_prompt(self, kind: str, column: str | None = None) -> str:
        if kind == "generate":
            own = self.columns.get(column or "", {}).get("user")
            default = DEFAULT_PROMPTS.get(f"generate:{column}", DEFAULT_PROMPTS[kind])
            return own or default[1]
        return self.kinds.get(kind, {}).get("user") or DEFAULT_PROMPTS[kind][1]

    def to_json(self) -> str:
        value = {"system": self.system, "dynamicColumns": self.columns, **self.kinds}
        return json.dumps(value, indent=2)

    @classmethod
    def from_json(cls, text: str) -> PromptSet:
        value = copy.deepcopy(json.loads(text))
        return cls(
            system=value.pop("system", ""),
            columns=value.pop("dynamicColumns", {}),
            kinds={k: v for k, v in value.items() if isinstance(v, dict)},
        )

    def save(self, spark: SparkSession, folder: str, name: str) -> None:
        save_setting(spark, folder, name, self.to_json())

    @classmethod
    def load(cls, spark: SparkSession, folder: str, name: str) -> PromptSet:
        text = load_setting(spark, folder, name)
        if text is None:
            raise KeyError(f"prompt set {name!r} not found in {folder}")
        return cls.from_json(text)


def prompt_set_names(spark: SparkSession, folder: str) -> list[str]:
    return setting_names(spark, folder)


def _pieces(template: str, names: set[str]) -> list[tuple[str, str | None]]:
    """Cut a prompt into (literal, placeholder name or None) pieces.

    A prompt that is a valid format string over the known names is read as
    one; any other keeps its odd braces and only has the known names filled.
    """
    try:
        parsed = list(Formatter().parse(template))
        plain = all(f is None or (f in names and not s and not c) for _, f, s, c in parsed)
    except ValueError:
        plain = False
    if plain:
        return [(text, name) for text, name, _, _ in parsed]
    pattern = r"\{(" + "|".join(sorted(map(re.escape, names))) + r")\}"
    cut = re.split(pattern, template)
    tail = [(cut[-1], None)] if len(cut) % 2 else []
    return [(cut[i], cut[i + 1]) for i in range(0, len(cut) - 1, 2)] + tail


def fill_prompt(template: str, values: dict[str, Column]) -> Column:
    """Fill a prompt's placeholders with columns.

    The prompt is cut up on the driver, so a value that itself contains a
    placeholder is never filled a second time. NULL shows as ``None``.
    """
    parts: list[Column] = []
    for text, name in _pieces(template, set(values)):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")
