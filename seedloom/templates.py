"""Templates: named, ordered lists of column names."""

from __future__ import annotations

import json
import logging
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seedloom.sources.settings_store import read_text_file

log = logging.getLogger(__name__)

# The default templates.
DEFAULT_TEMPLATES: dict[str, list[str]] = {
    "chat": ["instruction", "input", "output"],
    "chat_task": ["task", "instruction", "input", "output"],
    "chat_modeltag": ["instruction", "input", "output"],
    "instruct": ["task", "instruction", "input", "output", "generationModel"],
    "instruct_modeltag": ["task", "instruction", "input", "output"],
    "commander": ["task", "instruction", "input", "output", "command"],
    "commander_modeltag": ["task", "instruction", "input", "output", "command", "generationModel"],
    "commander_testset": ["task", "instruction", "input", "command"],
    "commander_testset_modeltag": ["task", "instruction", "input", "command", "generationModel"],
    "duo_swarm": ["agent_instruct_one", "input", "output", "agent_instruct_two", "input", "output"],
    "duo_swarm_tag": ["agent_instruct_one", "input", "output", "agent_instruct_two", "input", "output", "generator"],
    "trio_swarm": ["agent_instruct_one", "input", "output", "agent_instruct_two", "input", "output", "agent_instruct_three", "input", "output", "generator"],
    "trio_swarm_tag": ["agent_instruct_one", "input", "output", "agent_instruct_two", "input", "output", "agent_instruct_three", "input", "output"],
    "aiConcept_instruct": ["task", "instruction", "input", "output", "concept", "definition", "useCase", "example"],
    "latexSeries": ["task", "instruction", "input", "output", "formula", "solution"],
    "latexTheory": ["task", "instruction", "input", "output", "theory", "explanation"],
    "latexMath": ["task", "instruction", "input", "output", "formula", "solution", "theory", "explanation"],
    "ontology1": ["task", "instruction", "input", "output", "ontology", "description"],
    "ontology2": ["task", "instruction", "input", "output", "ontology", "description", "chainOfThought"],
    "ontology3": ["task", "instruction", "input", "output", "ontology", "description", "application", "actions", "chainOfThought", "self_prompts"],
    "mathPythonFusion": ["task", "instruction", "input", "output", "formula", "solution", "python", "example"],
    "pythonBase": ["task", "instruction", "input", "output", "code", "description", "args", "returns"],
    "pythonOllama": ["task", "instruction", "input", "output", "code", "description", "args", "returns", "actions", "chainOfThought", "prompts"],
}


def unique_fields(fields: Iterable[str]) -> list[str]:
    """Number the fields whose name repeats, since columns need unique names."""
    fields = list(fields)
    repeats = {f for f, n in Counter(fields).items() if n > 1}
    seen: Counter[str] = Counter()
    out = []
    for field in fields:
        if field in repeats:
            seen[field] += 1
            field = f"{field}_{seen[field]}"
        out.append(field)
    return out


def _as_fields(value: object) -> list[str]:
    return list(value) if isinstance(value, (list, tuple, set)) else [str(value)]


class TemplateRegistry:
    """The templates a job knows, by name."""

    def __init__(self, templates: dict[str, object] | None = None) -> None:
        source = DEFAULT_TEMPLATES if templates is None else templates
        self._templates = {name: _as_fields(v) for name, v in source.items()}

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TemplateRegistry:
        """Read a JSON object of name to fields; defaults if there is no file."""
        text = read_text_file(spark, path)
        if text is None:
            log.warning("no templates at %s, using the defaults", path)
            return cls()
        return cls(json.loads(text))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the templates so that ``load`` finds them."""
        row = spark.createDataFrame([(self.to_json(),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(path)

    def names(self) -> list[str]:
        return list(self._templates)

    def add(self, name: str, fields: Iterable[str]) -> list[str]:
        if name in self._templates:
            raise ValueError(f"template {name!r} already exists")
        self._templates[name] = list(fields)
        return self._templates[name]

    def get(self, name: str) -> list[str] | None:
        if name not in self._templates:
            log.warning("template %r not found", name)
        return self._templates.get(name)

    def fields(self, name: str) -> list[str]:
        """Column names of a template; an unknown name is an error."""
        fields = self.get(name)
        if not fields:
            raise ValueError(f"template {name!r} not found")
        return unique_fields(fields)

    def schema(self, name: str) -> T.StructType:
        return T.StructType([T.StructField(f, T.StringType()) for f in self.fields(name)])

    def to_json(self) -> str:
        return json.dumps(self._templates, indent=2)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(name, fields) for name, fields in self._templates.items()]
        return spark.createDataFrame(rows, "template string, fields array<string>")
