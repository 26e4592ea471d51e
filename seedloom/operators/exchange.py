"""The exchange with a text generator: requests out, responses in.

Requests and responses are tables. A request id names the cell and a digest
of its prompts, so responses may come late, twice or in parts, and a response
to an outdated prompt is never used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.functions.expr import let
from seedloom.functions.text import (
    clean_generated,
    is_question,
    json_or_raw,
    py_strip,
    verified_ending,
)
from seedloom.operators.amplify import amplify, missing_rows, task_count
from seedloom.operators.roles import (
    DYNAMIC,
    check_roles,
    columns_with,
    reference_text,
)
from seedloom.prompts import PromptSet, fill_prompt
from seedloom.sources.staging import new_staging_path

# Fixed value: how a failed call shows up as content.
ERROR_PREFIX = "Error: "

KEYS = ["row_id", "sample_no"]


def failed(content: Column) -> Column:
    """Whether a response is no content: missing, or an error however it is padded."""
    return F.coalesce(py_strip(content).startswith(ERROR_PREFIX), F.lit(True))


_REQUEST = ["request_id", *KEYS, "column", "kind", "system", "user", "text"]


def _request(column: str, kind: str, system: str, user: Column, text: Column) -> Column:
    return F.struct(
        F.lit(column).alias("column"),
        F.lit(kind).alias("kind"),
        F.lit(system).alias("system"),
        user.alias("user"),
        text.alias("text"),
    )


def _digest(kind: Column, system: Column, user: Column) -> Column:
    return F.md5(F.concat_ws("\n", kind, system, user))


def _sample_key() -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in KEYS])


# What stands before the digest and the column in a request id.
_KEY_OF_ID = r"(?s)^(.*:-?\d+):[0-9a-f]{32}:"


def _identified(requests: DataFrame, copies: int | None = None, tasks: int | None = None) -> DataFrame:
    """Add the request id; with ``copies``, first number that many samples.

    The prompts of a cell do not depend on the sample, so they are filled and
    digested once per seed row and only then multiplied. With ``tasks``, rows
    are spread over so many before they are multiplied.
    """
    requests = requests.withColumn("__digest", _digest(F.col("kind"), F.col("system"), F.col("user")))
    if copies is not None:
        requests = amplify(requests, copies, tasks=tasks)
    request_id = F.concat_ws(":", _sample_key(), "__digest", "column")
    return requests.withColumn("request_id", request_id).drop("__digest")


def _cells(
    samples: DataFrame,
    roles: Mapping[str, str],
    prompts: PromptSet,
    kind: str,
    generated: Mapping[str, str],
) -> dict[str, tuple[str, Column, Column]]:
    """System prompt, user prompt and text of every dynamic column."""
    check_roles(samples, roles)
    references = reference_text(samples, roles)
    cells = {}
    for column in columns_with(roles, DYNAMIC):
        text = F.col(column).cast("string")
        asked = F.when(is_question(text), "True").otherwise("False")
        values = {
            "text": text,
            "original": text,
            "reference_values": references,
            "reference": references,
            "is_question": asked,
            "column": F.lit(column),
        }
        if column in generated:
            values["generated"] = F.col(generated[column])
        if "command" in samples.columns:
            values["command"] = F.col("command")
        user = fill_prompt(prompts.user_prompt(kind, column), values)
        cells[column] = (prompts.system_prompt(kind, column), user, text)
    if not cells:
        raise ValueError("no column has the role 'dynamic'")
    return cells


def build_requests(
    samples: DataFrame,
    roles: Mapping[str, str],
    prompts: PromptSet | None = None,
    *,
    kind: str = "generate",
    generated: Mapping[str, str] | None = None,
    copies: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """One request per sample and dynamic column.

    ``samples`` has ``row_id``, ``sample_no`` and the columns with roles; with
    ``copies`` it is the seed table, without ``sample_no``, and each row stands
    for that many samples. For the kinds ``verify`` and ``verify_paraphrase``,
    ``generated`` maps a column to the one with its new text. With ``tasks``
    the seeds are spread over so many before they are multiplied.
    """
    cells = _cells(samples, roles, prompts or PromptSet(), kind, generated or {})
    requests = [_request(c, kind, system, user, text) for c, (system, user, text) in cells.items()]
    keys = KEYS if copies is None else ["row_id"]
    found = samples.select(*keys, F.inline(F.array(*requests)))
    return _identified(found, copies, tasks).select(*_REQUEST)


def tag_requests(
    documents: DataFrame, content: str, fields: Sequence[str], prompts: PromptSet | None = None
) -> DataFrame:
    """Requests that ask for cell marks around the values of a text."""
    prompts, kind = prompts or PromptSet(), "tag_cells"
    text = F.col(content)
    values = {"text": text, "columns": F.lit(", ".join(fields))}
    user = fill_prompt(prompts.user_prompt(kind), values)
    found = documents.withColumn("sample_no", F.lit(1))
    request = _request(content, kind, prompts.system_prompt(kind), user, text)
    return _identified(found.select(*KEYS, F.inline(F.array(request)))).select(*_REQUEST)


def data_point_requests(
    rows: DataFrame, fields: Mapping[str, str], prompts: PromptSet | None = None
) -> DataFrame:
    """For each row id, one request per field; ``fields`` maps name to prompt."""
    prompts, kind = prompts or PromptSet(), "data_point"
    system, requests = prompts.system_prompt(kind), []
    for name, prompt in fields.items():
        values = {"column": F.lit(name), "prompt": F.lit(prompt)}
        user = fill_prompt(prompts.user_prompt(kind), values)
        requests.append(_request(name, kind, system, user, F.lit(prompt)))
    found = rows.select("row_id", F.lit(1).alias("sample_no"))
    return _identified(found.select(*KEYS, F.inline(F.array(*requests)))).select(*_REQUEST)


# --- responses -------------------------------------------------------------


def _best(content: Column) -> Column:
    """Of several contents the largest good one, else the largest error."""
    return F.max(F.struct((~failed(content)).alias("good"), content.alias("content")))["content"]


def best_responses(responses: DataFrame) -> DataFrame:
    """One response per request id: a good one before an error."""
    return responses.groupBy("request_id").agg(_best(F.col("content")).alias("content"))


def _names_sample() -> Column:
    """Whether a request id has the form that requests give it."""
    return F.coalesce(F.col("request_id").rlike(_KEY_OF_ID), F.lit(False))


def foreign_responses(responses: DataFrame) -> DataFrame:
    """Responses whose id is null or names no sample, as they came; no join uses them."""
    return responses.filter(~_names_sample())


def response_status(content: Column) -> Column:
    """``missing``, ``error`` or ``ok``."""
    return F.when(content.isNull(), "missing").when(failed(content), "error").otherwise("ok")


def _finished(content: Column, question: Column, kind: str) -> Column:
    """What a stripped response of a kind becomes as a cell."""
    if kind in ("paraphrase", "similar", "tag_cells"):
        return content
    if kind == "verify":
        return verified_ending(content, question)
    if kind == "verify_paraphrase":
        return verified_ending(content, question, restate=False)
    return clean_generated(content, question)


def judge_responses(
    samples: DataFrame,
    responses: DataFrame,
    roles: Mapping[str, str],
    prompts: PromptSet | None = None,
    *,
    kind: str = "generate",
    generated: Mapping[str, str] | None = None,
    copies: int | None = None,
) -> DataFrame:
    """One row per sample: its columns, ``failed`` and ``changed``.

    ``failed`` lists the cells that are not ok, with status ``missing``,
    ``error`` or ``empty`` and the response as it came; ``changed`` tells per
    dynamic column whether the cell differs from the one it was asked for.

    Of repeated responses the best is kept before anything is grouped, and
    those whose id names no sample are left to ``foreign_responses``. The others
    are grouped by the sample their id names and joined once with the samples,
    which compute the ids they expect; neither samples nor cells are taken
    apart. A row holds one answer per cell and version of its prompts.
    """
    prompts, generated = prompts or PromptSet(), generated or {}
    cells = _cells(samples, roles, prompts, kind, generated)
    expected = [
        F.struct(
            _digest(F.lit(kind), F.lit(system), user).alias("digest"), is_question(text).alias("question"), F.md5(text).alias("was")
        )
        for system, user, text in cells.values()
    ]
    keys = KEYS if copies is None else ["row_id"]
    kept = [c for c in roles if c not in cells]
    # The texts that were asked for stay behind; digests are joined.
    asked = samples.select(*keys, *kept, F.array(*expected).alias("__cells"))
    if copies is not None:
        asked = amplify(asked, copies)
    asked = asked.withColumn("__key", _sample_key())
    key = F.regexp_extract("request_id", _KEY_OF_ID, 1)
    # Dealt out by sample, both aggregates need no further shuffle.
    dealt = responses.filter(_names_sample()).select(key.alias("__key"), "request_id", "content").repartition("__key")
    best = dealt.groupBy("__key", "request_id").agg(_best(F.col("content")).alias("content"))
    answers = best.groupBy("__key").agg(F.collect_list(F.struct("request_id", "content")).alias("__answers"))
    joined = asked.join(answers, "__key", "left")

    def judged(n: int, column: str) -> Column:
        cell = F.col("__cells")[n]
        request_id = F.concat_ws(":", "__key", cell["digest"], F.lit(column))
        question = F.coalesce(cell["question"], F.lit(False))

        def mine(request_id: Column) -> Column:
            best = F.get(F.filter("__answers", lambda a: a["request_id"] == request_id), F.lit(0))["content"]

            def judge(content: Column) -> Column:
                def state(done: Column) -> Column:
                    status = response_status(content)
                    status = F.when((status == "ok") & (F.coalesce(done, F.lit("")) == ""), "empty").otherwise(status)
                    return F.struct(
                        request_id.alias("request_id"), status.alias("status"), content.alias("content"), done.alias("cell")
                    )

                return let(_finished(py_strip(content), question, kind), state)

            return let(best, judge)

        return let(request_id, mine).alias(f"__{n}")

    found = joined.select(*KEYS, *kept, "__cells", *[judged(n, c) for n, c in enumerate(cells)])
    names = list(cells)

    def bad(n: int) -> Column:
        j = F.col(f"__{n}")
        shown = F.struct(j["request_id"].alias("request_id"), F.lit(names[n]).alias("column"), j["status"].alias("status"), j["content"].alias("content"))
        return F.when(j["status"] != "ok", shown)

    def value(column: str) -> Column:
        return F.col(f"__{names.index(column)}")["cell"].alias(column) if column in cells else F.col(column)

    changed = [(~F.col("__cells")[n]["was"].eqNullSafe(F.md5(F.col(f"__{n}")["cell"]))).alias(c) for n, c in enumerate(names)]
    return found.select(
        *KEYS,
        *[value(c) for c in roles],
        F.array_compact(F.array(*[bad(n) for n in range(len(names))])).alias("failed"),
        F.struct(*changed).alias("changed"),
    )


class Exchange(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def split_samples(samples: DataFrame) -> Exchange:
    """Whole samples as rows, and the cells of the others to ask for again."""
    whole = F.size("failed") == 0
    rejects = samples.filter(~whole).select(*KEYS, F.inline("failed"))
    return Exchange(samples.filter(whole).drop("failed", "changed"), rejects)


def parsed_data_points(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every request with its status and its response: parsed JSON, or raw text if it is none."""
    joined = requests.join(best_responses(responses), "request_id", "left")
    judged = joined.withColumn("status", response_status(F.col("content")))
    usable = F.when(F.col("status") == "ok", F.col("content"))
    parsed = judged.withColumn("json", json_or_raw(usable))
    return parsed.select("request_id", *KEYS, "column", "status", "content", "json.*")


def fill_to_size(
    spark: SparkSession,
    seeds: DataFrame,
    size: int,
    fields: Mapping[str, str],
    prompts: PromptSet | None = None,
) -> DataFrame:
    """Requests for the rows that the seeds lack to reach ``size``."""
    return data_point_requests(missing_rows(spark, seeds.count(), size), fields, prompts)


def filled_rows(seeds: DataFrame, points: DataFrame, columns: Sequence[str]) -> Exchange:
    """The seed rows and, below them, one row per complete set of data points.

    The points that keep a row from being complete are the rejects.
    """
    text = F.coalesce(F.variant_get("value", "$", "string"), F.col("raw"))
    values = [F.max(F.when(F.col("column") == c, text)).alias(c) for c in columns]
    ok = F.count_if(F.col("status") == "ok").alias("__n")
    made = points.groupBy("row_id").agg(ok, *values)
    made = made.filter(F.col("__n") == len(columns)).drop("__n", "row_id")
    kept = seeds.select(*[F.col(c).cast("string").alias(c) for c in columns])
    rejects = points.filter("status <> 'ok'").select(*KEYS, "request_id", "column", "status", "content")
    return Exchange(kept.unionByName(made), rejects)


# --- generating inside the job --------------------------------------------

Generator = Callable[[pd.DataFrame], pd.Series]
# Requests that a generator gets at a time.
CALL = 256


def restate(requests: pd.DataFrame) -> pd.Series:
    """A rule in place of a model: repeat the text with the sample number."""
    number = requests["sample_no"].astype(str)
    return "Variant " + number + ": " + requests["text"].fillna("None")


def generate(
    requests: DataFrame, generator: Generator = restate, *, tasks: int | None = None, spread: bool = True
) -> DataFrame:
    """Responses from a function over batches of requests.

    ``generator`` gets a pandas batch of requests and returns their contents;
    if it fails, or returns another number of them, each request of the batch
    gets an error as its content. A batch has ``CALL`` requests at most, so that
    a task holds as pandas rows no more than these. Requests are spread evenly first: a call
    costs time that their bytes, which AQE goes by, do not show. Without
    ``spread`` they are taken as they lie, as after ``build_requests(tasks=...)``.
    """

    def contents(batch: pd.DataFrame) -> list:
        try:
            made = list(generator(batch))
        except Exception as error:  # whatever a model call may raise
            return [f"{ERROR_PREFIX}{error}"] * len(batch)
        if len(made) != len(batch):
            return [f"{ERROR_PREFIX}{len(made)} contents for {len(batch)} requests"] * len(batch)
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CALL):
                part = batch.slice(at, CALL)
                made = pa.array(pd.Series(contents(part.to_pandas()), dtype="object"), pa.string(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([part.column("request_id"), made], ["request_id", "content"])

    if spread:
        requests = requests.repartition(tasks or task_count(requests.sparkSession), "request_id")
    return requests.mapInArrow(run, "request_id string, content string")


def generate_to(
    requests: DataFrame,
    path: str | None = None,
    generator: Generator = restate,
    *,
    tasks: int | None = None,
    spread: bool = True,
) -> DataFrame:
    """Generate once, keep the responses in a table and return them read back.

    Model calls are dear and not repeatable; nothing later may rerun them.
    """
    spark = requests.sparkSession
    path = path or new_staging_path(spark, "responses")
    generate(requests, generator, tasks=tasks, spread=spread).write.parquet(path)
    return spark.read.parquet(path)


def apply_responses(
    samples: DataFrame,
    responses: DataFrame,
    roles: Mapping[str, str],
    prompts: PromptSet | None = None,
    *,
    kind: str = "generate",
    generated: Mapping[str, str] | None = None,
    copies: int | None = None,
) -> Exchange:
    """Put responses into the dynamic cells; failed cells become rejects."""
    judged = judge_responses(
        samples, responses, roles, prompts, kind=kind, generated=generated, copies=copies
    )
    return split_samples(judged)


# --- named uses --------------------------------------------------------------


def all_dynamic(df: DataFrame) -> dict[str, str]:
    """Roles for variants in which every column is rewritten."""
    return {c: DYNAMIC for c in df.columns if c not in KEYS}


def one_sample(spark: SparkSession, values: Mapping[str, str]) -> DataFrame:
    """A single row to paraphrase, as a seed table."""
    schema = ", ".join(f"`{c}` string" for c in values)
    return spark.createDataFrame([tuple(values.values())], schema).withColumn(
        "row_id", F.lit(0).cast("long")
    )


