"""One query per operator over the given tables, each with its SQL twin.

Every query reads whole tables. The tables hold no tagged text and no
responses, so the queries derive them from the texts with Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.functions import text as X
from seedloom.functions import urls as U
from seedloom.operators import checks, combining, exchange, parsing, profiling, refine, rendering, rows
from seedloom.operators.amplify import amplify, amplify_total
from seedloom.operators.augment import NOISE, TEXT_SUFFIX, augment
from seedloom.operators.numbering import with_row_id
from seedloom.operators.roles import default_roles, reference_map, reference_text, role_columns
from seedloom.operators.sampling import sample_rows
from seedloom.plans import generation
from seedloom.plans.reshape import save_edits
from seedloom.plans.text_to_dataset import convert_tagged_files, parse_documents
from seedloom.prompts import DEFAULT_PROMPTS, PromptSet, _pieces
from seedloom.sources import readers, writers
from seedloom.sources.staging import new_staging_path
from seedloom.sources.zones import Zones
from seedloom.templates import TemplateRegistry

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- SQL building blocks ------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {q(X.PYTHON_WHITESPACE)})"


def sql_question(x: str) -> str:
    words = "|".join(X.QUESTION_WORDS)
    stripped = f"rtrim({x}, {q(X.PYTHON_WHITESPACE)})"
    return f"(ends_with({stripped}, '?') OR regexp_matches({x}, '^(?i:{words})'))"


def sql_cells(content: str) -> str:
    return (
        f"[string_split(p, '\")')[1] for p in string_split({content}, '$(\"')[2:] "
        "if contains(p, '\")')]"
    )


def sql_clean(x: str, question: str) -> str:
    body = f"regexp_replace({x}, '^(?i:{'|'.join(X.LEADING_LABELS)})\\s*', '')"
    labels = "|".join(X.TRAILING_LABELS)
    body = f"regexp_replace({body}, '\\s*(?i:{labels})[^\\n]*(\\n?)$', '\\1')"
    body = f"regexp_replace({body}, '___[A-Za-z_]+___', '', 'g')"
    body = sql_strip(f"trim({body}, {q(chr(34) + chr(39))})")
    raised = f"upper(substr({body}, 1, 1)) || substr({body}, 2)"
    return (
        f"CASE WHEN {question} THEN CASE WHEN ends_with({body}, '?') THEN {raised} ELSE {raised} || '?' END "
        f"WHEN {body} = '' THEN NULL WHEN right({body}, 1) IN ('.', '!', '?') THEN {raised} "
        f"ELSE {raised} || '.' END"
    )


def sql_fill(template: str, values: dict[str, str]) -> str:
    parts = []
    for literal, name in _pieces(template, set(values)):
        if literal:
            parts.append(q(literal))
        if name:
            parts.append(f"coalesce(CAST({values[name]} AS VARCHAR), 'None')")
    return "concat(" + ", ".join(parts) + ")"


# --- tagged text -----------------------------------------------------------------

CHAT = TemplateRegistry().fields("chat_task")
COMMANDER = TemplateRegistry().fields("commander")
PLAIN = TemplateRegistry().fields("chat")
DUO = TemplateRegistry().fields("duo_swarm")


@query(
    f"""
    WITH tagged AS (SELECT conv_id, turn, '$("' || role || '")' || chr(10) || '$("' || text || '")' AS t
                    FROM conversations),
         parsed AS (SELECT conv_id, turn, {sql_cells('t')} AS c FROM tagged)
    SELECT conv_id, turn, CAST(0 AS BIGINT) AS row_no, {sql_strip('c[1]')} AS role, {sql_strip('c[2]')} AS text
    FROM parsed
    """
)
def tag_roundtrip(spark, folder):
    turns = table(spark, folder, "conversations")
    tagged = turns.select("conv_id", "turn", writers.tagged_row(["role", "text"]).alias("content"))
    return parsing.parse_tagged(tagged, "content", ["role", "text"], keep=["conv_id", "turn"])


def tagged_lines() -> Column:
    """A text with each of its lines as a marked cell."""
    return F.array_join(F.transform(F.split("text", "\n"), lambda line: X.marked_cell(line)), "\n")


def tagged_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tagged_lines().alias("content"))


_SQL_CELLS = f"""
    tagged AS (SELECT doc_id, '$("' || replace(text, chr(10), '")' || chr(10) || '$("') || '")' AS t
               FROM documents),
    parsed AS (SELECT doc_id, {sql_cells('t')} AS c FROM tagged)
"""


def sql_rows(fields: list[str], strip: bool, drop: bool) -> str:
    n = len(fields)
    count = f"len(c) // {n}" if drop else f"(len(c) + {n - 1}) // {n}"

    def cell(j: int) -> str:
        value = f"c[r * {n} + {j + 1}]"
        return f"coalesce({sql_strip(value) if strip else value}, '') AS {fields[j]}"

    return f"""
    WITH {_SQL_CELLS},
         numbered AS (SELECT doc_id, c, unnest(range(CAST({count} AS BIGINT))) AS r FROM parsed)
    SELECT doc_id, r AS row_no, {', '.join(cell(j) for j in range(n))} FROM numbered
    """


@query(sql_rows(CHAT, strip=True, drop=False))
def template_padded(spark, folder):
    return parsing.parse_tagged(tagged_documents(spark, folder), "content", CHAT, keep=["doc_id"])


@query(sql_rows(COMMANDER, strip=False, drop=True))
def template_dropped(spark, folder):
    return parsing.parse_tagged(
        tagged_documents(spark, folder), "content", COMMANDER, keep=["doc_id"], strip=False, ragged="drop"
    )


@query(sql_rows(PLAIN, strip=False, drop=False))
def multi_turn_rows(spark, folder):
    return parsing.parse_tagged(
        tagged_documents(spark, folder), "content", PLAIN, keep=["doc_id"], strip=False
    )


@query(
    f"""
    WITH {_SQL_CELLS},
         numbered AS (SELECT doc_id, c, unnest(range(CAST(((len(c) + 5) // 6) // 2 AS BIGINT))) AS p FROM parsed)
    SELECT doc_id, p AS pair_no,
           c[p * 12 + 1] AS one_instruction, coalesce(c[p * 12 + 2], '') AS one_input,
           coalesce(c[p * 12 + 3], '') AS one_output,
           coalesce(c[p * 12 + 10], '') AS two_instruction, coalesce(c[p * 12 + 11], '') AS two_input,
           coalesce(c[p * 12 + 12], '') AS two_output
    FROM numbered
    """
)
def agent_pairs(spark, folder):
    pairs = parsing.pair_agents(tagged_documents(spark, folder), "content", keep=["doc_id"])
    flat = [
        F.col(f"agent_{side}.{part}").alias(f"{side}_{part}")
        for side in ("one", "two")
        for part in ("instruction", "input", "output")
    ]
    return pairs.select("doc_id", "pair_no", *flat)


@query(
    """
    WITH spoken AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i
                    FROM conversations WHERE role <> 'system')
    SELECT a.conv_id, a.i // 2 AS pair_no, a.role AS role_one, a.text AS text_one,
           b.role AS role_two, b.text AS text_two
    FROM spoken a JOIN spoken b ON a.conv_id = b.conv_id AND b.i = a.i + 1
    WHERE a.i % 2 = 0
    """
)
def turn_pairs(spark, folder):
    turns = table(spark, folder, "conversations")
    pairs = parsing.pair_turns(turns, "conv_id", "turn", ["role", "text"], skip=F.col("role") == "system")
    return pairs.select("conv_id", "pair_no", "role_one", "text_one", "role_two", "text_two")


def _sql_lines_of(j: int) -> str:
    return (
        f"string_agg(line, chr(10) ORDER BY i) FILTER (i % 3 = {j}) AS {PLAIN[j]}, "
        f"count(*) FILTER (i % 3 = {j}) AS {PLAIN[j]}_lines"
    )


@query(
    f"""
    WITH lines AS (SELECT doc_id, {sql_strip('l')} AS line, i - 1 AS i
                   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
                                generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
         dealt AS (SELECT doc_id, {', '.join(_sql_lines_of(j) for j in range(3))}
                   FROM lines WHERE line <> '' GROUP BY doc_id)
    SELECT d.doc_id, {', '.join(f"coalesce({c}, '') AS {c}, coalesce({c}_lines, 0) AS {c}_lines" for c in PLAIN)}
    FROM documents d LEFT JOIN dealt USING (doc_id)
    """
)
def round_robin_lines(spark, folder):
    dealt = parsing.round_robin_lines(table(spark, folder, "documents"), "text", PLAIN, keep=["doc_id"])
    columns = []
    for c in PLAIN:
        columns += [F.array_join(c, "\n").alias(c), F.size(c).cast("long").alias(f"{c}_lines")]
    return dealt.select("doc_id", *columns)


@query(
    f"""
    WITH {_SQL_CELLS},
         numbered AS (SELECT doc_id, c, unnest(range(CAST((len(c) + 2) // 3 AS BIGINT))) AS r FROM parsed)
    SELECT doc_id AS row_id, r AS row_no, {sql_strip('c[r * 3 + 1]')} AS instruction,
           coalesce({sql_strip('c[r * 3 + 2]')}, '') AS input, coalesce({sql_strip('c[r * 3 + 3]')}, '') AS output
    FROM numbered
    """
)
def automatic_parse(spark, folder):
    documents = table(spark, folder, "documents").withColumnRenamed("doc_id", "row_id")
    asked = exchange.tag_requests(documents, "text", PLAIN)
    answers = asked.select("request_id", tagged_lines().alias("content"))
    return parse_documents(documents, "text", PLAIN, mode="automatic", responses=answers).rows


def failing(requests: DataFrame, content: Column) -> DataFrame:
    """Responses of which some are missing, failed, or failed with blanks around."""
    luck = F.substring(F.md5("request_id"), 1, 1)
    given = F.when(luck == "0", "Error: timed out").when(luck == "1", F.lit(' Error: call $("x") failed')).otherwise(content)
    return requests.filter(luck != "2").select("request_id", given.alias("content"))


def _sql_failing(requests: str) -> str:
    luck = f"SELECT *, left(md5(request_id), 1) AS luck FROM ({requests})"
    return f"""
        SELECT request_id, row_id, sample_no, "column", CASE luck WHEN '2' THEN 'missing' ELSE 'error' END AS status,
               CASE luck WHEN '0' THEN 'Error: timed out' WHEN '1' THEN ' Error: call $("x") failed' END AS content
        FROM ({luck}) WHERE luck IN ('0', '1', '2')
    """


def shown_rejects(rejects: DataFrame) -> DataFrame:
    return rejects.withColumn("sample_no", F.col("sample_no").cast("long"))


# --- text rules --------------------------------------------------------------------


@query(
    f"""
    SELECT doc_id, {sql_question('text')} AS question,
           ends_with(rtrim(text, {q(X.PYTHON_WHITESPACE)}), '?')
           OR regexp_matches(text, '^(?i:{'|'.join(X.QUESTION_WORDS)})(?:[^\\pL\\pN_]|$)') AS strict_question
    FROM documents
    """
)
def is_question(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        X.is_question(text).alias("question"),
        X.is_question(text, word_boundary=True).alias("strict_question"),
    )


_WRAPPED = [
    ("plain", "", ""),
    ("labelled", 'generated CONTENT:  "', ' ___slot_name___" Note: nothing else'),
    ("two_lines", "Corrected version:\n'", "'\nVerification result: fine\n"),
]


@query(
    "WITH wrapped AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, {q(name)} AS form, {q(head)} || text || {q(tail)} AS t, {sql_question('text')} AS question FROM documents"
        for name, head, tail in _WRAPPED
    )
    + f") SELECT doc_id, form, {sql_clean('t', 'question')} AS cleaned FROM wrapped"
)
def clean_generated(spark, folder):
    forms = [
        F.struct(
            F.lit(name).alias("form"), F.concat(F.lit(head), F.col("text"), F.lit(tail)).alias("t")
        )
        for name, head, tail in _WRAPPED
    ]
    question = X.is_question(F.col("text")).alias("question")
    wrapped = table(spark, folder, "documents").select("doc_id", question, F.inline(F.array(*forms)))
    return wrapped.select("doc_id", "form", X.clean_generated(F.col("t"), F.col("question")).alias("cleaned"))


def _sql_verified(t: str, question: str) -> str:
    return (
        f"CASE WHEN {question} AND NOT ends_with({t}, '?') THEN {t} || '?' "
        f"WHEN NOT {question} AND ends_with({t}, '?') THEN left({t}, length({t}) - 1) || '.' ELSE {t} END"
    )


@query(
    f"""
    WITH ended AS (SELECT doc_id, lang = 'en' AS asked, {sql_strip("text || '? '")} AS a, {sql_strip('text')} AS b
                   FROM documents)
    SELECT doc_id, {_sql_verified('a', 'asked')} AS from_question, {_sql_verified('b', 'asked')} AS from_text
    FROM ended
    """
)
def verified_ending(spark, folder):
    asked = F.col("lang") == "en"
    return table(spark, folder, "documents").select(
        "doc_id",
        X.verified_ending(F.concat("text", F.lit("? ")), asked).alias("from_question"),
        X.verified_ending(F.col("text"), asked).alias("from_text"),
    )


@query(
    """
    WITH forms AS (SELECT event_id, event_type, props AS p FROM events
                   UNION ALL SELECT event_id, event_type, ' ' || props || '} ' FROM events
                   UNION ALL SELECT event_id, event_type, event_type FROM events)
    SELECT event_id, event_type, trim(p) AS raw, json_valid(trim(p)) AS is_json,
           CASE WHEN json_valid(trim(p)) THEN CAST(json_extract(trim(p), '$.k') AS BIGINT) END AS k
    FROM forms
    """
)
def json_or_raw(spark, folder):
    forms = F.array("props", F.concat(F.lit(" "), "props", F.lit("} ")), "event_type")
    events = table(spark, folder, "events").select("event_id", "event_type", F.explode(forms).alias("p"))
    parsed = events.withColumn("json", X.json_or_raw(F.col("p"))).select("event_id", "event_type", "json.*")
    k = F.try_variant_get("value", "$.k", "bigint").alias("k")
    return parsed.select("event_id", "event_type", "raw", "is_json", k)


_HOSTS = {
    "wikipedia": "https://en.wikipedia.org/wiki/Title_%C3%A9",
    "arxiv": "https://arxiv.org/abs",
    "hub_dataset": "https://huggingface.co/datasets",
    "hub_repo": "https://huggingface.co",
    "github": "https://GitHub.com/Owner/Name/tree",
    "bare": "plain.example.org",
}


def page_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's URL, and its path under hosts of every known kind."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1)
    forms = [F.col("url"), *[F.concat(F.lit(host), path) for host in _HOSTS.values()]]
    return table(spark, folder, "pages").select("page_id", F.explode(F.array(*forms)).alias("source"))


_SQL_URLS = (
    "sources AS (SELECT page_id, url AS source FROM pages"
    + "".join(
        f" UNION ALL SELECT page_id, {q(host)} || regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) FROM pages"
        for host in _HOSTS.values()
    )
    + """),
    full_urls AS (SELECT *, CASE WHEN regexp_matches(source, '^[a-z]+://[^/]') THEN source
                                 ELSE 'http://' || source END AS u FROM sources),
    parts AS (SELECT *, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) AS host,
                     regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, lower(u) AS l FROM full_urls),
    kinds AS (SELECT *, CASE
        WHEN ends_with(host, 'wikipedia.org') AND contains(path, '/wiki/') THEN 'wikipedia'
        WHEN contains(l, 'arxiv.org') THEN 'arxiv'
        WHEN contains(l, 'huggingface.co/') AND NOT contains(l, 'datasets/') THEN 'hub_repo'
        WHEN contains(l, 'huggingface.co/datasets/') THEN 'hub_dataset'
        WHEN contains(l, 'github.com') THEN 'github' ELSE 'web' END AS kind FROM parts),
    named AS (SELECT *,
        CASE WHEN kind = 'wikipedia' THEN replace(url_decode(split_part(path, '/wiki/', 2)), '_', ' ') END AS title,
        CASE WHEN kind = 'arxiv' THEN regexp_extract(rtrim(u, '/'), '[^/]*$') END AS arxiv_id,
        CASE WHEN kind = 'hub_dataset' THEN rtrim(regexp_extract(u, 'huggingface.co/datasets/(.*)', 1), '/') END AS dataset,
        CASE WHEN kind = 'hub_repo' THEN trim(coalesce(string_split(u, 'huggingface.co/')[2], ''), '/') END AS hub,
        CASE WHEN kind = 'github' THEN regexp_extract(l, 'github.com/([^/]*/[^/]*)', 1) END AS repo,
        CASE WHEN kind = 'github' THEN regexp_extract(l, 'tree/([^/]*)', 1) END AS branch FROM kinds)
    """
)


@query(f"WITH {_SQL_URLS} SELECT page_id, source, kind FROM kinds")
def url_kind(spark, folder):
    kind = U.url_kind(F.col("source")).alias("kind")
    return page_urls(spark, folder).select("page_id", "source", kind)


@query(f"WITH {_SQL_URLS} SELECT page_id, source, title, arxiv_id, dataset, hub, repo, branch FROM named")
def url_parts(spark, folder):
    url = F.col("url")
    kinds = page_urls(spark, folder).select(
        "page_id",
        "source",
        U.with_scheme(F.col("source")).alias("url"),
        U.url_kind(F.col("source")).alias("kind"),
    )

    def of(kind: str, part: Column, name: str) -> Column:
        return F.when(F.col("kind") == kind, part).alias(name)

    return kinds.select(
        "page_id",
        "source",
        of("wikipedia", U.wikipedia_title(url), "title"),
        of("arxiv", U.arxiv_id(url), "arxiv_id"),
        of("hub_dataset", U.hub_dataset(url), "dataset"),
        of("hub_repo", U.hub_repo(url), "hub"),
        of("github", U.github_repo(url), "repo"),
        of("github", U.github_branch(url), "branch"),
    )


@query(
    f"""
    WITH {_SQL_URLS},
         files AS (SELECT page_id, source, CASE kind
             WHEN 'wikipedia' THEN title WHEN 'arxiv' THEN 'arxiv_' || arxiv_id
             WHEN 'hub_dataset' THEN replace(dataset, '/', '_')
             WHEN 'github' THEN replace(repo, '/', '_') || '_' || branch
             ELSE regexp_extract(path, '[^/]*$') END AS name FROM named)
    SELECT page_id, source, CASE WHEN name = '' THEN 'webpage' ELSE name END || '_extracted.txt' AS file_name FROM files
    """
)
def source_output_name(spark, folder):
    name = U.extracted_name(F.col("source")).alias("file_name")
    return page_urls(spark, folder).select("page_id", "source", name)


# --- sampling, amplifying, roles ------------------------------------------------------


@query(
    """
    SELECT doc_id, source FROM documents
    QUALIFY row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id)
            <= CAST(floor((SELECT count(*) FROM documents) * (37.5 / 100)) AS BIGINT)
    """
)
def seed_sample(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return sample_rows(documents, rate=37.5, row_id="doc_id")


@query("SELECT doc_id AS row_id, quality, unnest(range(1, 6))::BIGINT AS sample_no FROM labels")
def amplify_even(spark, folder):
    seeds = table(spark, folder, "labels").selectExpr("doc_id AS row_id", "quality")
    return amplify(seeds, 5).withColumn("sample_no", F.col("sample_no").cast("long"))


@query(
    """
    WITH counted AS (SELECT doc_id AS row_id, row_number() OVER (ORDER BY doc_id) - 1 AS i,
                            count(*) OVER () AS n FROM labels),
         quotas AS (SELECT row_id, (2 * n + 17) // n + CASE WHEN i < (2 * n + 17) % n THEN 1 ELSE 0 END AS quota
                    FROM counted)
    SELECT row_id, unnest(range(1, quota + 1))::BIGINT AS sample_no FROM quotas
    """
)
def amplify_uneven(spark, folder):
    seeds = table(spark, folder, "labels").selectExpr("doc_id AS row_id")
    samples = amplify_total(seeds, 2 * seeds.count() + 17)
    return samples.withColumn("sample_no", F.col("sample_no").cast("long"))


def seed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as seeds of a question and answer template."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("task"),
        F.col("text").alias("input"),
        F.concat(F.col("source"), F.lit(" holds text in "), F.col("lang")).alias("output"),
        F.col("lang").alias("command"),
    )


ROLES = default_roles(["task", "input", "output", "command"])

_SQL_SEEDS = """
    seeds AS (SELECT doc_id AS row_id, source AS task, text AS input,
                     source || ' holds text in ' || lang AS output, lang AS command FROM documents),
    samples AS (SELECT *, unnest(range(1, 3))::BIGINT AS sample_no FROM seeds)
"""


@query(
    f"""
    WITH {_SQL_SEEDS}
    SELECT row_id, sample_no, task, command, '{{''command'': ''' || command || '''}}' AS shown, command AS reference
    FROM samples
    """
)
def roles_applied(spark, folder):
    roles = {c: r for c, r in ROLES.items() if r != "dynamic"}
    samples = amplify(role_columns(seed_rows(spark, folder), roles, ["row_id"]), 2)
    return samples.select(
        "row_id",
        F.col("sample_no").cast("long").alias("sample_no"),
        "task",
        "command",
        reference_text(samples, roles).alias("shown"),
        F.element_at(reference_map(roles), "command").alias("reference"),
    )


# --- exchange ----------------------------------------------------------------------------


def sql_requests(source: str, columns: list[str], kind: str, extra: dict[str, dict[str, str]] | None = None) -> str:
    """Requests over a relation with row_id, sample_no, command and the columns."""
    prompts, selects = PromptSet(), []
    references = "'{''command'': ''' || command || '''}'"
    for c in columns:
        values = {
            "text": c, "original": c, "reference_values": references, "reference": references,
            "is_question": f"CASE WHEN {sql_question(c)} THEN 'True' ELSE 'False' END", "column": q(c),
            "command": "command", **(extra or {}).get(c, {}),
        }
        system = prompts.system_prompt(kind, c)
        user = sql_fill(prompts.user_prompt(kind, c), values)
        selects.append(
            f"""SELECT row_id || ':' || sample_no || ':' || md5({q(kind)} || chr(10) || {q(system)} || chr(10) || {user})
                       || ':' || {q(c)} AS request_id, row_id, sample_no, {q(c)} AS "column", {q(kind)} AS kind,
                       {q(system)} AS system, {user} AS user_prompt, {c} AS text,
                       {sql_question(c)} AS question FROM {source}"""
        )
    return " UNION ALL ".join(selects)


_SQL_SELECT_REQUESTS = (
    'SELECT request_id, row_id, sample_no, "column", kind, system, user_prompt, text FROM requests'
)


def shown_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumn("sample_no", F.col("sample_no").cast("long")).withColumnRenamed(
        "user", "user_prompt"
    )


def samples_of(spark: SparkSession, folder: str) -> DataFrame:
    return amplify(role_columns(seed_rows(spark, folder), ROLES, ["row_id"]), 2)


_SQL_GENERATE = f"{_SQL_SEEDS}, requests AS ({sql_requests('samples', ['input', 'output'], 'generate')})"


@query(f"WITH {_SQL_GENERATE} {_SQL_SELECT_REQUESTS}")
def build_requests(spark, folder):
    return shown_requests(exchange.build_requests(samples_of(spark, folder), ROLES))


_SQL_VERIFY = sql_requests(
    "samples", ["input", "output"], "verify",
    {c: {"generated": f"'Variant ' || sample_no || ': ' || {c}"} for c in ("input", "output")},
)


@query(f"WITH {_SQL_SEEDS}, requests AS ({_SQL_VERIFY}) {_SQL_SELECT_REQUESTS}")
def verify_requests(spark, folder):
    samples = samples_of(spark, folder)
    for c in ("input", "output"):
        new = F.concat(F.lit("Variant "), F.col("sample_no"), F.lit(": "), F.col(c))
        samples = samples.withColumn(f"{c}_new", new)
    generated = {"input": "input_new", "output": "output_new"}
    return shown_requests(exchange.build_requests(samples, ROLES, kind="verify", generated=generated))


_OTHER_KINDS = ["paraphrase", "plain_paraphrase", "command_question"]


@query(
    f"WITH {_SQL_SEEDS}, requests AS ("
    + " UNION ALL ".join(sql_requests("samples", ["output"], kind) for kind in _OTHER_KINDS)
    + f") {_SQL_SELECT_REQUESTS}"
)
def request_kinds(spark, folder):
    samples = samples_of(spark, folder).drop("input")
    roles = {c: r for c, r in ROLES.items() if c != "input"}
    found = [exchange.build_requests(samples, roles, kind=kind) for kind in _OTHER_KINDS]
    return shown_requests(combining.combine(found))


_SQL_PARTS = "samples AS (SELECT p_partkey AS row_id, p_name, p_brand, '' AS command, unnest(range(1, 11))::BIGINT AS sample_no FROM part)"


@query(f"WITH {_SQL_PARTS}, requests AS ({sql_requests('samples', ['p_name', 'p_brand'], 'similar')}) {_SQL_SELECT_REQUESTS}")
def ten_variants(spark, folder):
    parts = table(spark, folder, "part").selectExpr("p_partkey AS row_id", "p_name", "p_brand")
    roles = exchange.all_dynamic(parts)
    return shown_requests(exchange.build_requests(amplify(parts, 10), roles, kind="similar"))


_SQL_TAG = sql_fill(
    DEFAULT_PROMPTS["tag_cells"][1], {"text": "text", "columns": q(", ".join(PLAIN))}
)


_SQL_TAG_REQUESTS = f"""
    SELECT doc_id || ':1:' || md5('tag_cells' || chr(10) || {q(DEFAULT_PROMPTS['tag_cells'][0])} || chr(10) || {_SQL_TAG})
           || ':text' AS request_id, doc_id AS row_id, CAST(1 AS BIGINT) AS sample_no, 'text' AS "column",
           'tag_cells' AS kind, {q(DEFAULT_PROMPTS['tag_cells'][0])} AS system, {_SQL_TAG} AS user_prompt, text
    FROM documents
"""


@query(_SQL_TAG_REQUESTS)
def tag_requests(spark, folder):
    documents = table(spark, folder, "documents").withColumnRenamed("doc_id", "row_id")
    return shown_requests(exchange.tag_requests(documents, "text", PLAIN))


def mixed_responses(requests: DataFrame) -> DataFrame:
    """Responses as a model may give them: labelled, failed, blank, missing, twice."""
    luck = F.substring(F.md5("request_id"), 1, 1)
    content = (
        F.when(luck == "0", F.lit("Error: timed out"))
        .when(luck == "1", F.lit(' "" '))
        .otherwise(F.concat(F.lit('Generated content: "new '), F.col("text"), F.lit('" Note: reworded')))
    )
    first = requests.filter(luck != "2").select("request_id", content.alias("content"))
    again = requests.filter(luck == "3").select("request_id", F.lit("Error: busy").alias("content"))
    return first.unionByName(again)


_CLEANED = sql_clean("'new ' || text || '\" Note: reworded'", "question")

_SQL_JUDGED = f"""
    {_SQL_GENERATE},
    judged AS (SELECT *, left(md5(request_id), 1) AS luck FROM requests),
    cells AS (SELECT *, CASE luck WHEN '0' THEN 'error' WHEN '2' THEN 'missing'
                        WHEN '1' THEN CASE WHEN question THEN 'ok' ELSE 'empty' END ELSE 'ok' END AS status,
                     CASE WHEN luck = '1' THEN '?' ELSE {_CLEANED} END AS cell FROM judged)
"""


@query(
    f"""
    WITH {_SQL_JUDGED},
         wide AS (SELECT row_id, sample_no, max(cell) FILTER ("column" = 'input') AS input,
                         max(cell) FILTER ("column" = 'output') AS output
                  FROM cells GROUP BY ALL HAVING bool_and(status = 'ok'))
    SELECT w.row_id, w.sample_no, s.task, w.input, w.output, s.command
    FROM wide w JOIN samples s USING (row_id, sample_no)
    """
)
def apply_responses(spark, folder):
    samples = samples_of(spark, folder)
    responses = mixed_responses(exchange.build_requests(samples, ROLES))
    done = exchange.apply_responses(samples, responses, ROLES).rows
    return done.withColumn("sample_no", F.col("sample_no").cast("long"))


@query(
    f"""
    WITH {_SQL_JUDGED}
    SELECT request_id, row_id, sample_no, "column", status,
           CASE luck WHEN '0' THEN 'Error: timed out' WHEN '1' THEN ' "" ' END AS content
    FROM cells WHERE status <> 'ok'
    """
)
def rejected_cells(spark, folder):
    samples = samples_of(spark, folder)
    responses = mixed_responses(exchange.build_requests(samples, ROLES))
    rejects = exchange.apply_responses(samples, responses, ROLES).rejects
    return rejects.withColumn("sample_no", F.col("sample_no").cast("long"))


@query(
    f"""
    WITH {_SQL_GENERATE} SELECT request_id, 'Variant ' || sample_no || ': ' || text AS content FROM requests
    """
)
def generate_in_job(spark, folder):
    return exchange.generate(exchange.build_requests(samples_of(spark, folder), ROLES))


@query(
    f"""
    WITH {_SQL_SEEDS},
         variants AS (SELECT *, 'Variant ' || sample_no || ': ' AS lead FROM samples)
    SELECT row_id, sample_no, task, command,
           {sql_clean('lead || input', sql_question('input'))} AS input,
           {sql_clean('lead || output', sql_question('output'))} AS output
    FROM variants
    """
)
def generated_dataset(spark, folder):
    settings = generation.Generation(variants=2, roles=ROLES)
    done = generation.run(seed_rows(spark, folder), settings, exchange.restate).rows
    return done.withColumn("sample_no", F.col("sample_no").cast("long"))


@query(
    f"""
    WITH numbered AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id, text FROM conversations)
    SELECT k::BIGINT AS copy_no, row_id, '$("' || {sql_strip("'Variant ' || k || ': ' || text")} || '")' AS "value", false AS failed
    FROM numbered, range(1, 4) AS copies(k)
    """
)
def paraphrased_copies(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    cells = with_row_id(turns, ["conv_id", "turn"]).select("row_id", "text")
    asked = generation.paraphrase_requests(cells, "text", 3)
    copies = generation.paraphrased_copies(exchange.generate_to(asked), asked)
    return copies.withColumn("copy_no", F.col("copy_no").cast("long"))


_SQL_VERIFIED = ", ".join(
    _sql_verified(sql_strip(f"'Variant ' || sample_no || ': ' || {c} || '? '"), sql_question(c)) + f" AS {c}"
    for c in ("input", "output")
)


@query(f"WITH {_SQL_SEEDS} SELECT row_id, sample_no, task, {_SQL_VERIFIED}, command FROM samples")
def verify_applied(spark, folder):
    def repeated(requests):
        return exchange.restate(requests) + "? "

    done = generation.paraphrase_then_verify(samples_of(spark, folder), ROLES, exchange.restate, repeated)
    return done.rows.withColumn("sample_no", F.col("sample_no").cast("long"))


_FIELDS = {"quality": "zero or one", "toxic": "zero or one"}
_POINT = "md5('data_point' || chr(10) || {system} || chr(10) || {user})"


def _sql_point(name: str) -> str:
    system = q(DEFAULT_PROMPTS["data_point"][0])
    user = sql_fill(DEFAULT_PROMPTS["data_point"][1], {"column": q(name), "prompt": q(_FIELDS[name])})
    return _POINT.format(system=system, user=user)


@query(
    "WITH counted AS (SELECT count(*) AS n FROM labels), ids AS (SELECT unnest(range(n, 2 * n)) AS i FROM counted) "
    "SELECT CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels UNION ALL "
    "SELECT "
    + ", ".join(
        f"""CASE WHEN left(md5(i || ':1:' || {_sql_point(c)} || ':{c}'), 1) < '8' THEN '1' ELSE 'about one' END AS {c}"""
        for c in _FIELDS
    )
    + " FROM ids"
)
def fill_to_size(spark, folder):
    labels = table(spark, folder, "labels").select("quality", "toxic")
    asked = exchange.fill_to_size(spark, labels, 2 * labels.count(), _FIELDS)
    odd = F.substring(F.md5("request_id"), 1, 1) < "8"
    answers = asked.select("request_id", F.when(odd, "1").otherwise("about one").alias("content"))
    points = exchange.parsed_data_points(asked, answers)
    return exchange.filled_rows(labels, points, list(_FIELDS)).rows


@query(
    _sql_failing(
        "WITH counted AS (SELECT count(*) AS n FROM labels), ids AS (SELECT unnest(range(n, 2 * n)) AS i FROM counted) "
        + " UNION ALL ".join(
            f"""SELECT i || ':1:' || {_sql_point(c)} || ':{c}' AS request_id, i AS row_id, 1::BIGINT AS sample_no, '{c}' AS "column" FROM ids"""
            for c in _FIELDS
        )
    )
)
def rejected_points(spark, folder):
    labels = table(spark, folder, "labels").select("quality", "toxic")
    asked = exchange.fill_to_size(spark, labels, 2 * labels.count(), _FIELDS)
    points = exchange.parsed_data_points(asked, failing(asked, F.lit("1")))
    return shown_rejects(exchange.filled_rows(labels, points, list(_FIELDS)).rejects)


@query(_sql_failing(f"SELECT request_id, row_id, sample_no, \"column\" FROM ({_SQL_TAG_REQUESTS})"))
def rejected_documents(spark, folder):
    documents = table(spark, folder, "documents").withColumnRenamed("doc_id", "row_id")
    answers = failing(exchange.tag_requests(documents, "text", PLAIN), F.lit('$("x")'))
    return shown_rejects(parse_documents(documents, "text", PLAIN, mode="automatic", responses=answers).rejects)


_SQL_COPY_PROMPT = sql_fill(DEFAULT_PROMPTS["paraphrase"][1], {
    "text": "text", "original": "text", "reference_values": "'{}'", "reference": "'{}'",
    "is_question": f"CASE WHEN {sql_question('text')} THEN 'True' ELSE 'False' END", "column": "'text'",
})


@query(
    _sql_failing(
        f"""
        WITH numbered AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id, text FROM conversations),
             copies AS (SELECT row_id, unnest(range(1, 4)) AS sample_no,
                        md5('paraphrase' || chr(10) || {q(DEFAULT_PROMPTS["paraphrase"][0])} || chr(10) || {_SQL_COPY_PROMPT}) AS d
                        FROM numbered)
        SELECT row_id || ':' || sample_no || ':' || d || ':text' AS request_id, row_id, sample_no, 'text' AS "column" FROM copies
        """
    )
)
def rejected_copies(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    cells = with_row_id(turns, ["conv_id", "turn"]).select("row_id", "text")
    asked = generation.paraphrase_requests(cells, "text", 3)
    return shown_rejects(generation.judged_copies(failing(asked, F.lit("x")), asked).rejects)


# --- checks ---------------------------------------------------------------------------------


def tampered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    seeds = seed_rows(spark, folder)
    odd = F.length("input") % 7 == 0
    result = (
        amplify(seeds, 3)
        .withColumn("task", F.when(odd, F.upper("task")).otherwise(F.col("task")))
        .withColumn("output", F.when(F.col("sample_no") == 1, F.col("output")).otherwise(F.concat("output", F.lit("!"))))
    )
    return seeds, result


_SQL_TAMPERED = f"""
    {_SQL_SEEDS},
    tripled AS (SELECT *, unnest(range(1, 4)) AS k FROM seeds),
    result AS (SELECT row_id, CASE WHEN length(input) % 7 = 0 THEN upper(task) ELSE task END AS task, input,
                      CASE WHEN k = 1 THEN output ELSE output || '!' END AS output, command FROM tripled)
"""


def _sql_compared(columns: list[str], share: bool) -> str:
    extra = ", count(*) FILTER (r.{c} IS DISTINCT FROM s.{c}) / count(*) AS changed_share" if share else ""
    return " UNION ALL ".join(
        (
            f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER (r.{c} IS NOT DISTINCT FROM s.{c}) AS same_rows,
                       count(*) FILTER (r.{c} IS DISTINCT FROM s.{c}) AS changed_rows{extra}
                FROM result r JOIN seeds s USING (row_id)"""
        ).replace("{c}", c)
        for c in columns
    )


@query(f"WITH {_SQL_TAMPERED} {_sql_compared(['task', 'command'], False)}")
def invariance_check(spark, folder):
    return checks.invariance_report(*tampered(spark, folder), ROLES)


@query(f"WITH {_SQL_TAMPERED} {_sql_compared(['input', 'output'], True)}")
def change_ratio(spark, folder):
    return checks.change_report(*tampered(spark, folder), ROLES)


@query(
    """
    SELECT d.doc_id AS row_id, CAST(1 AS BIGINT) AS seeds, CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 4 END AS BIGINT) AS samples
    FROM documents d LEFT JOIN labels l USING (doc_id)
    """
)
def sample_counts(spark, folder):
    seeds = table(spark, folder, "documents").selectExpr("doc_id AS row_id")
    labelled = table(spark, folder, "labels").selectExpr("doc_id AS row_id")
    return checks.sample_counts(seeds, amplify(labelled, 4))


# --- refining -------------------------------------------------------------------------------------

_SQL_NORMAL = "lower(" + sql_strip(r"regexp_replace(text, '\s+', ' ', 'g')") + ")"
_SQL_DAMAGED = """
    damaged AS (SELECT doc_id AS row_id, CASE left(md5(CAST(doc_id AS VARCHAR)), 1)
        WHEN '0' THEN '  ' WHEN '1' THEN text || ' {text}' WHEN '2' THEN '$("' || text WHEN '3' THEN upper(lang) || '  x' ELSE text END AS text
        FROM documents)
"""


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as rows, some with what a careless run leaves behind."""
    luck = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
    text = (
        F.when(luck == "0", "  ")
        .when(luck == "1", F.concat("text", F.lit(" {text}")))
        .when(luck == "2", F.concat(F.lit('$("'), "text"))
        .when(luck == "3", F.concat(F.upper("lang"), F.lit("  x")))
        .otherwise(F.col("text"))
    )
    return table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), text.alias("text"))


@query(f"WITH {_SQL_DAMAGED} SELECT min(row_id) AS row_id FROM damaged GROUP BY {_SQL_NORMAL}")
def exact_dedup(spark, folder):
    return refine.exact_dedup(damaged(spark, folder), ["text"]).select("row_id")


_SQL_REFINED = f"""
    {_SQL_DAMAGED},
    faults AS (SELECT row_id, {_SQL_NORMAL} AS print, CASE WHEN {sql_strip('text')} = '' THEN 'empty'
        WHEN contains(text, '{{text}}') THEN 'placeholder' WHEN contains(text, '$("') THEN 'mark' END AS reason FROM damaged),
    judged AS (SELECT row_id, CASE WHEN reason IS NULL AND row_id > min(row_id) OVER (PARTITION BY print, reason)
        THEN 'duplicate' ELSE reason END AS reason FROM faults)
"""


@query(f"WITH {_SQL_REFINED} SELECT row_id, reason FROM judged WHERE reason IS NOT NULL")
def refine_rejects(spark, folder):
    return refine.refine(damaged(spark, folder), ["text"]).rejects


@query(f"WITH {_SQL_REFINED} SELECT row_id, text FROM damaged JOIN judged USING (row_id) WHERE reason IS NULL")
def refined_rows(spark, folder):
    return refine.refine(damaged(spark, folder), ["text"]).rows


@query("SELECT d.* FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic >= 1 OR quality < 1)")
def drop_flagged(spark, folder):
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return refine.drop_flagged(documents, labels, {"toxic": (">=", 1), "quality": ("<", 1)}, row_id="doc_id")


@query(
    f"""
    WITH {_SQL_SEEDS},
         drawn AS (SELECT row_id, sample_no, CAST('0x' || substr(md5('42|' || row_id), 1, 8) AS BIGINT) AS v FROM samples)
    SELECT row_id, sample_no, CASE WHEN v < 3435973836 THEN 'train' WHEN v < 3865470566 THEN 'eval' ELSE 'test' END AS split
    FROM drawn
    """
)
def split_by_seed(spark, folder):
    samples = samples_of(spark, folder).select("row_id", F.col("sample_no").cast("long").alias("sample_no"))
    return refine.split_by_seed(samples, {"train": 80, "eval": 10, "test": 10})


@query(
    f"""
    WITH {_SQL_SEEDS},
         cells AS (SELECT 'input' AS "column", contains(input, command) AS used FROM samples
                   UNION ALL SELECT 'output', contains(output, command) FROM samples)
    SELECT "column", count(*) AS rows, count(*) FILTER (used) AS used, count(*) FILTER (used) / count(*) AS rate
    FROM cells GROUP BY "column"
    """
)
def reference_use(spark, folder):
    return refine.reference_use(samples_of(spark, folder), ["input", "output"], ["command"]).rows


@query(
    """
    SELECT doc_id AS row_id, CASE WHEN quality = 0 THEN 'poor' ELSE lang END AS lang, source
    FROM documents LEFT JOIN labels USING (doc_id)
    """
)
def edits_saved(spark, folder):
    base = new_staging_path(spark, "zones")
    zones = Zones(base)
    documents = table(spark, folder, "documents").selectExpr("doc_id AS row_id", "lang", "source")
    documents.write.parquet(zones.path("ingredients", "set.parquet"))
    poor = table(spark, folder, "labels").filter("quality = 0")
    edits = poor.selectExpr("1 AS edit_no", "doc_id AS row_id", "'lang' AS column", "'poor' AS value")
    return spark.read.parquet(save_edits(spark, zones, "set.parquet", edits))


# --- rows and sets ------------------------------------------------------------------------------


@query(
    """
    WITH edits AS (SELECT doc_id, 'q' || quality AS lang, CASE WHEN quality = 1 THEN 'good' END AS source,
                          CAST(toxic AS VARCHAR) AS toxic FROM labels)
    SELECT d.doc_id AS row_id, coalesce(e.lang, d.lang) AS lang,
           CASE WHEN e.doc_id IS NULL THEN d.source ELSE e.source END AS source, d.n_chars, e.toxic
    FROM documents d LEFT JOIN edits e USING (doc_id)
    UNION ALL SELECT -1 - doc_id, NULL, 'added', 7 * doc_id, NULL FROM labels
    """
)
def cell_edits(spark, folder):
    documents = table(spark, folder, "documents").selectExpr("doc_id AS row_id", "lang", "source", "n_chars")

    def edit(no: int, row_id: str, column: str, value: str) -> Column:
        return F.expr(
            f"named_struct('edit_no', {no}, 'row_id', {row_id}, 'column', '{column}', 'value', CAST({value} AS STRING))"
        )

    edits = table(spark, folder, "labels").select(
        F.inline(
            F.array(
                edit(1, "doc_id", "lang", "'overwritten'"),
                edit(2, "doc_id", "lang", "concat('q', quality)"),
                edit(3, "doc_id", "source", "CASE WHEN quality = 1 THEN 'good' END"),
                edit(4, "doc_id", "toxic", "toxic"),
                edit(5, "-1 - doc_id", "source", "'added'"),
                edit(6, "-1 - doc_id", "n_chars", "7 * doc_id"),
            )
        )
    )
    return rows.apply_edits(documents, edits, columns=["lang", "source", "n_chars", "toxic"])


@query(
    """
    SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, text,
           (SELECT count(*) FROM documents) AS total_rows
    FROM documents ORDER BY doc_id LIMIT 25 OFFSET 75
    """
)
def page(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = rows.page_by_key(documents, "doc_id", 3, 25)
    return found.rows.withColumn("total_rows", F.lit(found.total_rows).cast("long"))


@query("SELECT doc_id, text, lang FROM documents ORDER BY doc_id LIMIT 100")
def preview(spark, folder):
    return rows.preview(table(spark, folder, "documents").select("doc_id", "text", "lang"), row_id="doc_id")


@query("SELECT doc_id, text, n_chars FROM documents")
def drop_columns(spark, folder):
    return rows.drop_columns(table(spark, folder, "documents"), ["source", "lang", "absent"]).rows


@query(
    """
    SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, CAST(NULL AS DOUBLE) AS quality, n_chars AS n FROM documents
    UNION ALL SELECT 'b' || item_id, text, NULL, NULL, CAST(item_id AS INTEGER) FROM benchmark
    UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, quality, NULL FROM labels
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, NULL, p_retailprice, p_size FROM part
    """
)
def combine_union(spark, folder):
    return combining.combine(
        [
            table(spark, folder, "documents").selectExpr("doc_id AS id", "text", "lang", "n_chars AS n"),
            table(spark, folder, "benchmark").selectExpr("concat('b', item_id) AS id", "text", "cast(item_id AS int) AS n"),
            table(spark, folder, "labels").selectExpr("doc_id AS id", "quality"),
            table(spark, folder, "part").selectExpr("p_partkey AS id", "p_retailprice AS quality", "p_size AS n"),
        ]
    )


@query(
    """
    SELECT doc_id, text, NULL::INTEGER AS quality, NULL AS skipped FROM documents
    UNION ALL SELECT doc_id, NULL, quality, NULL FROM labels
    UNION ALL SELECT doc_id, 'more', NULL, NULL FROM labels
    UNION ALL SELECT NULL, NULL, NULL, 'broken.parquet'
    """
)
def combine_directory(spark, folder):
    target = new_staging_path(spark, "folder")
    table(spark, folder, "documents").select("doc_id", "text").write.parquet(f"{target}/a.parquet")
    table(spark, folder, "labels").select("doc_id", "quality").write.parquet(f"{target}/b.parquet")
    labels = table(spark, folder, "labels")
    labels.select("doc_id", F.lit("more").alias("text")).write.parquet(f"{target}/c.parquet")
    labels.select(F.col("doc_id").cast("string")).write.text(f"{target}/broken.parquet")
    found = combining.combine_directory(spark, target)
    skipped = spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p, _ in found.skipped], "skipped string")
    return found.rows.unionByName(skipped, allowMissingColumns=True)


@query(
    """
    WITH texts AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS text_no FROM documents),
         lines AS (SELECT text_no, CASE WHEN text_no > 0 THEN [''] ELSE [] END || string_split(text, chr(10)) AS l
                   FROM texts)
    SELECT text_no, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM lines
    """
)
def combine_documents(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return combining.joined_lines(documents, "text", ["doc_id"])


@query(
    """
    SELECT CAST(0 AS BIGINT) AS text_no, unnest(string_split(text, chr(10))) AS line FROM documents
    UNION ALL SELECT 0, '' UNION ALL SELECT 0, ''
    UNION ALL SELECT 1, unnest(string_split(text, chr(10))) FROM benchmark
    UNION ALL SELECT 1, ''
    """
)
def combine_text_files(spark, folder):
    target = new_staging_path(spark, "texts")
    for name in ("documents", "benchmark"):
        table(spark, folder, name).select("text").write.text(f"{target}/{name}.txt")
    paths = [f"{target}/documents.txt", f"{target}/benchmark.txt"]
    return combining.combine_texts(spark, paths).select("text_no", "line")


# --- augment, profile, render ----------------------------------------------------------------------


def _sql_noise(column: str, row_id: str) -> str:
    digits = f"substr(md5('42|{column}|' || {row_id}), 1, 8)"
    unit = f"CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE"
    return f"CAST({column} AS DOUBLE) * (1 + (({unit}) * {2 * NOISE}::DOUBLE - {NOISE}::DOUBLE))"


@query(
    f"""
    SELECT doc_id, text || '{TEXT_SUFFIX}' AS text, lang || '{TEXT_SUFFIX}' AS lang,
           round({_sql_noise('n_chars', 'doc_id')}, 6) AS n_chars FROM documents
    """
)
def augment_documents(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    return augment(documents, row_id="doc_id").withColumn("n_chars", F.round("n_chars", 6))


@query(
    f"""
    SELECT p_partkey, p_name || '{TEXT_SUFFIX}' AS p_name, p_size,
           round({_sql_noise('p_retailprice', 'p_partkey')}, 6) AS p_retailprice FROM part
    """
)
def augment_numeric(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return augment(parts, row_id="p_partkey").withColumn("p_retailprice", F.round("p_retailprice", 6))


_PROFILED = ["doc_id", "text", "quality", "toxic"]


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS filled,
                   {"count(*) FILTER (quality IS DISTINCT FROM toxic)" if c == "quality" else "NULL::BIGINT"} AS changed
            FROM documents LEFT JOIN labels USING (doc_id)"""
        for c in _PROFILED
    )
)
def profile(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return profiling.column_stats(joined, _PROFILED, before={"quality": "toxic"})


@query('SELECT lang AS "generationModel", source AS task, count(*) AS rows FROM documents GROUP BY ALL')
def provenance(spark, folder):
    documents = table(spark, folder, "documents").selectExpr("lang AS generationModel", "source AS task")
    return profiling.provenance(documents)


_SQL_CHAT_PIECES = """
    turns AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no FROM conversations),
    pieces AS (SELECT conv_id, turn_no, '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text
               || CASE WHEN is_last AND role = 'assistant' THEN '' ELSE '<|eot_id|>' END
               || CASE WHEN is_last AND role = 'user'
                       THEN '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) ELSE '' END AS piece
               FROM turns)
"""


@query(f"WITH {_SQL_CHAT_PIECES} SELECT conv_id, turn_no, piece FROM pieces")
def render_chat(spark, folder):
    turns = table(spark, folder, "conversations")
    return rendering.render_turns(turns, "conv_id", "turn", "role", "text")


@query(f"WITH {_SQL_CHAT_PIECES} SELECT conv_id, string_agg(piece, '' ORDER BY turn_no) AS rendered FROM pieces GROUP BY conv_id")
def render_chat_rows(spark, folder):
    return rendering.render_conversations(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")


@query(
    """
    SELECT lang || '_' || source AS config_split, doc_id,
           '{' || chr(10) || '  "doc_id": ' || doc_id || ',' || chr(10) || '  "text": ' || to_json(text) || ','
           || chr(10) || '  "n_chars": ' || n_chars || chr(10) || '}' AS record
    FROM documents
    """
)
def serialize_splits(spark, folder):
    return rendering.split_records(table(spark, folder, "documents"), ["lang", "source"], keep=["doc_id"])


# --- files ---------------------------------------------------------------------------------------------

_SQL_WITH_NULLS = "SELECT doc_id, text, lang, quality FROM documents LEFT JOIN labels USING (doc_id)"


def documents_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return table(spark, folder, "documents").select("doc_id", "text", "lang").join(labels, "doc_id", "left")


@query(_SQL_WITH_NULLS)
def csv_export(spark, folder):
    stem = new_staging_path(spark, "export")
    writers.export(documents_with_nulls(spark, folder), stem, ["csv"])
    schema = "doc_id bigint, text string, lang string, quality int"
    return spark.read.csv(f"{stem}.csv", schema=schema, header=True, multiLine=True, escape='"')


@query(_SQL_WITH_NULLS)
def json_lines_export(spark, folder):
    stem = new_staging_path(spark, "export")
    writers.export(documents_with_nulls(spark, folder), stem, ["jsonl"])
    schema = "doc_id bigint, text string, lang string, quality int"
    return readers.read_json_records(spark, f"{stem}.jsonl", schema, lines=True)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, CAST(quality AS DOUBLE) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def parquet_cast(spark, folder):
    from pyspark.sql import types as T

    target = new_staging_path(spark, "cast")
    schema = T.StructType(
        [
            T.StructField("doc_id", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("quality", T.DoubleType()),
        ]
    )
    writers.write_parquet(documents_with_nulls(spark, folder), target, schema)
    return readers.read_parquet(spark, target)


@query(
    f"""
    WITH lines AS (SELECT doc_id || chr(9) || lang || chr(9) || regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') || chr(1) || 'end' AS l
                   FROM documents),
         cells AS (SELECT string_split({sql_strip('l')}, chr(9)) AS c FROM lines)
    SELECT c[1] AS doc_id, c[2] AS lang, c[3] AS text FROM cells
    """
)
def tab_separated(spark, folder):
    target = new_staging_path(spark, "tsv")
    flat = F.regexp_replace("text", r"[\t\r\n]", " ")
    documents = table(spark, folder, "documents")
    cells = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.concat(flat, F.lit("\x01end")).alias("text"))
    # Each part file is a table of its own, so each gets the header line.
    cells.write.csv(target, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_tab_separated(spark, target)


@query(
    f"SELECT {sql_strip('CAST(conv_id AS VARCHAR)')} AS conv_id, {sql_strip('role')} AS role, {sql_strip('text')} AS text FROM conversations"
)
def tagged_files(spark, folder):
    target = new_staging_path(spark, "tagged")
    turns = table(spark, folder, "conversations").withColumn("id", F.col("conv_id"))
    writers.write_tagged(turns, target, order_by=["id", "turn"], columns=["conv_id", "role", "text"])
    return parsing.parse_tagged_files(spark, target, ["conv_id", "role", "text"]).drop("file", "row_no")


@query("SELECT doc_id, replace(text, chr(13), '') AS content FROM documents")
def text_documents(spark, folder):
    target = new_staging_path(spark, "documents")
    marked = F.concat(F.col("doc_id"), F.lit("\n"), "text")
    # Each document ends its record with a mark of its own. A file is read as one row, so each holds some hundred documents.
    lines = table(spark, folder, "documents").select(marked.alias("value"))
    lines.write.option("maxRecordsPerFile", _RECORDS).text(target, lineSep=_RECORD_END)
    found = readers.read_documents(spark, target)
    records = found.select(F.explode(F.split("content", _RECORD_END)).alias("r")).filter("r <> ''")
    at = F.locate("\n", F.col("r"))
    return records.select(
        F.substring("r", F.lit(1), at - 1).cast("long").alias("doc_id"), F.substring("r", at + 1, F.length("r")).alias("content")
    )


_RECORD_END = "\x1e"
_RECORDS = 250


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang FROM documents")
def json_array(spark, folder):
    target = new_staging_path(spark, "array")
    record = F.to_json(F.struct("doc_id", "text", "lang"), {"ignoreNullFields": "false"})
    block = F.call_function("div", F.col("doc_id"), F.lit(1000)).alias("block")
    lists = table(spark, folder, "documents").select(block, record.alias("j"))
    # An array file cannot be split, so each holds a thousand records.
    joined = F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]"))
    lists.groupBy("block").agg(joined.alias("value")).write.partitionBy("block").text(target)
    found = readers.read_json_records(spark, target, "doc_id bigint, text string, lang string")
    return found.select("doc_id", "text", "lang")


@query(
    f"SELECT {sql_strip('CAST(conv_id AS VARCHAR)')} AS conv_id, {sql_strip('role')} AS role, {sql_strip('text')} AS text FROM conversations"
)
def converted_files(spark, folder):
    target, stem = new_staging_path(spark, "tagged"), new_staging_path(spark, "converted")
    turns = table(spark, folder, "conversations").withColumn("id", F.col("conv_id"))
    fields = ["conv_id", "role", "text"]
    writers.write_tagged(turns, target, order_by=["id", "turn"], columns=fields)
    convert_tagged_files(spark, target, fields, stem)
    schema = "conv_id string, role string, text string"
    return readers.read_json_records(spark, f"{stem}.json", schema, lines=True)


@query(
    """
    SELECT lang || '_' || source AS config_split, doc_id,
           '{' || chr(10) || '  "doc_id": ' || doc_id || ',' || chr(10) || '  "n_chars": ' || n_chars || chr(10) || '}' AS record
    FROM documents
    """
)
def splits_written(spark, folder):
    target = new_staging_path(spark, "splits")
    documents = table(spark, folder, "documents").drop("text")
    records = rendering.split_records(documents, ["lang", "source"], keep=["doc_id"])
    rendering.write_splits(records, target, ["doc_id"])
    found = spark.read.option("lineSep", "\n\n").text(target)
    doc_id = F.regexp_extract("value", r'"doc_id": (\d+)', 1).cast("long")
    return found.filter("value <> ''").select("config_split", doc_id.alias("doc_id"), F.col("value").alias("record"))
