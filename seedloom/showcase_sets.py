"""More queries over the given tables: whole sets of rows against each other, catalogs, pages, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedloom.operators import catalog, exchange, pages, patterns, refine, shingles
from seedloom.prompts import PromptSet
from seedloom.showcase import ORACLES, ROLES, query, samples_of, shown_requests, sql_strip, table
from seedloom.sources import json_arrays, readers, writers, zones
from seedloom.sources.staging import new_staging_path

# --- near copies and overlap -------------------------------------------------

_SQL_SHINGLES = rf"""
    split_words AS (SELECT doc_id, list_filter(string_split_regex(lower({sql_strip("coalesce(text, '')")}), '\s+'), lambda w: w <> '') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split_words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id)
"""
_SQL_GROUPS = f"""
    {_SQL_SHINGLES},
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    near AS (SELECT a, b FROM met JOIN sizes na ON na.doc_id = a JOIN sizes nb ON nb.doc_id = b WHERE c / (na.n + nb.n - c) >= 0.8),
    reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM reached JOIN near ON a = y),
    grouped AS (SELECT doc_id, CASE WHEN n IS NULL THEN min(doc_id) OVER (PARTITION BY n IS NULL) ELSE group_id END AS group_id
        FROM (SELECT x AS doc_id, min(y) AS group_id FROM reached GROUP BY x) LEFT JOIN sizes USING (doc_id))
"""


@query(f"WITH RECURSIVE {_SQL_GROUPS} SELECT doc_id, group_id FROM grouped")
def near_duplicates(spark, folder):
    return shingles.near_groups(table(spark, folder, "documents"), "text", row_id="doc_id")


def _sql_split(key: str, seed: int = 42) -> str:
    drawn = f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT)"
    return f"CASE WHEN {drawn} < 3435973836 THEN 'train' WHEN {drawn} < 3865470566 THEN 'eval' ELSE 'test' END"


_SHARES = {"train": 80, "eval": 10, "test": 10}


@query(f"WITH RECURSIVE {_SQL_GROUPS} SELECT doc_id, group_id, {_sql_split('group_id')} AS split FROM grouped")
def group_safe_split(spark, folder):
    return shingles.split_by_group(table(spark, folder, "documents"), "text", _SHARES, row_id="doc_id")


@query(
    f"""
    WITH {_SQL_SHINGLES},
         parts AS (SELECT doc_id, {_sql_split("doc_id")} AS split FROM documents),
         met AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS c, any_value(n) AS n
                 FROM shingles a JOIN parts p ON p.doc_id = a.doc_id AND p.split = 'eval' JOIN sizes z ON z.doc_id = a.doc_id
                 JOIN shingles b USING (s) JOIN parts o ON o.doc_id = b.doc_id AND o.split = 'train' GROUP BY ALL),
         reach AS (SELECT * FROM met WHERE c >= ceil(n * 0.8 - 1e-9)),
         best AS (SELECT doc_id, max(c) / any_value(n) AS overlap, count(*) AS n_matches, arg_min(other, (-c, other)) AS match_id FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, overlap, coalesce(n_matches, 0) AS n_matches, match_id
    FROM parts LEFT JOIN sizes USING (doc_id) LEFT JOIN best USING (doc_id) WHERE split = 'eval'
    """
)
def train_eval_overlap(spark, folder):
    split = refine.split_by_seed(table(spark, folder, "documents"), _SHARES, row_id="doc_id")
    train, held = (split.filter(F.col("split") == s) for s in ("train", "eval"))
    return shingles.overlap(held, train, "text", row_id="doc_id")


# --- phrases that speak against a row -----------------------------------------

_SQL_PHRASES = r"""
    listed AS (SELECT d.doc_id, toxic, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
        FROM documents d LEFT JOIN labels USING (doc_id)),
    runs AS (SELECT DISTINCT doc_id, toxic, array_to_string(w[i:i + 1], ' ') AS phrase
        FROM (SELECT doc_id, toxic, w, unnest(range(1, len(w))) AS i FROM listed)),
    phrases AS (SELECT phrase FROM runs WHERE toxic IS NOT NULL GROUP BY phrase HAVING count(*) FILTER (toxic = 1) >= 2 AND count(*) FILTER (toxic <> 1) = 0)
"""


@query(f"WITH {_SQL_PHRASES} SELECT doc_id, count(*) AS n_phrases, 'toxic' AS reasons FROM runs JOIN phrases USING (phrase) GROUP BY doc_id")
def malicious_rows(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labelled = documents.join(table(spark, folder, "labels"), "doc_id")
    phrases = patterns.telling_phrases(labelled, "text", F.col("toxic") == 1)
    found = patterns.match_phrases(documents, "text", phrases, row_id="doc_id")
    return found.withColumn("reasons", F.array_join("reasons", ","))


# --- catalogs and command blocks ------------------------------------------------

_SQL_CATALOG = """
    named AS (SELECT p_partkey, replace(p_name, ' ', '.') AS command, p_name, p_type, p_size FROM part),
    catalog AS (SELECT command, 'Orders a ' || any_value(p_name) || ' in one of ' || count(DISTINCT p_type) || ' kinds.' AS description FROM named GROUP BY command),
    choices AS (SELECT DISTINCT command, 'type' AS parameter, p_type AS value FROM named)
"""
_DESCRIBE = [
    catalog.Phrasing("What does the {command} command do?", "{description}"),
    catalog.Phrasing("How do I use {command}?", "{command}: {description}"),
]
_ASKED = ["Please get me {value} by {command}.", "{command}, and I want {value}"]


def _named(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("command"), "p_name", "p_type", "p_size")


def _catalog(spark, folder):
    """A catalog made of the parts: their names as commands, with a type to choose and a size."""
    named = _named(spark, folder)
    kinds = F.count_distinct("p_type").cast("string")
    described = F.concat(F.lit("Orders a "), F.any_value("p_name"), F.lit(" in one of "), kinds, F.lit(" kinds."))
    listed = named.groupBy("command").agg(described.alias("description"))
    parameters = listed.select("command", F.inline(F.array(*[F.struct(F.lit(p).alias("parameter"), F.lit(k).alias("kind")) for p, k in (("type", "choice"), ("size", "integer"))])))
    choices = named.select("command", F.lit("type").alias("parameter"), F.col("p_type").alias("value")).distinct()
    return listed, parameters, choices


@query(
    f"""
    WITH {_SQL_CATALOG}
    SELECT command, 'describe' AS task, 0 AS phrasing, 'What does the ' || command || ' command do?' AS input, description AS output FROM catalog
    UNION ALL SELECT command, 'describe', 1, 'How do I use ' || command || '?', command || ': ' || description FROM catalog
    UNION ALL SELECT command, 'intent', n, CASE n WHEN 0 THEN 'Please get me ' || value || ' by ' || command || '.' ELSE command || ', and I want ' || value END,
        '<runCommand>' || chr(10) || '{{"command":"' || command || '","arguments":{{"type":"' || value || '"}}}}' || chr(10) || '</runCommand>'
        FROM choices, range(2) t(n)
    """
)
def expanded_catalog(spark, folder):
    listed, _, choices = _catalog(spark, folder)
    return catalog.describe(listed, _DESCRIBE).unionByName(catalog.intents(choices, _ASKED))


@query(
    f"""
    WITH {_SQL_CATALOG}
    SELECT n // 10 AS part, string_agg(command, chr(10) ORDER BY n) AS text
    FROM (SELECT command, row_number() OVER (ORDER BY command) - 1 AS n FROM catalog) GROUP BY part
    """
)
def catalog_listing(spark, folder):
    return catalog.listing(_catalog(spark, folder)[0], per_part=10)


@query(
    f"""
    WITH {_SQL_CATALOG}, asked AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/' || upper(command) ELSE coalesce(command, lang || '.' || source) END AS command
        FROM documents LEFT JOIN named ON p_partkey = doc_id)
    SELECT doc_id, command, valid, CASE WHEN valid THEN 'Yes, ' || command || ' is a command.' ELSE 'No, ' || coalesce(command, '') || ' is no command.' END AS answer
    FROM (SELECT *, coalesce(lower(ltrim(command, '/')) IN (SELECT command FROM catalog), false) AS valid FROM asked)
    """
)
def catalog_validity(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source")
    names = _named(spark, folder).select(F.col("p_partkey").alias("doc_id"), "command")
    other = F.coalesce("command", F.concat("lang", F.lit("."), "source"))
    shown = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), F.upper("command"))).otherwise(other)
    asked = documents.join(names, "doc_id", "left").select("doc_id", shown.alias("command"))
    return catalog.validity(asked, _catalog(spark, folder)[0], "Yes, {command} is a command.", "No, {command} is no command.")


_SQL_BLOCKS = f"""
    {_SQL_CATALOG},
    told AS (SELECT p_partkey AS row_id, p_partkey % 8 AS luck, CASE WHEN p_partkey % 8 = 1 THEN 'no.' || command ELSE command END AS command,
        CASE WHEN p_partkey % 8 = 2 THEN 'PLAIN' ELSE p_type END AS kind, CASE WHEN p_partkey % 8 = 3 THEN 'large' ELSE CAST(p_size AS VARCHAR) END AS size FROM named)
"""


def _told(spark, folder):
    """A text with a command block for every part, some with faults."""
    luck = F.col("p_partkey") % 8
    command = F.when(luck == 1, F.concat(F.lit("no."), "command")).otherwise(F.col("command"))
    kind = F.when(luck == 2, "PLAIN").otherwise(F.col("p_type"))
    size = F.when(luck == 3, "large").otherwise(F.col("p_size").cast("string"))
    pairs = F.array(F.struct(F.lit("type"), kind), F.struct(F.lit("size"), size))
    pairs = F.when(luck == 4, F.concat(pairs, F.array(F.struct(F.lit("colour"), F.lit("red"))))).otherwise(pairs)
    block = catalog.command_block(command, F.map_from_entries(pairs))
    block = F.when(luck == 5, F.replace(block, F.lit("arguments"), F.lit('arguments"'))).otherwise(block)
    block = F.when(luck == 6, F.replace(block, F.lit(catalog.BLOCK_CLOSE), F.lit(""))).otherwise(block)
    text = F.concat(F.lit("Sure.\n"), F.when(luck == 7, F.concat(block, F.lit(" and "), block)).otherwise(block))
    return _named(spark, folder).select(F.col("p_partkey").alias("row_id"), text.alias("text"))


def _blocks(spark, folder):
    return catalog.command_blocks(_told(spark, folder), "text", *_catalog(spark, folder))


@query(
    f"""
    WITH {_SQL_BLOCKS}
    SELECT row_id, CAST(n AS INTEGER) AS block, command, kind AS type, size FROM told, range(2) t(n)
    WHERE luck IN (0, 7) AND (n = 0 OR luck = 7) AND (command, kind) IN (SELECT (command, value) FROM choices)
    """
)
def command_blocks(spark, folder):
    rows = _blocks(spark, folder).rows
    return rows.select("row_id", "block", "command", F.col("arguments")["type"].alias("type"), F.col("arguments")["size"].alias("size"))


@query(
    f"""
    WITH {_SQL_BLOCKS}
    SELECT row_id, 0 AS block, NULL AS parameter, CASE luck WHEN 1 THEN 'unknown command' ELSE 'not json' END AS reason FROM told WHERE luck IN (1, 5)
    UNION ALL SELECT row_id, NULL, NULL, 'unclosed' FROM told WHERE luck = 6
    UNION ALL SELECT row_id, 0, 'type', 'not a choice' FROM told
        WHERE luck = 2 AND (command, kind) NOT IN (SELECT (command, value) FROM choices)
    UNION ALL SELECT row_id, 0, 'size', 'not an integer' FROM told WHERE luck = 3
    UNION ALL SELECT row_id, 0, 'colour', 'unknown parameter' FROM told WHERE luck = 4
    """
)
def command_block_rejects(spark, folder):
    return _blocks(spark, folder).rejects


# --- pages and arrays -------------------------------------------------------------

_SQL_BREAK = "(?i)</?(?:" + "|".join(pages.BLOCKS) + r")(?:[\s/][^>]*)?>"


def _sql_plain(x: str) -> str:
    said = rf"regexp_replace({x}, '</?[A-Za-z!?][^>]*>', '', 'g')"
    for name, sign in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        said = f"replace({said}, '&{name};', '{sign}')"
    return rf"trim(regexp_replace({said}, '[\s ]+', ' ', 'g'))"


def _sql_quiet(x: str) -> str:
    said = rf"regexp_replace({x}, '(?s)<!--.*?(?:-->|\z)', '', 'g')"
    for name in pages.SILENT:
        said = rf"regexp_replace({said}, '(?is)<{name}(?:[\s/][^>]*)?>.*?(?:</{name}\s*>|\z)', ' ', 'g')"
    return said


@query(
    rf"""
    WITH pieces AS (SELECT page_id, url, generate_subscripts(l, 1) AS n, unnest(l) AS piece
            FROM (SELECT page_id, url, string_split_regex({_sql_quiet("html")}, '{_SQL_BREAK}') AS l FROM pages)),
         lines AS (SELECT page_id, n, {_sql_plain("piece")} AS line,
             {_sql_plain(r"array_to_string(regexp_extract_all(piece, '(?is)<a(?:\s[^>]*)?>(.*?)(?:</a\s*>|\z)', 1), '')")} AS linked FROM pieces),
         texts AS (SELECT page_id, string_agg(line, chr(10) ORDER BY n) AS content FROM lines WHERE line <> '' AND length(linked) <= 0.5 * length(line) GROUP BY page_id)
    SELECT page_id, url, coalesce(content, '') AS content FROM pages LEFT JOIN texts USING (page_id)
    """
)
def page_text(spark, folder):
    return pages.page_text(table(spark, folder, "pages")).drop("html")


@query("SELECT doc_id, text, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def json_array_parts(spark, folder):
    """A dataset written as one array in ordered parts, and read back by its quotation marks."""
    target = new_staging_path(spark, "array.json")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    rows = table(spark, folder, "documents").select("doc_id", "text", "lang").join(labels, "doc_id", "left")
    writers.write_json_array(rows.withColumn("place", F.col("doc_id")), target, order_by=["place"])
    return json_arrays.read_json_array(spark, target, "doc_id bigint, text string, lang string, quality int", parts=True)


# --- formats and stored settings ---------------------------------------------------


@query(ORACLES["tab_separated"])
def format_fallback(spark, folder):
    """A dataset asked for as Parquet that only its text sibling holds."""
    stem = new_staging_path(spark, "fallback")
    flat = F.regexp_replace("text", r"[\t\r\n]", " ")
    cells = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.concat(flat, F.lit("\x01end")).alias("text"))
    cells.write.csv(f"{stem}.txt", sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_any(spark, f"{stem}.parquet")


@query(ORACLES["build_requests"])
def stored_prompts(spark, folder):
    """Requests from a prompt set that was saved by name and read back."""
    settings = new_staging_path(spark, "prompt-sets")
    PromptSet().save(spark, settings, "ours")
    PromptSet("other system", {"input": {"user": "no"}}).save(spark, settings, "theirs")
    return shown_requests(exchange.build_requests(samples_of(spark, folder), ROLES, PromptSet.load(spark, settings, "ours")))


@query(
    """
    WITH kept AS (SELECT lang, doc_id, text FROM documents UNION ALL SELECT 'all', item_id, text FROM benchmark)
    SELECT lang || '_synthetic_7.parquet' AS dataset, count(*) AS rows FROM kept GROUP BY lang
    """
)
def seed_list(spark, folder):
    """Datasets of a zone under derived names, listed as seeds and counted."""
    zone = new_staging_path(spark, "zone")
    documents = table(spark, folder, "documents").select("lang", "doc_id", "text")
    items = table(spark, folder, "benchmark").select(F.lit("all").alias("lang"), F.col("item_id").alias("doc_id"), "text")
    kept = documents.unionByName(items)
    # A handful of languages, each a dataset of its own.
    for lang in sorted(r.lang for r in kept.select("lang").distinct().collect()):
        writers.write_parquet(kept.filter(F.col("lang") == lang), f"{zone}/{zones.synthetic_name(lang, 7)}")
    writers.write_lines(items, f"{zone}/notes.txt", "text", ["doc_id"])
    names = readers.list_seeds(spark, zone).select("dataset")
    found = spark.read.option("recursiveFileLookup", True).parquet(*readers.dataset_files(spark, zone, [".parquet"]))
    source = F.regexp_extract(F.input_file_name(), r"/([^/]+\.parquet)/[^/]+$", 1)
    counted = found.select(source.alias("dataset")).groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))
    return names.join(counted, "dataset")
