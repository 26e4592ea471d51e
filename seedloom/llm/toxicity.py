"""Toxicity by boosted trees over dense features, calibrated by isotonic regression.

The words that labelled toxic texts use far more than others form the lexicon,
beside a short list of insults. Features are what a text has of them, how near
they stand to a second person, and how it shouts, punctuates and disguises.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.llm import boosting
from seedloom.llm.common import ascii_lower, few_rows
from seedloom.sources.staging import stage

# Words known beforehand, for tables with few labels.
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "pathetic", "worthless", "disgusting", "loser",
    "scum", "trash", "garbage", "clown", "fool", "imbecile", "hate", "ugly", "freak",
)
SECOND_PERSON = frozenset(
    ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "ihr", "euch",
     "tu", "te", "toi", "ton", "ta", "vous", "votre", "ti", "tus", "usted", "ustedes", "vosotros"]
)
_LEET = str.maketrans("013457@$!|", "oieastasil", "._-~'")
_TOKEN = re.compile(r"[^\W_]+")
_DISGUISED = re.compile(r"(?<!\S)\S{0,20}[A-Za-z][0-9@$!|*._~-]{1,3}[A-Za-z]\S{0,20}")
_NEAR = 5
# Up to so many labelled texts their keys (24 MB) are broadcast.
FEW_LABELS = 1_000_000
N_FEATURES = 12


class Settings(NamedTuple):
    """``sample`` bounds the labelled rows that the trees are fitted on, ``words`` the lexicon they look words up in.

    A word is learned if twice the log likelihood ratio of its toxic documents
    is at least ``least_evidence``; chance gives no word that much among some
    ten thousand.
    """

    sample: int = 20_000
    words: int = 20_000
    least_documents: int = 3
    least_log_odds: float = 1.5
    least_evidence: float = 20.0
    rounds: int = 20
    depth: int = 3


SETTINGS = Settings()


def _disguised(text: str, lexicon: Mapping[str, float]) -> int:
    """Tokens that spell a lexicon word with digits, signs or stars in it."""
    count = 0
    for token in _DISGUISED.findall(text):
        plain = token.lower().strip(".,;:!?\"'()[]")
        if plain in lexicon or plain.isalpha():
            continue
        word = plain.translate(_LEET)
        if "*" in word:
            pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in word))
            # A word of stars alone spells nothing.
            known = sum(c.isalpha() for c in word) >= 3 and any(pattern.fullmatch(w) for w in lexicon)
        else:
            known = word in lexicon
        count += known
    return count


def features(text: str | None, lexicon: Mapping[str, float]) -> list[float]:
    """Densities per 100 words or characters, and a few counts; an empty text has zeros."""
    text = text or ""
    words = _TOKEN.findall(text.lower())
    n, chars = len(words), max(1, len(text))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        ahead = np.array([*you, 1 << 40])[at] - hits
        behind = hits - np.array([-(1 << 40), *you])[at]
        near = int(((ahead <= _NEAR) | (behind <= _NEAR)).sum())
    weights = [lexicon[words[i]] for i in hits]
    disguised = _disguised(text, lexicon)
    per = 100.0 / max(1, n)
    return [
        len(hits) * per,
        math.log1p(len(hits)),
        max(weights, default=0.0),
        float(len({words[i] for i in hits})),
        sum(weights) * per,
        near * per,
        len(you) * per,
        100.0 * sum(map(str.isupper, text)) / chars,
        100.0 * (text.count("!") + text.count("?")) / chars,
        disguised * per,
        float(disguised),
        math.log1p(n),
    ]


def with_features(df: DataFrame, lexicon: Mapping[str, float], name: str = "features") -> DataFrame:
    """Add the features of ``text``; the words of the lexicon travel with the function."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t, lexicon) for t in batch], dtype="object")

    return df.withColumn(name, of(F.col("text")))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must stay unseen; a null id counts as an empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, h, label``: one row for each different labelled text that is not held out.

    Of several labels of a document, or of copies, the highest counts; rows with
    a null id or label are passed over. ``h`` tells texts of one id apart.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    text = F.coalesce("text", F.lit(""))
    prints = documents.select("doc_id", F.xxhash64(text).alias("h"), F.md5(text).alias("print"))
    first = F.min(F.struct("doc_id", "h")).alias("k")
    return prints.join(one, "doc_id").groupBy("print").agg(first, F.max("label").alias("label")).select("k.*", "label")


def learn_lexicon(documents: DataFrame, known: DataFrame, settings: Settings = SETTINGS) -> dict[str, float]:
    """Words with their log odds between toxic and other documents, counted over all labelled texts."""
    totals = known.groupBy("label").count().collect()
    n = {r.label: r["count"] for r in totals}
    lexicon = dict.fromkeys(INSULTS, 1.0)
    if set(n) != {0, 1}:
        return lexicon
    if few_rows(known, FEW_LABELS):
        known = F.broadcast(known)
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")).join(known, ["doc_id", "h"])
    words = F.array_distinct(F.split(ascii_lower(F.col("text")), r"[^\p{L}\p{N}]+"))
    seen = rows.select("label", F.explode(words).alias("word")).filter("word <> ''")
    counted = seen.groupBy("word").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("all"))
    bad = (F.col("bad") + 0.5) / (n[1] + 1.0)
    good = (F.col("all") - F.col("bad") + 0.5) / (n[0] + 1.0)
    scored = counted.withColumn("odds", F.log(bad / good))
    telling = scored.filter((F.col("bad") >= settings.least_documents) & (F.col("odds") >= settings.least_log_odds))
    share = n[1] / (n[0] + n[1])
    evidence = 2 * F.col("bad") * F.log(F.col("bad") / (F.col("all") * share))
    # The most telling words are the model's; their number is a parameter.
    strong = telling.filter(evidence >= settings.least_evidence).orderBy(F.desc("odds"), "word").limit(settings.words)
    for r in strong.collect():
        lexicon[r.word] = max(lexicon.get(r.word, 0.0), float(r.odds))
    return lexicon


_BINS = 2000


def score(documents: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Word counts and calibration take all labelled texts that are not held out,
    as counts in Spark; the trees alone a bounded sample. The score is the
    calibrated probability, of which two hundredths are the trees' own, so that
    texts on one calibration step keep their order. Where labels of one kind
    only are known, the lexicon's density makes the score. Null text counts as
    empty; repeated rows stay.
    """
    known = stage(training_rows(documents, labels), "labelled")
    lexicon = learn_lexicon(documents, known, settings)
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", "text", F.xxhash64(text).alias("h"))
    # Features of every text once, for learning and for scores.
    dense = stage(with_features(rows, lexicon).drop("text"), "dense")
    # Repeated rows of one id and text are one text here.
    learned = stage(dense.join(known, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]), "learned")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    sample = boosting.bounded_sample(learned.filter(~fold), F.struct("doc_id", "h"), settings.sample)
    boosted = boosting.fit(sample, rounds=settings.rounds, depth=settings.depth, step=0.2)
    rows = dense.drop("h")
    if boosted is None:
        made = rows.withColumn("score", 1 - F.exp(-F.col("features")[0]))
    else:
        raw = boosted.score(F.col("features"))
        unseen = learned.join(sample.select("doc_id", "h"), ["doc_id", "h"], "left_anti")
        binned = unseen.select(F.round(raw * _BINS).alias("bin"), F.col("label").cast("double").alias("label"))
        # At most so many rows, with the share of toxic texts and their number.
        bins = binned.groupBy("bin").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("n"))
        bins = stage(bins.select((F.col("bin") / _BINS).alias("raw"), "label", "n"), "score-bins")
        made = rows.withColumn("raw", raw)
        if bins.isEmpty():
            made = made.withColumn("score", F.col("raw"))
        else:
            isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="n", predictionCol="calibrated")
            made = isotonic.fit(bins).transform(made)
            made = made.withColumn("score", 0.98 * F.col("calibrated") + 0.02 * F.col("raw"))
    sure = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    made = made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), sure.alias("score"))
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
