"""Removal of byte strings that occur twice, by prefix doubling over anchors.

A string of 400 bytes that repeats holds, at the same place, the same anchor:
the 32-byte string in it with the smallest name. Inside a task, names double
from 8 to 32 and on to 400 bytes; a name is what a rank is in a suffix array,
but equal strings get it anywhere, so Spark has to bring together only
positions whose uniqueness is still open, at growing lengths:

1. one row per run of windows with one anchor, by the name of the anchor and a
   digest of all bytes under the run: runs that repeat whole are settled, runs
   whose anchor is alone are unique and leave;
2. of the rest one run per different content, window by window, at 400 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.llm.anchors import anchor_runs, string_names
from seedloom.sources.staging import stage

LENGTH = 400
# Contents around one anchor that one task compares by itself, at about 600
# bytes each; windows of more are counted as rows.
TOGETHER = 20_000

_RUN = "id long, salt long, low int, high int, gram long, hull long"
_PIECE = "gram long, single boolean, id long, salt long, low int, bytes binary"
_SPAN = "id long, salt long, low int, high int"
_DONE = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


# Rows of a batch that a task works on at once, so that its arrays stay small.
_ROWS = 1000


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            yield batch[at : at + _ROWS]


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _runs(documents: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            ids, salts = batch["id"].to_numpy(), batch["salt"].to_numpy()
            texts = [_encoded(t) for t in batch["text"]]
            for row, low, high, _, gram, hull in anchor_runs(texts, length):
                yield pd.DataFrame(
                    {"id": ids[row], "salt": salts[row], "low": low, "high": high, "gram": gram, "hull": hull}
                )

    return documents.select("id", "salt", "text").mapInPandas(run, _RUN)


def _cut(joined: DataFrame, length: int) -> DataFrame:
    """The bytes under each asked run of a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            rows = []
            for i, salt, text, asked in batch.itertuples(index=False, name=None):
                data = _encoded(text)
                rows += [
                    (a["gram"], a["single"], i, salt, a["low"], data[a["low"] : a["high"] + length]) for a in asked
                ]
            yield pd.DataFrame(rows, columns=["gram", "single", "id", "salt", "low", "bytes"])

    return joined.select("id", "salt", "text", "asked").mapInPandas(run, _PIECE)


def _windows(pieces: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each piece its row, its offset there and its name."""
    sizes = pieces["bytes"].map(len).to_numpy(np.int64)
    names = string_names(np.frombuffer(b"".join(pieces["bytes"]), np.uint8), length)
    ends = np.cumsum(sizes)
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, offset, names[np.repeat(ends - sizes, counts) + offset]


def _stretches(pieces: pd.DataFrame, row: np.ndarray, offset: np.ndarray) -> pd.DataFrame:
    """Window starts, in order, as ranges of neighbours in one piece."""
    if not len(row):
        return pd.DataFrame({"id": [], "salt": [], "low": [], "high": []}).astype("int64")
    new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(offset) != 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1
    piece = pieces.iloc[row[first]]
    base = piece["low"].to_numpy()
    return pd.DataFrame(
        {"id": piece["id"].to_numpy(), "salt": piece["salt"].to_numpy(), "low": base + offset[first], "high": base + offset[last]}
    )


def _compared(pieces: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeated windows of single pieces; equal grams are all among ``pieces``."""
    row, offset, names = _windows(pieces, length)
    gram = pieces["gram"].to_numpy()[row]
    order = np.lexsort((names, gram))
    g, n = gram[order], names[order]
    same = (g[1:] == g[:-1]) & (n[1:] == n[:-1])
    repeated = np.zeros(len(row), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    repeated &= pieces["single"].to_numpy(bool)[row]
    return _stretches(pieces, row[repeated], offset[repeated])


def _refined(pieces: DataFrame, length: int) -> DataFrame:
    """Windows compared gram by gram, as the sorted rows stream through a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in _slices(batches):
            last = batch["gram"].iloc[-1]
            done = batch["gram"] != last
            if done.any():
                yield _compared(pd.concat([*held, batch[done]], ignore_index=True), length)
                held = []
            held.append(batch[~done])
        if held:
            yield _compared(pd.concat(held, ignore_index=True), length)

    return pieces.repartition("gram").sortWithinPartitions("gram").mapInPandas(run, _SPAN)


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """The same for grams with too many contents for one task: a row per window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            row, offset, names = _windows(batch, length)
            piece = batch.iloc[row]
            at = piece["low"].to_numpy() + offset
            frame = piece[["gram", "single", "id", "salt"]].reset_index(drop=True)
            yield frame.assign(name=names.view(np.int64), low=at)[["gram", "name", "single", "id", "salt", "low"]]

    rows = pieces.mapInPandas(run, "gram long, name long, single boolean, id long, salt long, low int")
    # Used twice, but made from the one shuffle of the texts.
    twice = rows.groupBy("gram", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = rows.filter("single").join(twice, ["gram", "name"], "left_semi")
    return found.select("id", "salt", "low", F.col("low").alias("high"))


def _removed(text: str | None, spans: list | np.ndarray | None, length: int) -> tuple:
    data, kept, runs, end = _encoded(text), [], 0, 0
    at = 0
    for low, high in sorted((s["low"], s["high"] + length) for s in (() if spans is None else spans)):
        if runs and low <= end:
            end = max(end, high)
            continue
        if runs:
            at = end
        kept.append(data[at:low])
        runs, end = runs + 1, high
    kept.append(data[end:] if runs else data)
    rest = b"".join(kept)
    return len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest


def _apply(joined: DataFrame, carry: list[str], length: int, texts: bool) -> DataFrame:
    parts = [c.split() for c in _DONE.split(", ")]
    if not texts:
        parts = parts[:-1]

    @F.pandas_udf(", ".join(" ".join(p) for p in parts))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for column, spans in batches:
            rows = [_removed(t, s, length)[: len(parts)] for t, s in zip(column, spans, strict=True)]
            yield pd.DataFrame(rows, columns=[p[0] for p in parts])

    return joined.withColumn("r", cut("text", "spans")).select(*carry, "r.*")


def _keyed(documents: DataFrame) -> DataFrame:
    """``id, salt, text``, never null; an odd salt stands for a null id.

    Both joins take these three columns, so the text's shuffle is one and the same.
    """
    salt = F.hash("text").cast("long") * 2 + F.col("doc_id").isNull().cast("int")
    return documents.select(
        F.coalesce("doc_id", F.lit(-1)).cast("long").alias("id"), salt.alias("salt"), F.coalesce("text", F.lit("")).alias("text")
    )


def remove_repeats(documents: DataFrame, length: int = LENGTH, *, texts: bool = False, together: int = TOGETHER) -> DataFrame:
    """Each document without the bytes that a repeated ``length``-byte string covers.

    Columns: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with
    ``texts``, the bytes that stay, as ``kept``. A string repeats if it starts
    at two places, in one document or two; places may overlap, and strings are
    judged on the input. Null text counts as empty; repeated rows repeat each
    other. The texts are shuffled once, to meet their runs and later their spans.
    """
    if length < 64:
        raise ValueError("anchors need windows of 64 bytes or more")
    docs = _keyed(documents)
    runs = stage(_runs(docs, length), "runs")
    counts = stage(runs.groupBy("gram", "hull").agg(F.count(F.lit(1)).alias("n")), "hulls")
    per_gram = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("contents"), F.min("n").alias("least"))
    open_grams = per_gram.filter("contents > 1 and least = 1").select("gram", "contents")
    wanted = counts.join(open_grams, "gram", "left").filter("n > 1 or contents is not null")
    found = stage(runs.join(wanted, ["gram", "hull"]), "open-runs")

    whole = found.filter("n > 1").select("id", "salt", "low", "high")
    place = F.min(F.struct("id", "salt", "low", "high")).alias("p")
    shared = found.filter("n > 1 and contents is not null").groupBy("gram", "hull", "contents").agg(place)
    alone = found.filter("n = 1").select("gram", "hull", "contents", F.struct("id", "salt", "low", "high").alias("p"))
    one_each = alone.withColumn("single", F.lit(True)).unionByName(shared.withColumn("single", F.lit(False)))

    def pieces(which: Column) -> DataFrame:
        asked = F.struct("gram", "single", F.col("p.low").alias("low"), F.col("p.high").alias("high"))
        listed = one_each.filter(which).groupBy(F.col("p.id").alias("id"), F.col("p.salt").alias("salt"))
        # A document's runs are no more than its bytes.
        return _cut(docs.join(listed.agg(F.collect_list(asked).alias("asked")), ["id", "salt"]), length)

    few = F.col("contents") <= together
    spans = whole.unionByName(_refined(pieces(few), length))
    if not found.filter(~few).isEmpty():
        spans = spans.unionByName(_counted(pieces(~few), length))
    merged = spans.groupBy("id", "salt").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    done = _apply(docs.join(merged, ["id", "salt"], "left"), ["id", "salt"], length, texts)
    doc_id = F.when(F.col("salt") % 2 == 0, F.col("id")).cast(dict(documents.dtypes)["doc_id"])
    return done.select(doc_id.alias("doc_id"), *[c for c in done.columns if c not in ("id", "salt")])
