"""Personal data: loose candidates, judged by boosted trees.

Base spans are what the four patterns match and their checks confirm. Further
generators propose spans that overlap them and each other. Trees fitted on a
bounded sample, with base spans as positives, score the format and context of
every candidate, and a candidate is added where its score passes a threshold
that all candidates of its kind outside the sample calibrate. Column expressions only.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from seedloom.functions.expr import let, whole_div
from seedloom.llm import boosting
from seedloom.llm.common import fresh
from seedloom.sources.staging import stage

KINDS = ("email", "ip", "card", "phone")

# Each matches what the contract's pattern matches, leftmost and in turn, in
# linear time and without recursion: a run is entered at its start or where the
# last match ended, and repetitions consume single characters.
_LOCAL = r"[A-Za-z0-9._%+-]"
_BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9-]"
    r"(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for a pattern to be worth running.
_HINT = {"email": "@", "phone": "+"}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,63}){1,4}",
    # Four numbers that may be an address, entered anywhere, with plain or bracketed dots; or eight groups of hex digits.
    "ip": rf"(?<![0-9])(?:{_OCTET}(?:(?:\.|\[\.\]|\(\.\)){_OCTET}){{3}}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Fa-f:]))",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ .-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9.+-])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]{0,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
_CONTEXT = (
    r"(?i)\b(?:tel|phone|call|fax|mobil)",
    r"(?i)\b(?:card|visa|pay|iban|konto)",
    r"(?i)\b(?:e?-?mail|contact|write)",
    r"(?i)\b(?:token|key|hash|sha[0-9]*|id)\b|=",
    r"(?i)\b(?:ip|host|server|addr|address|login|from)\b",
    r"(?i)\b(?:version|release|section|chapter|v)\b",
)
_CHUNK = 256


class Settings(NamedTuple):
    """``sample`` bounds the candidates that the trees are fitted on; thresholds take all others."""

    sample: int = 20_000
    precision: float = 0.95
    rounds: int = 10
    depth: int = 3


SETTINGS = Settings()


def _before(lengths: Column) -> Column:
    """For each entry the sum of those before it, in chunks so that long arrays stay cheap."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def of(lengths: Column) -> Column:
        last = whole_div(F.size(lengths) - 1, _CHUNK).cast("int")
        starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        sums = F.transform(starts, lambda c: total(F.slice(lengths, c * _CHUNK + 1, _CHUNK)))

        def chunked(sums: Column) -> Column:
            offsets = F.transform(sums, lambda s, c: total(F.slice(sums, 1, c)))
            return let(offsets, lambda o: F.transform(lengths, lambda x, i: placed(o, i)))

        def placed(offsets: Column, i: Column) -> Column:
            chunk = whole_div(i, _CHUNK).cast("int")
            return F.get(offsets, chunk) + total(F.slice(lengths, chunk * _CHUNK + 1, i % _CHUNK))

        return let(sums, chunked)

    return let(lengths, of)


_SPAN = "array<struct<start:int,end:int,value:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """Start, end (code points) and text of every match, leftmost first."""

    def located(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def spans(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.char_length(m) + F.char_length(F.get(gaps, i)))

            def at(before: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    start = F.get(before, i) + F.char_length(F.get(gaps, i))
                    return F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("value"))

                return F.transform(found, span)

            return let(_before(steps), at)

        return F.when(F.size(found) > 0, let(gaps, spans)).otherwise(F.array().cast(_SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the check."""

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    short = F.substring(digits, 1, 19)
    each = F.transform(F.split(F.reverse(short), ""), weighed)
    total = F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)
    return F.when(F.char_length(digits) > 0, total % 10 == 0).otherwise(F.lit(False))


def _confirmed(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        small = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(small, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(value)
        return F.char_length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The matches of a kind that pass its check."""
    found = F.filter(_matches(text, _BASE[kind]), lambda s: _confirmed(kind, s))
    hint = text.contains(_HINT[kind]) if kind in _HINT else text.rlike("[0-9][^A-Za-z]*[0-9]")
    return F.when(hint, found).otherwise(F.array().cast(_SPAN))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _features(text: Column, kind: str, span: Column) -> Column:
    value, digits = span["value"], _digits(span["value"])
    from_ = F.greatest(span["start"] - 32, F.lit(0))
    before = text.substr(from_ + 1, span["start"] - from_)
    after = text.substr(span["end"] + 1, F.lit(1))
    n, d = F.char_length(value), F.char_length(digits)
    numbers = [
        F.lit(KINDS.index(kind)),
        n,
        d,
        F.size(F.split(value, "[^0-9]+")),
        F.size(F.split(value, "[ ]")),
        F.size(F.split(value, "-")),
        F.size(F.split(value, r"\.")),
    ]
    flags = [
        value.contains("("),
        value.contains("@"),
        _luhn(digits),
        digits.startswith("0"),
        before.rlike("[A-Za-z]$"),
        before.rlike(r"[+(=\"'/#-]\s?$"),
        after.rlike("[A-Za-z]"),
        (after == "") | after.rlike(r"[.,;:!?\s]"),
        *[before.rlike(p) for p in _CONTEXT],
    ]
    return F.array(*[x.cast("double") for x in numbers], *[_flag(x) for x in flags])


def _candidates(text: Column, kind: str, base: Column) -> Column:
    """Loose spans of a kind with their features; ``base`` tells if one meets a base span."""

    def candidate(span: Column) -> Column:
        meets = F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            span["start"].alias("start"),
            span["end"].alias("end"),
            meets.alias("base"),
            F.xxhash64(span["value"]).alias("value"),
            _features(text, kind, span).alias("features"),
        )

    found = _matches(text, _LOOSE[kind])
    if kind == "phone":
        found = F.filter(found, lambda s: F.char_length(_digits(s["value"])).between(7, 15))
    return F.transform(found, candidate)


def with_candidates(documents: DataFrame, name: str) -> DataFrame:
    """Add a struct of the base spans, by kind, and the loose candidates. Narrow."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Few texts hold a digit or an @; the others skip the generators.
    worth = text.rlike(r"[0-9@]|[\[(]at[\])]")
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,value:bigint,features:array<double>>>")

    def of(base: Column) -> Column:
        made = F.concat(*[_candidates(text, k, base[k]) for k in _LOOSE])
        return F.struct(base.alias("base"), F.when(worth, made).otherwise(empty).alias("loose"))

    return documents.withColumn(name, let(F.struct(*[base_spans(text, k).alias(k) for k in KINDS]), of))


class Model(NamedTuple):
    boosted: boosting.Boosted | None
    thresholds: tuple[float, ...]


def _training_sample(each: DataFrame, most: int) -> DataFrame:
    """``kind, label, order, features``: an equal part of ``most`` for each kind and label.

    Of the distinct candidates of a kind and label it has those of smallest
    ``order``: the same on every run.
    """
    # One row per kind and label.
    sizes = each.groupBy("kind", "label").agg(F.approx_count_distinct("order").alias("n")).collect()
    part = max(1, most // max(1, len(sizes)))
    # Digests are even, so twice the part is surely below these.
    low = [_of(r, F.col("order") <= min(2**63 - 1, -(2**63) + 2**64 * (2 * part + 200) // r.n)) for r in sizes]
    distinct = each.filter(_any(low)).groupBy("kind", "label", "order").agg(F.first("features").alias("features"))
    ranked = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "label").orderBy("order")))
    return ranked.filter(F.col("nth") <= part).drop("nth")


def _of(row: Row, condition: Column) -> Column:
    return (F.col("kind") == row.kind) & (F.col("label") == row.label) & condition


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def fit(rows: DataFrame, loose: str, settings: Settings = SETTINGS) -> Model:
    """Trees from at most ``settings.sample`` distinct candidates, and one threshold per kind.

    Candidates of equal text and features, wherever they are, are copies. A fifth of the distinct candidates never enters the sample. A kind's
    threshold is the lowest score from which all its candidates outside the
    sample reach the wanted precision against base spans; copies count each. A
    kind without such a score adds nothing.
    """
    each = rows.select(F.inline(loose)).withColumn("label", F.col("base").cast("int"))
    each = each.select("kind", "label", "features", F.xxhash64("kind", "value", "features").alias("order"))
    held = F.pmod(F.xxhash64(F.lit(1), "order"), F.lit(5)) == 0
    sample = stage(_training_sample(each.filter(~held), settings.sample), "candidates")
    boosted = boosting.fit(sample, rounds=settings.rounds, depth=settings.depth)
    if boosted is None:
        return Model(None, tuple(2.0 for _ in KINDS))
    # The sample has every distinct candidate up to its last one.
    last = sample.groupBy("kind", "label").agg(F.max("order").alias("order")).collect()
    others = each.filter(held | ~_any([_of(r, F.col("order") <= r.order) for r in last]))
    scored = others.select("kind", "label", F.floor(boosted.score(F.col("features")) * 100).alias("bin"))
    # At most 101 rows per kind.
    bins = scored.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")).collect()
    thresholds = []
    for kind in range(len(KINDS)):
        best, n, hits = 2.0, 0, 0
        for b in sorted((r for r in bins if r.kind == kind), key=lambda r: -r.bin):
            n, hits = n + b.n, hits + b.hits
            if hits >= settings.precision * n and b.bin >= 50:
                best = b.bin / 100
        thresholds.append(best)
    return Model(boosted, tuple(thresholds))


def _chosen(base: Column, loose: Column, model: Model) -> Column:
    """All spans ``(kind, start, end)``: base ones, and the candidates that pass."""
    kept = [_tagged(base[k], n) for n, k in enumerate(KINDS)]
    if model.boosted is not None:
        limits = F.array(*[F.lit(t) for t in model.thresholds])
        passed = F.filter(
            loose,
            lambda c: ~c["base"] & (F.get(limits, c["kind"]) <= model.boosted.score(c["features"])),
        )
        kept.append(F.transform(passed, lambda c: F.struct(c["kind"].alias("k"), c["start"].alias("s"), c["end"].alias("e"))))
    return F.array_sort(F.array_distinct(F.concat(*kept)))


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(F.lit(kind).alias("k"), s["start"].alias("s"), s["end"].alias("e"))
    )


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["s"], s["e"])), ",")


def found_spans(documents: DataFrame, carry: list[str], settings: Settings = SETTINGS) -> tuple[DataFrame, str, str]:
    """The columns ``carry`` with base spans and all spans; their names come along.

    Candidates are made in one narrow pass and staged with what is carried;
    the model is fitted on them and applied to the staged rows.
    """
    base, loose, spans = (fresh(documents, n) for n in ("__base", "__loose", "__spans"))
    rows = stage(with_candidates(documents, base).select(*carry, base), "pii")
    rows = rows.withColumn(loose, F.col(base)["loose"]).withColumn(base, F.col(base)["base"])
    model = fit(rows, loose, settings)
    return rows.withColumn(spans, _chosen(F.col(base), F.col(loose), model)).drop(loose), base, spans


def pii_report(documents: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One row per document: base counts, their digest, and all spans.

    Null text counts as empty and has no spans. Repeated rows stay.
    """
    rows, base, spans = found_spans(documents.select("doc_id", "text"), ["doc_id"], settings)
    counts = [F.size(F.col(base)[k]).cast("long").alias(f"n_{k}") for k in KINDS]
    tagged = F.concat(*[_tagged(F.col(base)[k], n) for n, k in enumerate(KINDS)])
    return rows.select(
        "doc_id", *counts, F.sha2(_shown(tagged), 256).alias("base_sha256"), _shown(F.col(spans)).alias("spans")
    )


def _merged(spans: Column) -> Column:
    """Spans in text order; those that overlap become one, of the first one's kind."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), s["k"].alias("k"))))
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")

    def join(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["s"].alias("s"), F.greatest(last["e"], span["e"]).alias("e"), last["k"].alias("k"))
        rest = F.slice(done, 1, F.size(done) - 1)
        return F.when((F.size(done) > 0) & (span["s"] < last["e"]), F.concat(rest, F.array(wider))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(by_start, none, join)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by the name of its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def of(merged: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            start = F.coalesce(F.get(merged, i - 1)["e"], F.lit(0))
            return F.concat(text.substr(start + 1, span["s"] - start), F.get(names, span["k"]))

        end = F.coalesce(F.try_element_at(merged, F.lit(-1))["e"], F.lit(0))
        tail = text.substr(end + 1, F.char_length(text))
        return F.concat(F.array_join(F.transform(merged, piece), ""), tail)

    return F.when(F.size(spans) > 0, let(_merged(spans), of)).otherwise(text)


def redact(documents: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Every document with its spans replaced, in the columns it came with.

    ``n_chars``, where there is one, follows the new text; null text stays null.
    """
    rows, _, spans = found_spans(documents, documents.columns, settings)
    done = rows.withColumn("text", redacted(F.col("text"), F.col(spans)))
    if "n_chars" in documents.columns:
        changed = F.size(spans) > 0
        done = done.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*documents.columns)
