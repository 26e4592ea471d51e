"""Licenses by TF-IDF cosine to templates, inherited down the directory tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import few_rows
from seedloom.sources.staging import stage

# How the common licenses are stated, titled and, where they are short, worded in full.
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE_FORM = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY_FORM = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_NO_ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version."
)


def _stated(name: str, spdx: str, *more: str) -> tuple[str, ...]:
    return (
        f"Licensed under the {name}.", f"Released under the {name}.", f"This work is licensed under the {name}.", f"Distributed under the {name}.",
        f"SPDX-License-Identifier: {spdx}", *more,
    )


def _gnu(name: str, short: str, version: str, spdx: str, title: str) -> tuple[str, ...]:
    return (
        *_stated(f"{name}, version {version}", spdx), f"Licensed under the {short} {version}.", f"Distributed under the {short}v{version}.",
        f"SPDX-License-Identifier: {spdx}-only", f"SPDX-License-Identifier: {spdx}-or-later", _GNU_HEADER.format(name=name, version=version), f"{name} {title}",
    )


def _commons(short: str, name: str, version: str = "4.0") -> tuple[str, ...]:
    return (
        f"Licensed under {short} {version}.", f"This work is licensed under a Creative Commons {name} {version} International License.",
        f"SPDX-License-Identifier: {short.replace(' ', '-')}-{version}",
    )


TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": _gnu("GNU Affero General Public License", "AGPL", "3", "AGPL-3.0", "Version 3, 19 November 2007"),
    "Apache-2.0": _stated(
        "Apache License, Version 2.0", "Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "BSD-2-Clause": _stated("BSD 2-Clause License", "BSD-2-Clause", _REDISTRIBUTION, f"{_REDISTRIBUTION} {_SOURCE_FORM} {_BINARY_FORM} {_AS_IS}"),
    "BSD-3-Clause": _stated(
        "BSD 3-Clause License", "BSD-3-Clause", _REDISTRIBUTION, _NO_ENDORSEMENT, f"{_REDISTRIBUTION} {_SOURCE_FORM} {_BINARY_FORM} {_NO_ENDORSEMENT} {_AS_IS}"
    ),
    "BSL-1.0": _stated("Boost Software License, Version 1.0", "BSL-1.0"),
    "CC-BY-4.0": _commons("CC BY", "Attribution"),
    "CC-BY-NC-4.0": _commons("CC BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _commons("CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _commons("CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _commons("CC BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-3.0": _commons("CC BY-SA", "Attribution-ShareAlike", "3.0"),
    "CC-BY-SA-4.0": _commons("CC BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": _stated("CC0 1.0 Universal Public Domain Dedication", "CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    "EPL-2.0": _stated("Eclipse Public License, version 2.0", "EPL-2.0"),
    "GPL-2.0": _gnu("GNU General Public License", "GPL", "2", "GPL-2.0", "Version 2, June 1991"),
    "GPL-3.0": _gnu("GNU General Public License", "GPL", "3", "GPL-3.0", "Version 3, 29 June 2007"),
    "ISC": _stated(
        "ISC License", "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "LGPL", "2.1", "LGPL-2.1", "Version 2.1, February 1999"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "LGPL", "3", "LGPL-3.0", "Version 3, 29 June 2007"),
    "MIT": _stated(
        "MIT License", "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "MPL-2.0": _stated(
        "Mozilla Public License, version 2.0", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the MPL 2.0.", "Mozilla Public License Version 2.0",
    ),
    "Unlicense": _stated("Unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
    "WTFPL": _stated("WTFPL", "WTFPL"),
    "Zlib": _stated("zlib License", "Zlib"),
}

TRIGGER = "(?i)licen[sc]e|spdx|copyright|redistribut|permission (?:is|to use)|public domain|distributed under|released under|dedicated to"
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice)(?:\.[a-z]+)?$"
LEAST_COSINE = 0.8
# A second license this near the best one leaves the statement open.
LEAST_LEAD = 0.02
# Up to so many directories with a license are broadcast.
FEW_FOLDERS = 100_000

_SENTENCE = r"\n|(?<=[.!?])[ \t]+"
_PARAGRAPH = r"\n[ \t]*\n"
_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
# Spellings made alike before words are compared: pattern and replacement.
SPELLINGS = (
    (r"(?m)^[ \t]*[0-9]+\.[ \t]", " "),  # numbers of a list
    (r"\b(l?gpl|agpl|mpl|epl)[ -]?v?([0-9])", r"$1 $2"),
    (r"\bv\.? ?([0-9])", r"$1"),
    (r"([0-9])\.0\b", r"$1"),
    (r"\bnon-?commercial\b", "nc"),
    (r"\bshare-?alike\b", "sa"),
    (r"\bno-?deriv(?:ative)?s\b", "nd"),
)
# Words that tell variants of a license apart, beside numbers that are no years.
VARIANT = r"^(?:[0-9]{1,3}(?:\.[0-9]+)*|lesser|library|affero|nc|sa|nd)$"


def _alike(text: Column) -> Column:
    text = F.lower(text)
    for pattern, instead in SPELLINGS:
        text = F.regexp_replace(text, pattern, instead)
    return text


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(_alike(text), F.lit(_TOKEN), F.lit(0))


def _marks(tokens: Column) -> Column:
    """The version numbers and variant words of a statement, as one text."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.rlike(VARIANT)))), " ")


def statements(documents: DataFrame, trigger: str = TRIGGER) -> DataFrame:
    """``doc_id, text_key, unit, marks, token, tf``: what speaks of a license.

    Units are sentences, which end at line breaks and after full stops,
    paragraphs, which are header blocks joined over line breaks, and the whole
    text, which may be a license file. Texts and parts without a trigger word,
    most of all, go before anything is exploded or shuffled. Equal rows and
    equal units count once.
    """
    speaking = documents.filter(F.col("text").rlike(trigger))
    parts = F.concat(F.split("text", _SENTENCE), F.split("text", _PARAGRAPH), F.array("text"))
    tokens = F.array_distinct(F.transform(F.filter(parts, lambda s: s.rlike(trigger)), _tokens))
    units = speaking.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(tokens).alias("unit", "t"))
    # Marks first: beside an explode they would be made anew for every token.
    marked = units.withColumn("marks", _marks(F.col("t")))
    each = marked.select("doc_id", "text_key", "unit", "marks", F.explode("t").alias("token"))
    # Rows that agree in id and text double their counts, which leaves cosines as they are.
    return each.groupBy("doc_id", "text_key", "unit", "marks", "token").agg(F.count(F.lit(1)).alias("tf"))


def _template_terms(spark: SparkSession, templates: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(name, n, text) for name, texts in templates.items() for n, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "license string, variant int, text string")
    tokens = table.select("license", "variant", _tokens(F.col("text")).alias("t"))
    exploded = tokens.withColumn("marks", _marks(F.col("t"))).select("license", "variant", "marks", F.explode("t").alias("token"))
    return exploded.groupBy("license", "variant", "marks", "token").agg(F.count(F.lit(1)).alias("ttf"))


def own_licenses(
    documents: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    least: float = LEAST_COSINE,
    lead: float = LEAST_LEAD,
) -> DataFrame:
    """``doc_id, text_key, own_license, own_score`` where a unit is near a template.

    Weights are term counts times the inverse document frequency over all units
    found. Only templates with the same version numbers and variant words are
    compared, so a near miss names no license. In each unit the best template
    counts, unless another license comes within ``lead`` of it: what two
    licenses share names neither. The best unit decides, of equal ones the
    first license by name. Scores are rounded to six places before they are
    compared.
    """
    terms = stage(statements(documents), "license-terms")
    keys = ["doc_id", "text_key", "unit"]
    total = terms.select(*keys).distinct().count()
    df = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    wanted = _template_terms(documents.sparkSession, templates)

    def weight(tf: str) -> Column:
        return F.col(tf) * (F.log((1.0 + total) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0)

    weighed = terms.join(df, "token").select(*keys, "marks", "token", weight("tf").alias("w"))
    weighed = stage(weighed, "license-weights")
    asked = wanted.join(df, "token", "left").select("license", "variant", "marks", "token", weight("ttf").alias("tw"))
    asked = stage(asked, "template-weights")  # the words of the templates
    norms = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sizes = asked.groupBy("license", "variant").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("size"))
    dots = weighed.join(F.broadcast(asked), ["token", "marks"]).groupBy(*keys, "license", "variant")
    dots = dots.agg(F.sum(F.col("w") * F.col("tw")).alias("dot")).join(F.broadcast(sizes), ["license", "variant"])
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6)
    scored = dots.alias("a").join(norms.alias("b"), same[0] & same[1] & same[2])
    scored = scored.select(*[f"a.{k}" for k in keys], "license", cosine.alias("cosine")).filter(F.col("cosine") >= least)
    best = scored.groupBy(*keys, "license").agg(F.max("cosine").alias("cosine"))
    # A row per license.
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l")))).alias("r")
    units = best.groupBy(*keys).agg(ranked)
    clear = units.filter(F.coalesce(F.get("r", F.lit(1))["c"] - F.col("r")[0]["c"] >= lead, F.lit(True)))
    return clear.groupBy("doc_id", "text_key").agg(F.min(F.col("r")[0]).alias("f")).select(
        "doc_id", "text_key", F.col("f.l").alias("own_license"), (-F.col("f.c")).alias("own_score")
    )


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(documents: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """One row per document: its own license, or that of the nearest directory above.

    ``documents`` has ``doc_id``, ``path`` and ``text``. A license file gives its
    license to its directory and all below that have no nearer one; of several
    in a directory the first by name counts. Null paths lie in no directory,
    null texts have no license of their own. Each directory is resolved once,
    whatever it holds.
    """
    own = own_licenses(documents, templates, least)
    own = stage(own, "own-licenses")
    narrow = documents.select("doc_id", "path", F.xxhash64("text").alias("text_key"))
    named = narrow.alias("d").join(
        own.alias("o"),
        F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.text_key") == F.col("o.text_key")),
        "left",
    )
    named = named.select("d.doc_id", "d.path", "own_license", "own_score", _folder(F.col("d.path")).alias("folder"))
    named = stage(named, "licensed")
    granted = named.filter(F.col("path").rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    granted = granted.groupBy(F.col("folder").alias("above")).agg(F.min("own_license").alias("granted"))
    if few_rows(granted, FEW_FOLDERS):
        granted = F.broadcast(granted)
    folders = named.select("folder").filter("folder is not null").distinct()
    steps = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    above = folders.select("folder", F.explode(F.array_distinct(F.concat(up, F.array(F.lit(""))))).alias("above"))
    nearest = F.max(F.struct(F.length("above").alias("n"), "above", "granted")).alias("top")
    resolved = above.join(granted, "above").groupBy("folder").agg(nearest)
    joined = named.join(resolved, "folder", "left")
    inherits = F.col("own_license").isNull()
    return joined.select(
        "doc_id",
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "top.granted").alias("license"),
        F.when(inherits, F.col("top.above")).alias("inherited_from"),
    )


def with_paths(documents: DataFrame) -> DataFrame:
    """Documents with a path made of source, language and id, ten files to a directory."""
    number = F.coalesce("doc_id", F.lit(0))
    hundred, ten = (F.call_function("div", number, F.lit(n)).cast("string") for n in (100, 10))
    name = F.when(number % 10 == 0, "LICENSE").otherwise(F.concat(number.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.lit("corpus"), hundred, ten, name)
    return documents.select("doc_id", "text", path.alias("path"))
