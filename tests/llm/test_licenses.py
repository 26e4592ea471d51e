"""Licenses told apart by version, clause and variant; near misses; whole files and header blocks."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from seedloom.llm import licenses  # noqa: E402

PROSE = "Some other words of a text that says nothing about terms at all."
MIT = "MIT License\n\nCopyright (c) 2024 Someone\n\n" + "\n".join(licenses.TEMPLATES["MIT"][-2].replace(", ", ",\n").split("\n")) + (
    "\n\nThe above copyright notice and this permission notice shall be included in all copies.\n"
)
CASES = [
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 5.", None),
    ("This work is licensed under the GNU General Public License.", None),
    ("Distributed under the GPLv3.", "GPL-3.0"),
    ("Distributed under the GPLv2", "GPL-2.0"),
    ("Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("Licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY 2.0.", None),
    ("This text is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", None),
    ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
    ("Released under the BSD 3-Clause License", "BSD-3-Clause"),
    ("Licensed under the Mozilla Public License, version 2.0.", "MPL-2.0"),
    ("Licensed under the Mozilla Public License, version 1.1.", None),
    ("Released under the ISC License.", "ISC"),
    ("Licensed under the Apache License, v2.0", "Apache-2.0"),
    ("Licensed under the Apache License, Version 1.1", None),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("# Copyright 2023 Someone.\n# Licensed under the Apache License,\n# Version 2.0 (the License); you may not\n# use this file except in compliance\n# with the License.\n\n" + PROSE, "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n" + PROSE, "GPL-2.0"),
    ("\n\n".join([licenses._REDISTRIBUTION, "1. " + licenses._SOURCE_FORM, "2. " + licenses._BINARY_FORM, licenses._AS_IS]), "BSD-2-Clause"),
    ("\n\n".join([licenses._REDISTRIBUTION, "1. " + licenses._SOURCE_FORM, "2. " + licenses._BINARY_FORM, "3. " + licenses._NO_ENDORSEMENT, licenses._AS_IS]), "BSD-3-Clause"),
    (MIT, "MIT"),
    ("A license is needed to drive.", None),
    ("All rights reserved. Copyright 2020.", None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(n, f"d{n}/LICENSE", t) for n, (t, _) in enumerate(CASES)] + [(1000 + n, f"p/{n}", PROSE) for n in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    return {r.doc_id: r for r in licenses.scan(df).collect()}


def test_variants_and_near_misses(found):
    assert [(t[:60], w, found[n].own_license) for n, (t, w) in enumerate(CASES) if found[n].own_license != w] == []


def test_the_cosine_decides(found):
    scores = [r.own_score for r in found.values() if r.own_score is not None]
    assert min(scores) < 0.95 and sum(s < 1.0 for s in scores) >= 3 and max(scores) <= 1.0


def test_long_texts_repeated_ids_and_clashing_columns(spark):
    long = (PROSE + "\n") * 20_000 + "Released under the MIT License.\n" + "x" * 200_000
    rows = [(1, "a/f", long), (2, "a/g", "Licensed under CC BY 4.0."), (2, "a/g", "Released under the ISC License."), (2, "a/g", "Released under the ISC License."), (3, "a/h", "")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    clashing = df.selectExpr("*", *[f"'x' as {c}" for c in ("license", "own_license", "own_score", "inherited_from", "folder", "above", "granted", "top", "text_key", "unit", "marks", "token")])
    for t in (df, clashing):
        got = sorted((r.doc_id, str(r.own_license)) for r in licenses.scan(t).collect())
        assert got == [(1, "MIT"), (2, "CC-BY-4.0"), (2, "ISC"), (2, "ISC"), (3, "None")]
