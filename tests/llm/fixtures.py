"""Small tables with everything an operator has to put up with."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for what they add or for steps in between.
CLASHES = ("kept", "spans", "block", "slot", "place", "score", "fingerprint", "__row", "__fp", "__quality",
           "__kept", "__base", "__g", "__f", "__id", "__hash", "id", "salt", "label", "s", "p", "row", "bucket")


def prose(seed: int, words: int) -> str:
    """Words that hardly ever repeat, in lines."""
    rng = random.Random(seed)
    made = ["".join(rng.choice("abdeghiklmnoprstuvz") for _ in range(rng.randint(3, 8))) for _ in range(words)]
    return "\n".join(" ".join(made[i : i + 12]) for i in range(0, words, 12))


def nasty_rows() -> list[tuple]:
    base, passage = prose(1, 120), prose(2, 80)
    texts = [
        None, "", " \n\t ", "one", "one two", base, base, base + " more", passage, f"{prose(3, 30)} {passage} {prose(4, 30)}",
        f"{prose(5, 200)} {passage}", "word " * 400, "a" * 3000, "9" * 3000, "1 " * 2000, "x@y.z " * 50, "é😀 ü@b.co 1.2.3.4  ",
        "call +1 (415) 555-1234 or mail a.b@c.de, card 4111 1111 1111 1111, host 10.0.0.1", prose(6, 5000), "### Assistant: x </turn>",
        "Released under the MIT License.", "you idiot, you moron",
    ]
    rows = [(n, t, "en", "a" if n % 3 else "b", len(t or "")) for n, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, None, None, None), (5, base, "en", "a", len(base))]
    rows += [(100 + n, prose(50 + n, 40), "de" if n % 2 else "en", None if n == 3 else "c", 1) for n in range(12)]
    return rows


def nasty(spark, extra: bool = False):
    df = spark.createDataFrame(nasty_rows(), DOCUMENTS).repartition(3)
    if extra:
        for n, name in enumerate(CLASHES):
            df = df.selectExpr("*", f"cast({n} as string) as `{name}`")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def benchmark(spark):
    rows = [(1, prose(2, 80)), (2, "only four words here"), (3, None), (4, ""), (None, prose(7, 20)), (1, prose(2, 80)), (5, "One TWO"), (6, "word word word")]
    return spark.createDataFrame(rows, "item_id long, text string")
