"""Text expressions against small specifications in Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from seedloom.functions import text as X

ALPHABET = ['$("', '")', '"', "$", "(", ")", "a", "B", " ", "\n", "é", "?", ".", "\\", "'"]
CHATTER = [
    "Generated content:", "verified CONTENT:", "Corrected version:", "Note:", "note: x",
    "Verification result: ok", "Reference Command:", "Verified Response:", "___name___", "__",
    '"', "'", " ", "\n", "\t", "\xa0", "\x1c", "what", "Is", "island", "x", "é", "ß", "1",
    "?", ".", "!", "end", "\r\n",
]


def random_texts(pieces, count, seed, longest=9):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(0, longest))) for _ in range(count)]


def evaluate(spark, texts, expression):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", expression.alias("v"))
    return [r["v"] for r in df.orderBy("i").collect()]


def spec_cells(text):
    """Scan for an opening mark, then the nearest of closing and opening mark."""
    cells, at = [], text.find('$("')
    while at >= 0:
        start = at + 3
        end, again = text.find('")', start), text.find('$("', start)
        if end < 0:
            break
        if 0 <= again < end:
            at = again
            continue
        cells.append(text[start:end])
        at = text.find('$("', end + 2)
    return cells


def test_cells_match_specification(spark):
    texts = random_texts(ALPHABET, 3000, 1, 14)
    assert evaluate(spark, texts, X.captured_cells(F.col("t"))) == [spec_cells(t) for t in texts]


def test_unterminated_mark_and_long_cell(spark):
    texts = ['$("a")$("' + "x\n" * 40, '$("' + "y" * 200_000 + '")', "", "no marks"]
    assert evaluate(spark, texts, X.captured_cells(F.col("t"))) == [["a"], ["y" * 200_000], [], []]


def test_escaped_marks_come_back(spark):
    texts = random_texts(ALPHABET, 2000, 2)
    marked = X.marked_cell(F.col("t"), escape=True)
    back = X.unescape_marks(F.get(X.captured_cells(marked), F.lit(0)))
    assert evaluate(spark, texts, back) == texts
    assert evaluate(spark, texts, F.size(X.captured_cells(marked))) == [1] * len(texts)


def test_unescaped_survival_is_predicted(spark):
    texts = random_texts(ALPHABET, 2000, 3)
    back = X.captured_cells(X.marked_cell(F.col("t")))
    kept = evaluate(spark, texts, back == F.array("t"))
    assert evaluate(spark, texts, X.survives_marking(F.col("t"))) == kept


def test_strip_matches_python(spark):
    white = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["​", "a", "b"]
    texts = random_texts(white, 1000, 4)
    assert evaluate(spark, texts, X.py_strip(F.col("t"))) == [t.strip() for t in texts]


def spec_question(text):
    if text.strip()[-1:] == "?":
        return True
    return any(text.lower().startswith(w) for w in X.QUESTION_WORDS)


def test_is_question(spark):
    texts = random_texts(CHATTER, 3000, 5) + ["island life", " what", "DOcument", "ok? "]
    assert evaluate(spark, texts, X.is_question(F.col("t"))) == [spec_question(t) for t in texts]
    strict = X.is_question(F.col("t"), word_boundary=True)
    assert evaluate(spark, ["island", "is it", "How", "isé", "do_x", "Can."], strict) == [False, True, True, False, False, True]


def spec_clean(text, question):
    for label in ["Generated content:", "Verified content:", "Corrected version:"]:
        if text[: len(label)].lower() == label.lower():
            text = text[len(label):].lstrip()
            break
    # The last line, and the newline that may end it, decide on trailing labels.
    ending = "\n" if text.endswith("\n") else ""
    body = text[: len(text) - len(ending)]
    head, newline, line = body.rpartition("\n")
    places = [
        line.lower().find(label)
        for label in ("verification result:", "reference command:", "note:", "verified response:")
    ]
    places = [p for p in places if p >= 0]
    if places:
        text = (head + newline + line[: min(places)]).rstrip() + ending
    text = re.sub("___[A-Za-z_]+___", "", text).strip("\"'").strip()
    if text and text[0].islower():
        text = text[0].upper() + text[1:]
    if question:
        return text if text.endswith("?") else text + "?"
    if not text:
        return None
    return text if text[-1] in ".!?" else text + "."


@pytest.mark.parametrize("question", [True, False])
def test_clean_generated(spark, question):
    texts = random_texts(CHATTER, 4000, 6)
    got = evaluate(spark, texts, X.clean_generated(F.col("t"), F.lit(question)))
    assert got == [spec_clean(t, question) for t in texts]


def test_verified_ending(spark):
    texts = ["Ok", "Ok?", " Ok? ", "", "?"]
    asked = X.verified_ending(F.col("t"), F.lit(True))
    stated = X.verified_ending(F.col("t"), F.lit(False))
    loose = X.verified_ending(F.col("t"), F.lit(False), restate=False)
    assert evaluate(spark, texts, asked) == ["Ok?", "Ok?", "Ok?", "?", "?"]
    assert evaluate(spark, texts, stated) == ["Ok", "Ok.", "Ok.", "", "."]
    assert evaluate(spark, texts, loose) == ["Ok", "Ok?", "Ok?", "", "?"]


def test_json_or_raw(spark):
    texts = ['{"a": 1}', "[1, 2]", ' "x" ', "null", "{bad", "plain", "", "3.5", '{"k": 8}}', "1, 2", "1] , [2", '{"a": [1]} x', "[]", "-", '"open']
    got = evaluate(spark, texts, X.json_or_raw(F.col("t")))
    for text, row in zip(texts, got):
        try:
            json.loads(text.strip())
            valid = True
        except json.JSONDecodeError:
            valid = False
        assert (row["is_json"], row["raw"]) == (valid, text.strip())


def test_python_repr(spark):
    pieces = ["'", '"', "\\", "\n", "\t", "\r", "a", "é", "\x00", "\x7f", "\xa0", "​", "\U0001f600", " ", "\U000e0001"]
    texts = random_texts(pieces, 2000, 7)
    assert evaluate(spark, texts, X.python_repr(F.col("t"))) == [repr(t) for t in texts]
    shown = X.python_dict({"a'b": F.col("t"), "n": F.lit(3)}, {"a'b"})
    assert evaluate(spark, texts[:50], shown) == [str({"a'b": t, "n": 3}) for t in texts[:50]]


def test_json_of_odd_forms(spark):
    texts = ['{"a": 1, "a": 2}', "NaN", "-Infinity", "[1,2", "truest", "1,2", '{"a"}', '"x" "y"', "[1] ", "-", "1e5"]
    got = evaluate(spark, texts, F.struct(X.json_or_raw(F.col("t"))["is_json"], X.json_or_raw(F.col("t"))["value"].cast("string")))
    assert [tuple(g) for g in got] == [
        (True, '{"a":2}'), (True, "NaN"), (True, "-Infinity"), (False, None), (False, None), (False, None),
        (False, None), (False, None), (True, "[1]"), (False, None), (True, "100000.0"),
    ]
