"""Text rules as column expressions: tags, cleaning, endings, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seedloom.functions.expr import let, whole_div

# What Python's str.strip() removes.
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Words that open a question.
QUESTION_WORDS = [
    "what", "when", "where", "who", "why", "how", "can", "could",
    "would", "should", "is", "are", "do", "does",
]

# Labels a model puts before or after its answer.
LEADING_LABELS = ["Generated content:", "Verified content:", "Corrected version:"]
TRAILING_LABELS = [
    "Verification result:", "Reference Command:", "Note:", "Verified Response:",
]

# Cell marks.
OPEN_MARK = '$("'
CLOSE_MARK = '")'

_LEADING = rf"(?iu)^(?:{'|'.join(LEADING_LABELS)})"
_TRAILING = rf"(?=[VvRrNn])(?iu:{'|'.join(TRAILING_LABELS)})"  # first letters fail fast
_PLACEHOLDER = r"___[A-Za-z_]+___"


def py_strip(text: Column) -> Column:
    """Strip the same characters as Python's ``str.strip()``."""
    return F.btrim(text, F.lit(PYTHON_WHITESPACE))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


# --- tagged cells ---------------------------------------------------------


def captured_cells(content: Column) -> Column:
    """All cells marked ``$("...")`` in a text, in order, as an array.

    A cell ends at the first closing mark and holds no opening mark, so
    splitting at the opening marks finds the same cells as a regular
    expression would, in linear time and without recursion.
    """
    pieces = F.split(content, r'\$\("')
    closed = F.filter(pieces, lambda p, i: (i > 0) & F.contains(p, F.lit(CLOSE_MARK)))
    return F.transform(closed, lambda p: F.substring_index(p, CLOSE_MARK, 1))


def marked_cell(value: Column, *, escape: bool = False, null_text: str = "None") -> Column:
    """Wrap a value as ``$("value")``."""
    value = F.coalesce(value.cast("string"), F.lit(null_text))
    if escape:
        value = escape_marks(value)
    return F.concat(F.lit(OPEN_MARK), value, F.lit(CLOSE_MARK))


def escape_marks(value: Column) -> Column:
    """Break up marks inside a value with backslashes."""
    value = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    value = F.replace(value, F.lit("$("), F.lit("$\\("))
    return F.replace(value, F.lit('")'), F.lit('"\\)'))


def unescape_marks(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)\\(.)", "$1")


def survives_marking(value: Column) -> Column:
    """Whether an unescaped value comes back whole from its marks."""
    lost = value.contains(OPEN_MARK) | value.contains(CLOSE_MARK) | value.endswith("$(")
    return ~F.coalesce(lost, F.lit(False))


def cell_rows(
    cells: Column, fields: list[str], *, strip: bool = True, ragged: str = "pad"
) -> Column:
    """Deal an array of cells to rows of a template, as array of structs.

    Cell i goes to field ``i % len(fields)``. A short last row is filled with
    empty text (``ragged="pad"``) or left out (``ragged="drop"``).
    """
    if ragged not in ("pad", "drop"):
        raise ValueError(f"ragged must be 'pad' or 'drop', not {ragged!r}")
    width = len(fields)

    def row(cs: Column, r: Column) -> Column:
        values = []
        for j, field in enumerate(fields):
            cell = F.get(cs, (r * width + j).cast("int"))
            cell = py_strip(cell) if strip else cell
            values.append(F.coalesce(cell, F.lit("")).alias(field))
        return F.struct(*values)

    def rows(cs: Column) -> Column:
        spare = width - 1 if ragged == "pad" else 0
        count = whole_div(F.size(cs) + spare, width)
        numbers = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))
        numbers = F.coalesce(numbers, F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda r: row(cs, r))

    return let(cells, rows)


# --- questions, cleaning, endings ----------------------------------------


def is_question(text: Column, *, word_boundary: bool = False) -> Column:
    """Ends with ``?`` or starts with a question word.

    The words are plain prefixes ("island" counts) unless ``word_boundary``.
    """
    tail = r"(?![\p{L}\p{N}_])" if word_boundary else ""
    # No word and boundary reaches past these characters.
    head = F.left(text, F.lit(max(map(len, QUESTION_WORDS)) + 1))
    starts = head.rlike(rf"^(?i:{'|'.join(QUESTION_WORDS)}){tail}")
    return F.rtrim(text, F.lit(PYTHON_WHITESPACE)).endswith("?") | starts


def clean_generated(text: Column, question: Column) -> Column:
    """Remove model chatter and give the text a proper start and end.

    An answer of which nothing is left becomes NULL, unless it stands for a
    question, where it becomes ``?``. Most answers need no regular expression
    over the whole text, so each step first looks at the part that decides.
    """

    def finish(t: Column) -> Column:
        body = py_strip(F.btrim(_without_placeholders(t), F.lit("\"'")))
        return let(body, lambda b: _with_ending(_with_capital(b), question))

    return let(let(text, _without_leading_label), lambda t: let(_without_trailing_label(t), finish))


def _without_leading_label(text: Column) -> Column:
    head = F.left(text, F.lit(max(map(len, LEADING_LABELS))))
    label = F.regexp_extract(head, _LEADING, 0)
    rest = F.ltrim(F.substr(text, F.length(label) + 1), F.lit(PYTHON_WHITESPACE))
    return F.when(head.rlike(_LEADING), rest).otherwise(text)


def _without_trailing_label(text: Column) -> Column:
    """Cut from the first label on the last line, keeping a final newline."""

    def cut(body: Column) -> Column:
        line = F.substring_index(body, "\n", -1)
        start = F.when(line.contains(":"), F.regexp_instr(line, F.lit(_TRAILING))).otherwise(0)

        def kept(at: Column) -> Column:
            before = F.substr(body, F.lit(1), F.length(body) - F.length(line) + at - 1)
            newline = F.when(text.endswith("\n"), "\n").otherwise("")
            short = F.concat(F.rtrim(before, F.lit(PYTHON_WHITESPACE)), newline)
            return F.when(at > 0, short).otherwise(text)

        return let(start, kept)

    body = F.when(text.endswith("\n"), F.substr(text, F.lit(1), F.length(text) - 1))
    return let(body.otherwise(text), cut)


def _without_placeholders(text: Column) -> Column:
    removed = F.regexp_replace(text, _PLACEHOLDER, "")
    return F.when(text.contains("___"), removed).otherwise(text)


def _with_capital(text: Column) -> Column:
    first = F.substring(text, 1, 1)
    raised = F.concat(F.upper(first), F.substr(text, F.lit(2)))
    return F.when(first.rlike(r"^\p{javaLowerCase}"), raised).otherwise(text)


def _with_ending(text: Column, question: Column) -> Column:
    asked = F.when(text.endswith("?"), text).otherwise(F.concat(text, F.lit("?")))
    done = text.endswith(".") | text.endswith("!") | text.endswith("?")
    stated = F.when(text == "", F.lit(None)).when(done, text)
    return F.when(question, asked).otherwise(stated.otherwise(F.concat(text, F.lit("."))))


def verified_ending(text: Column, question: Column, *, restate: bool = True) -> Column:
    """End a verified text with ``?`` if and only if it answers a question.

    With ``restate=False`` a statement that ends in ``?`` stays as it is, the
    rule for verified paraphrases.
    """

    def fix(t: Column) -> Column:
        ends = t.endswith("?")
        fixed = F.when(question & ~ends, F.concat(t, F.lit("?")))
        if restate:
            shorter = F.substr(t, F.lit(1), F.length(t) - 1)
            fixed = fixed.when(~question & ends, F.concat(shorter, F.lit(".")))
        return fixed.otherwise(t)

    return let(py_strip(text), fix)


# --- JSON and Python notation --------------------------------------------


# What a JSON value, or one of the words that Python's parser takes besides,
# starts and ends with. Any other text is none, and a failed parse is slow.
_JSON_LIKE = r"""(?s)^(?:\[.*\]|\{.*\}|".*"|-?[0-9](?:.*[0-9])?|true|false|null)$"""


def json_or_raw(text: Column) -> Column:
    """Struct of ``is_json``, ``value`` (VARIANT, NULL on bad JSON) and ``raw``.

    Spark's parser stops after the first value and ignores the rest, so the
    text is parsed once, inside an array with its digest: it is valid if that
    has just two entries. Of repeated keys the last counts, given the session
    settings of this package. ``NaN`` and the infinities are JSON to Python's
    parser; they become the text of that name.
    """

    t = py_strip(text)
    digest = F.md5(t)
    constant = t.isin("NaN", "Infinity", "-Infinity")
    shown = F.when(constant, F.concat(F.lit('"'), t, F.lit('"'))).when(t.rlike(_JSON_LIKE), t)
    framed = F.concat(F.lit("["), shown, F.lit(',"'), digest, F.lit('"]'))

    def of(parsed: Column) -> Column:
        whole = F.coalesce(F.try_variant_get(parsed, "$[1]", "string") == digest, F.lit(False))
        value = F.when(whole, F.try_variant_get(parsed, "$[0]", "variant"))
        return F.struct(whole.alias("is_json"), value.alias("value"), t.alias("raw"))

    return let(F.try_parse_json(framed), of)


_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def python_repr(value: Column) -> Column:
    """A string as Python's ``repr`` shows it; NULL as ``None``."""

    def escape_char(ch: Column) -> Column:
        code = F.ascii(ch)
        digits = F.lower(F.hex(code))
        return (
            F.when(~ch.rlike(_UNPRINTABLE), ch)
            .when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
            .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
        )

    def quoted(s: Column) -> Column:
        double = s.contains("'") & ~s.contains('"')
        single = F.replace(s, F.lit("'"), F.lit("\\'"))
        return F.when(double, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), single, F.lit("'"))
        )

    escaped = value
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))

    def printable(s: Column) -> Column:
        slow = F.array_join(F.transform(F.split(s, ""), escape_char), "")
        return F.when(s.rlike(_UNPRINTABLE), slow).otherwise(s)

    return F.coalesce(let(let(escaped, printable), quoted), F.lit("None"))


def python_dict(values: dict[str, Column], text_columns: set[str]) -> Column:
    """Named values in the notation of a printed Python dict."""
    parts: list[Column] = []
    for i, (name, value) in enumerate(values.items()):
        shown = (
            python_repr(value)
            if name in text_columns
            else F.coalesce(value.cast("string"), F.lit("None"))
        )
        parts += [F.lit((", " if i else "") + repr(name) + ": "), shown]
    return F.concat(F.lit("{"), *parts, F.lit("}"))
