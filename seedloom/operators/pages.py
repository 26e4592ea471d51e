"""Raw web pages to text, as column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.functions.expr import let

# Elements without text of their own, and elements that end a line of text.
SILENT = ("script", "style", "head", "title", "noscript", "template", "iframe", "svg", "textarea", "select")
BLOCKS = (
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split()

_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_BLOCK_TAG = rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:[\s/][^>]*)?>"
_LINK = r"(?is)<a(?:\s[^>]*)?>(.*?)(?:</a\s*>|\z)"
_TAG = r"</?[A-Za-z!?][^>]*>"
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _character(code: Column) -> Column:
    """The character of a code point; what is none becomes U+FFFD."""
    fits = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(fits, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def decoded(text: Column) -> Column:
    """Character references ended by a semicolon as characters; all else stays.

    The text is cut at ``&``, so each reference is read once and what it gives
    is not read again.
    """
    names = F.create_map(*[F.lit(x) for n, c in sorted(name2codepoint.items()) for x in (n, chr(c))], F.lit("apos"), F.lit("'"))

    def read(piece: Column, n: Column) -> Column:
        name = F.regexp_extract(piece, _REFERENCE, 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 7), 16, 10)).otherwise(F.substring(name, 2, 8))
        found = F.when(name.startswith("#"), _character(number.cast("long"))).otherwise(F.try_element_at(names, name))
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        plain = F.concat(F.lit("&"), piece)
        return F.when(n == 0, piece).when((name == "") | found.isNull(), plain).otherwise(F.concat(found, rest))

    cut = F.array_join(F.transform(F.split(text, "&", -1), read), "")
    return F.when(text.contains("&"), cut).otherwise(text)


def _plain(markup: Column) -> Column:
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(markup, _TAG, "")), r"[\s ]+", " "))


def page_lines(html: Column, most_links: float = 0.5) -> Column:
    """The lines of text of a page, in order, without those that are mostly links.

    Comments and elements without text go first, to their end or, where that
    is missing, to the end of the page. Tags of blocks end a line, other tags
    vanish. A line goes if more than ``most_links`` of its characters stand in
    links. Null has no lines. Every step reads the page once.
    """
    page = F.regexp_replace(F.coalesce(html, F.lit("")), _COMMENT, "")
    for name in SILENT:
        page = F.regexp_replace(page, rf"(?is)<{name}(?:[\s/][^>]*)?>.*?(?:</{name}\s*>|\z)", " ")

    def line(piece: Column) -> Column:
        linked = F.array_join(F.regexp_extract_all(piece, F.lit(_LINK), F.lit(1)), "")
        return let(_plain(piece), lambda t: F.struct(t.alias("text"), F.when(piece.contains("<"), F.length(_plain(linked))).otherwise(0).alias("linked")))

    lines = F.transform(F.split(page, _BLOCK_TAG, -1), line)
    kept = F.filter(lines, lambda x: (x["text"] != "") & (x["linked"] <= most_links * F.length(x["text"])))
    return F.transform(kept, lambda x: x["text"])


def page_text(pages: DataFrame, html: str = "html", *, name: str = "content", most_links: float = 0.5) -> DataFrame:
    """Pages with their text as lines, ready to be joined with other documents. Narrow."""
    return pages.withColumn(name, F.array_join(page_lines(F.col(html), most_links), "\n"))
