"""What kind of source a URL names, and its parts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def has_host(url: Column) -> Column:
    return F.coalesce(url.rlike(_SCHEME + r"[^/?#]"), F.lit(False))


def with_scheme(source: Column) -> Column:
    """Give a source that holds ``/`` but no scheme and host ``http://``."""
    bare = ~has_host(source) & source.contains("/")
    return F.when(bare, F.concat(F.lit("http://"), source)).otherwise(source)


def _host(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 1)


def _path(url: Column) -> Column:
    path = F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def _mentions(url: Column, part: str) -> Column:
    return F.lower(url).contains(part)


def _is_wikipedia(url: Column) -> Column:
    return _host(url).endswith("wikipedia.org") & _path(url).contains("/wiki/")


def _is_arxiv(url: Column) -> Column:
    return _mentions(url, "arxiv.org")


def _is_hub_dataset(url: Column) -> Column:
    return _mentions(url, "huggingface.co/datasets/")


def _is_hub_repo(url: Column) -> Column:
    return _mentions(url, "huggingface.co/") & ~_mentions(url, "datasets/")


def _is_github(url: Column) -> Column:
    return _mentions(url, "github.com")


def url_kind(source: Column) -> Column:
    """One of wikipedia, arxiv, hub_repo, hub_dataset, github, web, file."""
    url = with_scheme(source)
    return (
        F.when(source.isNull(), F.lit(None))
        .when(~has_host(url) & ~source.contains("/"), "file")
        .when(_is_wikipedia(url), "wikipedia")
        .when(_is_arxiv(url), "arxiv")
        .when(_is_hub_repo(url), "hub_repo")
        .when(_is_hub_dataset(url), "hub_dataset")
        .when(_is_github(url), "github")
        .otherwise("web")
    )


def wikipedia_title(url: Column) -> Column:
    """The decoded page title, with spaces for underscores."""
    path = _path(url)
    at = F.instr(path, "/wiki/")
    tail = F.when(at > 0, F.substr(path, at + len("/wiki/"))).otherwise(path)
    # Percent-decoding that, unlike form decoding, keeps "+" and stray "%".
    safe = F.regexp_replace(tail, r"%(?![0-9A-Fa-f]{2})", "%25")
    safe = F.replace(safe, F.lit("+"), F.lit("%2B"))
    return F.replace(F.try_url_decode(safe), F.lit("_"), F.lit(" "))


def arxiv_id(url: Column) -> Column:
    return F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)


def hub_repo(url: Column) -> Column:
    """What follows the host up to its next mention, or empty text."""
    return F.btrim(
        F.coalesce(F.get(F.split(url, r"huggingface\.co/"), F.lit(1)), F.lit("")),
        F.lit("/"),
    )


def hub_dataset(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?is)huggingface\.co/datasets/(.*)", 1)
    return F.when(_is_hub_dataset(url), F.rtrim(found, F.lit("/")))


def _github_parts(url: Column) -> Column:
    tail = F.regexp_extract(F.lower(url), r"(?s)github\.com/(.*)", 1)
    return F.split(F.rtrim(tail, F.lit("/")), "/")


def github_repo(url: Column) -> Column:
    """``owner/repository`` in lower case, NULL when the URL names none."""
    parts = _github_parts(url)
    both = F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    return F.when(F.size(parts) >= 2, both)


def github_branch(url: Column) -> Column:
    branch = F.regexp_extract(F.lower(url), r"(?s)^.*?tree/([^/]*)", 1)
    named = F.when(_mentions(url, "tree/"), branch).otherwise(F.lit("main"))
    return F.when(github_repo(url).isNotNull(), named)


def extracted_name(source: Column) -> Column:
    """Name of the text file made from a source."""
    url = with_scheme(source)
    last = F.substring_index(_path(url), "/", -1)
    repo = F.concat_ws(
        "_", F.replace(github_repo(url), F.lit("/"), F.lit("_")), github_branch(url)
    )
    name = (
        F.when(_is_wikipedia(url), wikipedia_title(url))
        .when(_is_arxiv(url), F.concat(F.lit("arxiv_"), arxiv_id(url)))
        .when(_is_hub_dataset(url), F.replace(hub_dataset(url), F.lit("/"), F.lit("_")))
        .when(_is_github(url) & github_repo(url).isNotNull(), repo)
        .otherwise(last)
    )
    web = F.when(name == "", F.lit("webpage")).otherwise(name)
    stem = F.regexp_replace(source, r"(?<=[^.])\.[^.]*$", "")
    chosen = F.when(url_kind(source) == "file", stem).otherwise(web)
    return F.concat(chosen, F.lit("_extracted.txt"))
