"""URL filters whose list entries come and go.

Dated list events become validity intervals per pattern. Every capture is
looked up under its host, the parent domains and the leading parts of its
path, and joined as of its fetch time to what was in force then; the most
specific entry decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.llm.common import few_rows
from seedloom.sources.staging import stage

# Up to so many intervals (about 60 bytes each) are broadcast.
FEW_INTERVALS = 200_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(?::[0-9]*)?$", ""))


def _segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def intervals(events: DataFrame) -> DataFrame:
    """``pattern, blocks, since, until``: what each list event holds for, until the next.

    ``events`` has ``pattern`` (a host, or host and leading path), ``action``
    (block, allow or remove) and ``day``. Of several events of a pattern on one
    day the first in that order counts; rows with a null are passed over. One
    row per pattern and day is all that a window sees of a pattern.
    """
    whole = events.filter(F.col("pattern").isNotNull() & F.col("day").isNotNull())
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 2)
    daily = whole.filter(rank.isNotNull()).groupBy("pattern", "day").agg(F.min(rank).alias("rank"))
    then = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    held = daily.withColumn("until", then).filter("rank < 2")
    return held.select("pattern", (F.col("rank") == 0).alias("blocks"), F.col("day").alias("since"), "until")


def _candidates(url: Column, deepest: int) -> Column:
    """Patterns that can match a URL, from its parent domains to its path."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    depth = F.least(F.size(_segments(url)), F.lit(deepest))
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    paths = F.transform(steps, lambda j: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(_segments(url), 1, j), "/")))
    return F.array_distinct(F.concat(hosts, paths))


_ADDED = ("host", "n_active", "entry", "since", "blocked")


def filter_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Captures with ``host``, the entry in force and whether they are blocked.

    ``captures`` has ``url`` and ``fetched`` (a date) beside other columns.
    Adds ``n_active`` (entries in force that match), ``entry`` and ``since`` of
    the most specific, and ``blocked``: longer paths go before longer hosts. A
    null url or fetch date matches nothing. Columns of captures with the name of
    an added one are replaced by it; all others stay as they are. An empty list
    blocks nothing, and repeated rows get the same result each.

    Equal captures are looked up once. The list is broadcast while it is small;
    beyond that it is joined by pattern, and a pattern that many captures share
    is split by the join.
    """
    held = stage(intervals(events), "intervals")
    depth = F.max(F.size(F.split("pattern", "/")) - 1)
    deepest = held.agg(depth).first()[0] or 0
    if few_rows(held, FEW_INTERVALS):
        held = F.broadcast(held)
    once = captures.select("url", "fetched").filter("url is not null and fetched is not null").distinct()
    asked = once.select("url", "fetched", F.explode(_candidates(F.col("url"), deepest)).alias("pattern"))
    in_force = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    found = asked.join(held, "pattern").filter(in_force)
    # A pattern has one interval at a time, so at most one row per candidate.
    specific = F.struct(
        F.size(F.split("pattern", "/")).alias("path"), F.size(F.split("pattern", r"\.")).alias("labels"), "pattern", "blocks", "since"
    )
    decided = found.groupBy("url", "fetched").agg(F.count(F.lit(1)).alias("n_active"), F.max(specific).alias("top"))
    # The capture travels as one struct, so that none of its names can clash.
    carried = captures.select(F.col("url").alias("u"), F.col("fetched").alias("f"), F.struct(*[f"`{c}`" for c in captures.columns]).alias("capture"))
    decided = decided.select(F.col("url").alias("u"), F.col("fetched").alias("f"), F.struct("n_active", "top").alias("decided"))
    joined = carried.join(decided, ["u", "f"], "left")
    kept = [F.col(f"capture.`{c}`").alias(c) for c in captures.columns if c.lower() not in _ADDED]
    top = F.col("decided.top")
    return joined.select(
        *kept,
        F.coalesce(host_of(F.col("u")), F.lit("")).alias("host"),
        F.coalesce("decided.n_active", F.lit(0)).cast("long").alias("n_active"),
        top["pattern"].alias("entry"),
        top["since"].alias("since"),
        F.coalesce(top["blocks"], F.lit(False)).alias("blocked"),
    )


# --- dates and a list for tables that have neither -----------------------------


def _part(text: Column, start: int) -> Column:
    """A number below 65,536 from the digest of a text."""
    return F.conv(F.substring(F.md5(text), start, 4), 16, 10).cast("int")


def dated(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date within the year, by the digest of their id."""
    day = F.pmod(_part(F.col("page_id").cast("string"), 1), F.lit(366))
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def derived_events(pages: DataFrame) -> DataFrame:
    """List events for hosts, their parent domains and first path parts found in ``pages``.

    Digests choose which are listed, when, and when they are lifted or allowed.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host"), _segments(F.col("url")).alias("s")).filter("host <> ''")
    parent = F.regexp_replace("host", r"^[^.]+\.(?=[^.]+\.[^.]+$)", "")
    first = F.when(F.size("s") > 0, F.concat(F.col("host"), F.lit("/"), F.col("s")[0]))
    known = hosts.select(F.explode(F.array("host", parent, first)).alias("pattern")).filter("pattern is not null").distinct()
    pattern = F.col("pattern")
    since = F.pmod(_part(pattern, 5), F.lit(240))
    start = F.lit("2024-01-01").cast("date")
    lifted = F.pmod(_part(pattern, 9), F.lit(3)) == 0
    action = F.when(F.pmod(_part(pattern, 13), F.lit(5)) == 0, "allow").otherwise("block")
    first_event = F.struct(action.alias("action"), F.date_add(start, since).alias("day"))
    second = F.struct(F.lit("remove").alias("action"), F.date_add(start, since + 60).alias("day"))
    third = F.struct(F.lit("block").alias("action"), F.date_add(start, since + 100).alias("day"))
    listed = known.filter(F.pmod(_part(pattern, 1), F.lit(3)) == 0)
    events = F.when(lifted, F.array(first_event, second, third)).otherwise(F.array(first_event))
    return listed.select("pattern", F.inline(events))
