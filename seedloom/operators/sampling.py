"""Exact-size, repeatable samples and the list of seed datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DIGITS = 4  # hex digits per histogram: 65,536 buckets
_FEW = 10_000


def sample_size(total: int, rate: float) -> int:
    """Rows a rate in percent stands for; rates outside 0-100 are clamped."""
    rate = min(max(rate, 0), 100)
    return int(total * (rate / 100))


def _next_digits(keys: DataFrame, prefix: str) -> list[tuple[str, int]]:
    """Rows per next four hex digits of the digest: at most 65,536 counts."""
    digits = F.substring("digest", len(prefix) + 1, _DIGITS).alias("digits")
    counts = keys.groupBy(digits).agg(F.count(F.lit(1)).alias("rows"))
    return [tuple(r) for r in counts.orderBy("digits").collect()]


def _nth_key(keys: DataFrame, n: int, counts: list[tuple[str, int]]) -> tuple[str, object]:
    """The n-th smallest (digest, id), by narrowing a digest prefix."""
    prefix = ""
    while True:
        for digits, rows in counts:
            if n <= rows:
                break
            n -= rows
        prefix += digits
        keys = keys.filter(F.col("digest").startswith(prefix))
        if rows <= _FEW:
            last = keys.orderBy("digest", "id").limit(n).collect()[-1]
            return last["digest"], last["id"]
        if len(prefix) == 32:
            raise ValueError("the id column repeats a value too often to sample by it")
        counts = _next_digits(keys, prefix)


def sample_rows(
    df: DataFrame,
    *,
    rate: float = 100.0,
    size: int | None = None,
    seed: int = 42,
    row_id: str = "row_id",
    use_all: bool = False,
) -> DataFrame:
    """Exactly ``size`` rows (or ``rate`` percent) without replacement.

    Rows are ranked by the MD5 digest of seed and id, which must be unique.
    The rank of the last row is found from digest counts over the id column
    alone; the sample itself is then a plain filter on the table.
    """
    if use_all:
        return df
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))
    keys = df.select(digest.alias("digest"), F.col(row_id).alias("id"))
    counts = _next_digits(keys, "")
    total = sum(rows for _, rows in counts)
    size = sample_size(total, rate) if size is None else size
    if size <= 0:
        return df.limit(0)
    if size >= total:
        return df
    last_digest, last_id = _nth_key(keys, size, counts)
    limit = F.struct(F.lit(last_digest), F.lit(last_id).cast(df.schema[row_id].dataType))
    return df.filter(F.struct(digest, F.col(row_id)) <= limit)
