"""Rule-based augmentation by column type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text mark and the width of the noise.
TEXT_SUFFIX = " (augmented)"
NOISE = 0.1

_HEX_DIGITS = 8


def unit_noise(row_id: Column, column: str, seed: int) -> Column:
    """A repeatable number in [0, 1) per row and column, from an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{column}|"), row_id.cast("string")))
    number = F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("double")
    return number / float(16**_HEX_DIGITS)


def augment(df: DataFrame, *, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Mark text and scale 64-bit numbers by up to ten percent either way.

    Scaled integers become doubles. Other types, NULLs and the id stay.
    """

    def changed(field: T.StructField) -> Column:
        value = F.col(field.name)
        if field.name == row_id:
            return value
        if isinstance(field.dataType, T.StringType):
            return F.concat(value, F.lit(TEXT_SUFFIX)).alias(field.name)
        if isinstance(field.dataType, (T.LongType, T.DoubleType)):
            noise = unit_noise(F.col(row_id), field.name, seed) * (2 * NOISE) - NOISE
            return (value.cast("double") * (1 + noise)).alias(field.name)
        return value

    return df.select(*[changed(f) for f in df.schema.fields])
