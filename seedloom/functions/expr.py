"""Small helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    Catalyst may copy an expensive expression into each place that uses it,
    even into a lambda that runs once per array element. A lambda variable
    always holds an evaluated value.
    """
    return F.transform(F.array(value), body)[0]


def whole_div(value: Column, by: int) -> Column:
    """Integer division that stays exact for any 64-bit value."""
    return F.call_function("div", value, F.lit(by))
