"""Column roles: what an amplified row copies and what it gets generated."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.functions.text import python_dict

STATIC, REFERENCE, DYNAMIC = "static", "reference", "dynamic"

# Roles by column name; every other column is dynamic.
DEFAULT_ROLES = {"task": STATIC, "instruction": STATIC, "command": REFERENCE}
EARLIER_ROLES = {"command_description": STATIC, "command": REFERENCE}


def default_roles(columns: Iterable[str], *, earlier: bool = False) -> dict[str, str]:
    known = EARLIER_ROLES if earlier else DEFAULT_ROLES
    return {c: known.get(c, DYNAMIC) for c in columns}


def check_roles(df: DataFrame, roles: Mapping[str, str]) -> None:
    """Fail on roles that do not exist and on columns that do not."""
    for column, role in roles.items():
        if role not in (STATIC, REFERENCE, DYNAMIC):
            raise ValueError(f"unknown role {role!r} of column {column!r}")
        if column not in df.columns:
            raise ValueError(f"column {column!r} has a role but is not in the table")


def columns_with(roles: Mapping[str, str], *wanted: str) -> list[str]:
    return [c for c, role in roles.items() if role in wanted]


def role_columns(df: DataFrame, roles: Mapping[str, str], keys: Iterable[str]) -> DataFrame:
    """Keep the keys and the columns that have a role, in role order."""
    check_roles(df, roles)
    return df.select(*keys, *roles)


def reference_map(roles: Mapping[str, str]) -> Column:
    """The reference columns of a row as a map from name to value."""
    names = columns_with(roles, REFERENCE)
    pairs = [part for c in names for part in (F.lit(c), F.col(c).cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def reference_text(df: DataFrame, roles: Mapping[str, str]) -> Column:
    """The reference columns as a prompt shows them."""
    names = columns_with(roles, REFERENCE)
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return python_dict({c: F.col(c) for c in names}, text)
