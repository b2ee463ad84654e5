"""JSON and list functions (inventory I1 to I6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalars import col


def json_scalar(c: str | Column, path: str) -> Column:
    """The scalar at a path, as text."""
    return F.get_json_object(col(c), path)


def json_element(c: str | Column, schema: str, i: int) -> Column:
    """Element i of a JSON array with the element schema; null beyond its end."""
    return F.get(F.from_json(col(c), f"array<{schema}>"), F.lit(i))


def json_rows(df: DataFrame, c: str, schema: str, position: str = "pos", element: str = "element") -> DataFrame:
    """A row for each element of a JSON array, with its position; rows without elements stay, with nulls."""
    return df.select("*", F.posexplode_outer(F.from_json(F.col(c), f"array<{schema}>")).alias(position, element))


def list_values(c: str | Column) -> Column:
    """A comma list's values, trimmed and lower-cased."""
    return F.transform(F.split(F.lower(col(c)), ","), lambda x: F.trim(x))


def list_has(c: str | Column, x: str | Column) -> Column:
    """I4: whether a comma list holds the value, whatever its case."""
    return F.array_contains(list_values(c), F.lower(F.lit(x)) if isinstance(x, str) else F.lower(x))


def to_payload(*cols: str) -> Column:
    """The columns as one JSON object."""
    return F.to_json(F.struct(*cols))


def list_rows(df: DataFrame, c: str, name: str = "item") -> DataFrame:
    """A row for each value of a comma list, trimmed; empty values go."""
    return df.select("*", F.explode(F.transform(F.split(F.col(c), ","), lambda x: F.trim(x))).alias(name)).filter(F.col(name) != "")
