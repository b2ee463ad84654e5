"""Mergeable distinct sketches (J13, J20, E13): a column is sketched once, parts are united, and a second profile reads only what is new.

A HyperLogLog sketch of 2**lg registers has a relative standard error of about 1.04 / sqrt(2**lg): 1.6 % for
the default of 12. What the sketches rule out is ruled out with a margin of several errors; the rest is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 12
#: Relative standard error of an estimate, and how many of them a decision leaves as a margin.
ERROR, MARGIN = 1.04 / math.sqrt(1 << LG), 5


def _joined(columns: Sequence[str]) -> Column:
    """One text for a tuple without nulls, else null: the parts with their lengths, so that unlike tuples give unlike texts."""
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    return text[0] if len(text) == 1 else F.concat(*(x for t in text for x in (F.length(t).cast("string"), F.lit(":"), t)))


def sketched(df: DataFrame, table: str, columns: Sequence[str | Sequence[str]], part: str = "") -> DataFrame:
    """table_name, part, column_name, rows, present and sketch: a row for each column (or tuple of columns, its names joined by commas), from one pass.

    ``part`` names the rows that were read (a partition, a day): parts of a table are kept side by side and united by :func:`united`.
    """
    tuples = [[c] if isinstance(c, str) else list(c) for c in columns]
    cells = [F.struct(F.lit(",".join(t)).alias("column_name"), F.count("*").alias("rows"), F.count(_joined(t)).alias("present"), F.hll_sketch_agg(_joined(t), LG).alias("sketch")) for t in tuples]
    return df.agg(F.array(*cells).alias("cells")).select(F.lit(table).alias("table_name"), F.lit(part).alias("part"), F.inline("cells"))


def united(stored: DataFrame) -> DataFrame:
    """table_name, column_name, rows, present and estimate of whole tables from the sketches of their parts; no table is read."""
    sketch = F.hll_union_agg("sketch")
    return stored.groupBy("table_name", "column_name").agg(F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.hll_sketch_estimate(sketch).alias("estimate"))


def refreshed(stored: DataFrame, df: DataFrame, table: str, columns: Sequence[str | Sequence[str]], parts: Mapping[str, str]) -> DataFrame:
    """``stored`` with sketches of the parts (name to condition) that it lacks; only these rows of ``df`` are read."""
    known = {r["part"] for r in stored.filter(F.col("table_name") == table).select("part").distinct().collect()}  # as many rows as parts
    for name, condition in parts.items():
        if name not in known:
            stored = stored.unionByName(sketched(df.filter(condition), table, columns, name))
    return stored


def able_keys(stored: DataFrame, error: float = ERROR, margin: float = MARGIN) -> DataFrame:
    """column_name of the columns and tuples that may be keys: without nulls, and as many estimated values as rows within the margin."""
    return united(stored).filter((F.col("present") == F.col("rows")) & (F.col("rows") > 0) & (F.col("estimate") >= F.col("rows") * (1 - margin * error))).select("table_name", "column_name", "rows", "estimate")


def confirmed_keys(df: DataFrame, candidates: DataFrame) -> list[str]:
    """Those of the candidate columns and tuples whose values are unique, counted exactly; only candidates are counted."""
    out = []
    for name in sorted((r["column_name"] for r in candidates.collect()), key=lambda n: (n.count(","), n)):
        columns = name.split(",")
        if not df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1").take(1):
            out.append(name)
    return out
