"""Exact quantiles without holding a column's values (E11): values close to the wanted ranks are estimated, counted, and only what lies between them is sorted."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are sorted together (or counted by value in one buffer) at most.
SORTED = 1_000_000
#: Entries of the sketch that the cuts come from, whose ranks are off by one entry at most; a wanted rank is cut off two entries to either side.
SKETCH = 2_000


def _number(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _real(c: str) -> Column:
    """The number, or null for NaN (``isnan`` of null is false)."""
    return F.when(~F.isnan(_number(c)), _number(c))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _between(c: str, low: float | None, high: float | None) -> Column:
    """Whether a value lies between two cuts, neither included; without an upper one, all but NaN are below."""
    v = _number(c)
    above = F.lit(True) if low is None else v > low
    return above & (~F.isnan(v) if high is None else v < high)


def _cuts(df: DataFrame, wanted: Mapping[str, Sequence[int]], n: Mapping[str, int]) -> dict[str, list[float]]:
    """Ascending cuts of each column: estimates on either side of every wanted rank, and its least value and its middle, so that a range of unlike values is parted in any case."""
    near = {c: sorted({min(1.0, max(0.0, rank / n[c] + d / SKETCH)) for rank in ranks for d in (-2, 2)}) for c, ranks in wanted.items()}
    row = df.agg(*(x.alias(f"{k}{i}") for i, (c, at) in enumerate(near.items()) for k, x in (("q", F.percentile_approx(_real(c), F.array(*map(F.lit, at)), SKETCH)), ("a", F.min(_real(c))), ("b", F.max(_real(c)))))).first()
    return {c: sorted({x for x in [*row[f"q{i}"], row[f"a{i}"], row[f"a{i}"] / 2 + row[f"b{i}"] / 2] if not math.isnan(x)}) for i, c in enumerate(near)}


def _at_ranks(df: DataFrame, wanted: Mapping[str, Sequence[int]], n: Mapping[str, int], most: int) -> dict[tuple[str, int], float]:
    """The value of each wanted rank (from 0) of each column in ascending order, of its ``n`` values that are numbers; NaN comes after them."""
    found = {(c, rank): math.nan for c, ranks in wanted.items() for rank in ranks if rank >= n[c]}
    wanted = {c: some for c, ranks in wanted.items() if (some := [rank for rank in ranks if rank < n[c]])}
    if not wanted:
        return found
    cuts = _cuts(df, wanted, n)
    # Each comparison is an aggregate of its own: Spark compiles them apart, however many there are.
    row = df.agg(*(F.count_if(x).alias(f"{k}{i}_{j}") for i, c in enumerate(wanted) for j, cut in enumerate(cuts[c]) for k, x in (("a", _number(c) < cut), ("b", _number(c) <= cut)))).first()
    sort: dict[tuple[str, float | None, float | None], dict[int, int]] = {}
    size: dict[tuple[str, float | None, float | None], int] = {}
    for i, (c, ranks) in enumerate(wanted.items()):
        below, upto = ([row[f"{k}{i}_{j}"] for j in range(len(cuts[c]))] for k in "ab")
        for rank in ranks:
            j = bisect_right(upto, rank)
            if j < len(upto) and below[j] <= rank:
                found[c, rank] = cuts[c][j]
                continue
            first = upto[j - 1] if j else 0
            place = (c, cuts[c][j - 1] if j else None, cuts[c][j] if j < len(upto) else None)
            size[place] = (below[j] if j < len(upto) else n[c]) - first
            sort.setdefault(place, {})[rank - first] = rank
    for place, offsets in sort.items():
        if size[place] > most:  # a range of very many rows is cut again
            more = _at_ranks(df.filter(_between(*place)).select(f"`{place[0]}`"), {place[0]: sorted(offsets)}, {place[0]: size[place]}, most)
            found |= {(place[0], rank): more[place[0], offset] for offset, rank in offsets.items()}
    small = [place for place in sort if size[place] <= most]
    if small:
        number = lambda c: reduce(lambda a, x: a.when(_between(*x[1]), x[0]), ((k, p) for k, p in enumerate(small) if p[0] == c), F.when(F.lit(False), -1))
        cells = df.filter(_any([_between(*place) for place in small])).select(F.inline(F.array(*(F.struct(number(c).alias("range"), _number(c).alias("v")) for c in dict.fromkeys(p[0] for p in small))))).filter("range is not null")
        ranked = cells.withColumn("r", F.row_number().over(Window.partitionBy("range").orderBy("v")))
        chosen = _any([(F.col("range") == k) & (F.col("r") - 1).isin(list(sort[place])) for k, place in enumerate(small)])
        found |= {(small[r.range][0], sort[small[r.range]][r.r - 1]): r.v for r in ranked.filter(chosen).collect()}
    return found


def exact_quantiles(df: DataFrame, columns: Sequence[str], ps: Sequence[float], most: int = SORTED) -> dict[str, list[float | None]]:
    """Each column's quantiles with linear interpolation, as ``percentile`` gives them; null where a column has no values.

    Tables of up to ``most`` rows are counted by value in one buffer, as that holds no more; of larger ones no task
    holds or sorts more than ``most`` rows of a column, and only counts and the wanted values come to the driver.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    n = df.agg(F.count("*").alias("rows"), *(x.alias(f"{k}{i}") for i, c in enumerate(columns) for k, x in (("c", F.count(_number(c))), ("n", F.count(_real(c)))))).first()
    if n["rows"] <= most:
        row = df.agg(*(F.percentile(_number(c), F.array(*map(F.lit, ps))).alias(f"c{i}") for i, c in enumerate(columns))).first()
        return {c: list(row[f"c{i}"] or [None] * len(ps)) for i, c in enumerate(columns)}
    places = {c: [(n[f"c{i}"] - 1) * p for p in ps] for i, c in enumerate(columns) if n[f"c{i}"]}
    found = _at_ranks(df, {c: sorted({r for x in at for r in (math.floor(x), math.ceil(x))}) for c, at in places.items()}, {c: n[f"n{i}"] for i, c in enumerate(columns)}, most) if places else {}

    def between(c: str, x: float) -> float:
        low, high = math.floor(x), math.ceil(x)
        a, b = found[c, low], found[c, high]
        return a if low == high or a == b else (high - x) * a + (x - low) * b

    return {c: [between(c, x) for x in places[c]] if c in places else [None] * len(ps) for c in columns}


def quantile_rows(df: DataFrame, columns: Sequence[str], names: Mapping[str, float], most: int = SORTED) -> DataFrame:
    """column_name and a column for each named quantile."""
    found = exact_quantiles(df, columns, list(names.values()), most)
    schema = "column_name string, " + ", ".join(f"`{n}` double" for n in names)
    return df.sparkSession.createDataFrame([(c, *q) for c, q in found.items()], schema)
