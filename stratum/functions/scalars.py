"""Scalar column functions (inventory B1 to B30)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of the two hash recipes, and what stands for null in the second.
HASH_SEPARATOR, SURROGATE_SEPARATOR, SURROGATE_NULL = "||", "-", "_dbt_utils_surrogate_key_null_"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(*cols: str | Column) -> Column:
    """B1: MD5 of the columns as text, null as empty, joined by two pipes (so null and empty hash alike)."""
    return F.md5(F.concat_ws(HASH_SEPARATOR, *(F.coalesce(col(c).cast("string"), F.lit("")) for c in cols)))


def hashdiff(*cols: str | Column) -> Column:
    """B2: change hash; the recipe of :func:`hash_key` over a row's descriptive columns."""
    return hash_key(*cols)


def surrogate_key(*cols: str | Column) -> Column:
    """The second source's recipe; null and empty differ. Never mix it with :func:`hash_key`."""
    return F.md5(F.concat_ws(SURROGATE_SEPARATOR, *(F.coalesce(col(c).cast("string"), F.lit(SURROGATE_NULL)) for c in cols)))


def sap_date(c: str | Column) -> Column:
    """YYYYMMDD text to a date; null unless it has eight characters that form a date."""
    return F.when(F.length(col(c)) == 8, F.try_to_timestamp(col(c), F.lit("yyyyMMdd")).cast("date"))


def typed(c: str | Column, to: str) -> Column:
    """Cast that gives null where the text does not fit."""
    return col(c).try_cast(to)


def with_load_meta(df: DataFrame, source: str, load_ts: str | Column) -> DataFrame:
    """record_source and load_date; the load time is a parameter, never the clock."""
    ts = F.lit(load_ts).cast("timestamp") if isinstance(load_ts, str) else load_ts
    return df.withColumn("record_source", F.lit(source)).withColumn("load_date", ts)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Code names to business names; others stay."""
    return df.withColumnsRenamed(dict(mapping))


def decode(c: str | Column, mapping: Mapping, default: str | Column | None = None) -> Column:
    """Value to label, else the default."""
    pairs = iter(mapping.items())
    key, label = next(pairs)
    out = F.when(col(c) == F.lit(key), F.lit(label))
    for key, label in pairs:
        out = out.when(col(c) == F.lit(key), F.lit(label))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def decode_groups(c: str | Column, groups: Mapping[str, Sequence], default: str | None = None) -> Column:
    """Label by the list that holds the value."""
    out = None
    for label, values in groups.items():
        hit = col(c).isin(*values)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def decode_like(c: str | Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None = None) -> Column:
    """Label of the first rule one of whose LIKE patterns matches."""
    out = None
    for patterns, label in rules:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | col(c).like(p)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def band(c: str | Column, edges: Sequence[float], labels: Sequence[str], null_label: str | None = None) -> Column:
    """labels[i] below edges[i], the last label from the last edge on."""
    out = F.when(col(c).isNull(), F.lit(null_label))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(col(c) < edge, F.lit(label))
    return out.otherwise(F.lit(labels[len(edges)]))


def health(c: str | Column, green: float, yellow: float, higher_is_better: bool = True) -> Column:
    """GREEN, YELLOW or RED by two thresholds; null is RED."""
    test = (lambda t: col(c) >= t) if higher_is_better else (lambda t: col(c) <= t)
    return F.when(test(green), "GREEN").when(test(yellow), "YELLOW").otherwise("RED")


def signed_qty(qty: str | Column, code: str | Column, inbound: Sequence, outbound: Sequence) -> Column:
    """Plus for inbound codes, minus for outbound, else 0."""
    return F.when(col(code).isin(*inbound), col(qty)).when(col(code).isin(*outbound), -col(qty)).otherwise(F.lit(0).cast("double"))


def days_between(a: str | Column, b: str | Column) -> Column:
    """Days from a to b; null if either is."""
    return F.datediff(col(b), col(a))


def age_days(c: str | Column, as_of: str | date | Column) -> Column:
    """Days from the column to the as-of date."""
    return F.datediff(as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date"), col(c))


def month_diff(a: str | Column, b: str | Column) -> Column:
    """Month boundaries from a to b (31 January to 1 February is 1)."""
    return (F.year(col(b)) - F.year(col(a))) * 12 + F.month(col(b)) - F.month(col(a))


def within_days(a: str | Column, b: str | Column, n: int) -> Column:
    """A no later than n days after b."""
    return col(a) <= F.date_add(col(b), n)


def in_month_window(d: str | Column, start: str | Column, n: int) -> Column:
    """D in [start, start + n months)."""
    return (col(d) >= col(start)) & (col(d) < F.add_months(col(start), n))


def period(c: str | Column, unit: str) -> Column:
    """First day of the month, quarter or year."""
    return F.date_trunc(unit, col(c)).cast("date")


def date_parts(c: str | Column, prefix: str = "") -> list[Column]:
    """Calendar columns of a date; day_of_week counts from Sunday as 0."""
    d = col(c)
    name = lambda x: f"{prefix}{x}"
    return [
        F.year(d).alias(name("year")),
        F.quarter(d).alias(name("quarter")),
        F.month(d).alias(name("month")),
        F.dayofmonth(d).alias(name("day")),
        (F.dayofweek(d) - 1).alias(name("day_of_week")),
        F.weekofyear(d).alias(name("week")),
        F.date_format(d, "yyyy-MM").alias(name("year_month")),
        F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias(name("year_quarter")),
        F.lpad(F.month(d).cast("string"), 2, "0").alias(name("month_text")),
        F.dayofweek(d).isin(1, 7).alias(name("is_weekend")),
    ]


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double; null where den is 0 or null."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def pct(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """Percentage, rounded; null where den is 0 or null."""
    return F.round(100 * ratio(num, den), scale)


def within_pct(a: str | Column, b: str | Column, tolerance: float) -> Column:
    """B differs from a by less than the share of a; false where a is not positive or either is null."""
    return F.when((col(a) > 0) & (F.abs(col(a) - col(b)) / col(a) < tolerance), True).otherwise(False)


def or_bucket(c: str | Column, bucket) -> Column:
    """Null to a bucket value."""
    return F.coalesce(col(c), F.lit(bucket))


def is_present(c: str | Column) -> Column:
    """Neither null nor empty."""
    return col(c).isNotNull() & (col(c).cast("string") != "")


def concat_key(*cols: str | Column) -> Column:
    """The columns as text end to end; null if any is."""
    return F.concat(*(col(c).cast("string") for c in cols))


def strip_prefix(c: str | Column, prefix: str) -> Column:
    """The text after the prefix; unchanged where it does not start so."""
    return F.when(col(c).startswith(prefix), F.substring(col(c), len(prefix) + 1, 1 << 30)).otherwise(col(c))


def format_kpi(value: str | Column, unit: str, state: str | Column, digits: int = 1) -> Column:
    """Value, unit and health in brackets, such as ``91.9% [GREEN]``."""
    return F.concat(F.format_string(f"%.{digits}f", col(value).cast("double")), F.lit(f"{unit} ["), col(state), F.lit("]"))


_DATE_NAME = re.compile(r"(_date|_at|_ts|_utc|date)$|^[A-Z]*(DAT|DT|DATE)[A-Z0-9]?$")


def is_date_name(name: str, blocked: Sequence[str] = ()) -> bool:
    """Whether a column's name says that it holds dates."""
    return name not in blocked and bool(_DATE_NAME.search(name))
