"""Vault loading and version resolution (inventory C1 to C14, B7, B8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.scalars import hash_key, hashdiff, sap_date, surrogate_key, typed, with_load_meta


@dataclass
class StagingSpec:
    """Hash keys by name, text dates, casts and change-hash columns of one source."""

    source: str
    keys: Mapping[str, Sequence[str]] = field(default_factory=dict)
    dates: Sequence[str] = ()
    casts: Mapping[str, str] = field(default_factory=dict)
    change: Sequence[str] = ()
    recipe: str = "pipes"


def stage(df: DataFrame, spec: StagingSpec, load_ts: str | Column) -> DataFrame:
    """One select, row for row. Hashes are of the raw columns, before dates and casts."""
    recipe = {"pipes": hash_key, "surrogate": surrogate_key}[spec.recipe]
    columns = [F.col(c) if c not in spec.dates and c not in spec.casts else sap_date(c).alias(c) if c in spec.dates else typed(c, spec.casts[c]).alias(c) for c in df.columns]
    hashes = [recipe(*cols).alias(name) for name, cols in spec.keys.items()]
    change = [hashdiff(*spec.change).alias("hashdiff")] if spec.change else []
    return with_load_meta(df.select(*hashes, *columns, *change), spec.source, load_ts)


def stage_passthrough(df: DataFrame) -> DataFrame:
    """Staging for a table without a spec."""
    return df.select("*")


def _new(rows: DataFrame, existing: DataFrame | None, on: Sequence[str]) -> DataFrame:
    return rows if existing is None else rows.join(existing.select(*on).distinct(), list(on), "left_anti")


@dataclass
class HubSpec:
    """The hash key and the business key's columns with their new names."""

    key: str
    business: Mapping[str, str]


def load_hub(stage_df: DataFrame, existing: DataFrame | None, spec: HubSpec) -> DataFrame:
    """A row for each key that is not in ``existing``."""
    rows = stage_df.select(spec.key, *(F.col(c).alias(n) for c, n in spec.business.items()), "load_date", "record_source")
    return _new(rows.dropDuplicates([spec.key]), existing, [spec.key])


@dataclass
class LinkSpec:
    """Own key (from columns, or staged), parent keys, presence filter; a join with a second stage where keys meet only there."""

    key: str
    recipe: Sequence[str] = ()
    parents: Sequence[str] = ()
    where: str | None = None
    carried: Sequence[str] = ()


def load_link(stage_df: DataFrame, existing: DataFrame | None, spec: LinkSpec, other: DataFrame | None = None, on: Column | Sequence[str] | None = None) -> DataFrame:
    """Distinct relationships that are not in ``existing``."""
    rows = stage_df.join(other, on) if other is not None else stage_df
    rows = rows.filter(spec.where) if spec.where else rows
    own = hash_key(*spec.recipe).alias(spec.key) if spec.recipe else F.col(spec.key)
    return _new(rows.select(own, *spec.parents, *spec.carried, "load_date", "record_source").dropDuplicates([spec.key]), existing, [spec.key])


@dataclass
class SatSpec:
    """Parent key, child keys, payload; history=False keeps one row per key (merge)."""

    key: str
    payload: Mapping[str, str]
    child: Sequence[str] = ()
    where: str | None = None
    distinct: bool = False
    compare: str = "history"
    history: bool = True


def load_sat(stage_df: DataFrame, existing: DataFrame | None, spec: SatSpec) -> DataFrame:
    """Rows whose (key, child keys, hashdiff) was never stored; compare="latest" tests the newest version only.

    With ``history=False`` the result replaces ``existing`` and keeps one row per key.
    """
    rows = stage_df.filter(spec.where) if spec.where else stage_df
    names = {c: n for c, n in spec.payload.items() if c not in spec.child}
    rows = rows.select(spec.key, *spec.child, *(F.col(c).alias(n) for c, n in names.items()), "hashdiff", "load_date", "record_source")
    rows = rows.distinct() if spec.distinct else rows
    keys = [spec.key, *spec.child]
    if not spec.history:
        return merge(existing, rows, keys) if existing is not None else rows
    if existing is not None and spec.compare == "latest":
        existing = current_row(existing, keys, ["hashdiff"])
    return _new(rows, existing, [*keys, "hashdiff"])


def load_hwm(df: DataFrame, existing: DataFrame | None, column: str) -> DataFrame:
    """Rows later than the newest stored. Late arrivals are lost: prefer C1 or C5 where they can happen."""
    if existing is None:
        return df
    mark = existing.agg(F.max(column).alias("_mark"))
    return df.crossJoin(F.broadcast(mark)).filter(F.col("_mark").isNull() | (F.col(column) > F.col("_mark"))).drop("_mark")


def merge(existing: DataFrame, incoming: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Incoming rows replace stored ones with equal keys."""
    keys = [key] if isinstance(key, str) else list(key)
    return align_schema(existing.join(incoming.select(*keys).distinct(), keys, "left_anti"), incoming)


def align_schema(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; columns that one side lacks are null."""
    return a.unionByName(b, allowMissingColumns=True)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def current_by_max(sat: DataFrame, key: str | Sequence[str], ts: str = "load_date") -> DataFrame:
    """The newest rows per key; ties stay."""
    w = Window.partitionBy(*_keys(key)).orderBy(F.col(ts).desc())
    return sat.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def current_row(sat: DataFrame, key: str | Sequence[str], tiebreak: Sequence[str | Column] = (), ts: str = "load_date") -> DataFrame:
    """One newest row per key; the tiebreak decides between equal times."""
    w = Window.partitionBy(*_keys(key)).orderBy(F.col(ts).desc(), *tiebreak)
    return sat.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


dedupe_latest = current_row


def latest_snapshot(sat: DataFrame, ts: str = "load_date", snapshot: str = "global_max", key: str | Sequence[str] = ()) -> DataFrame:
    """Rows of the newest load only, or (per_key) the newest of every key, which later loads don't empty."""
    if snapshot == "per_key":
        return current_by_max(sat, key, ts)
    newest = sat.agg(F.max(ts).alias("_newest"))
    return sat.join(F.broadcast(newest), F.col(ts) == F.col("_newest")).drop("_newest")


def status_history(df: DataFrame, key: str, start: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """C14: with valid_to (the next start), sequence_no and reverse_no per key."""
    up = Window.partitionBy(key).orderBy(F.col(start), *tiebreak)
    down = Window.partitionBy(key).orderBy(F.col(start).desc(), *(F.col(c).desc() for c in tiebreak))
    return df.withColumn("valid_to", F.lead(start).over(up)).withColumn("sequence_no", F.row_number().over(up)).withColumn("reverse_no", F.row_number().over(down))
