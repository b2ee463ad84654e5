"""Source profiling (inventory J1 to J31): schemas are read on the driver, data in one pass a table."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.scalars import ratio, sap_date
from stratum.operators.quantile import quantile_rows
from stratum.operators.relational import pairs, sample_keys, share_of_total, top_groups, top_values

NUMERIC, INTEGRAL = (T.NumericType,), (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Shares of nulls below which a column is reliable, and of one of medium reliability.
HIGH_BELOW, MEDIUM_BELOW = 5.0, 25.0
#: Candidate keys whose tuples one job counts exactly: each multiplies the rows that it shuffles.
AT_ONCE = 4


def family(dtype: T.DataType) -> str:
    """Type family for key compatibility."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return "temporal" if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"


def rows_of(one: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A one-row aggregate named column\\0field as a row per column."""
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"`{c}\0{f}`").alias(f) for f in fields)) for c in columns))))


def _one_pass(df: DataFrame, columns: Sequence[str], fields: Mapping[str, object]) -> DataFrame:
    return rows_of(df.agg(*(make(c).alias(f"{c}\0{n}") for c in columns for n, make in fields.items())), columns, list(fields))


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, row_count, null_count, null_pct (6 digits), reliability."""
    out = _one_pass(df, sorted(columns or df.columns), {"row_count": lambda c: F.count("*"), "null_count": lambda c: F.count_if(F.col(c).isNull())})
    share = F.round(100 * F.coalesce(ratio("null_count", "row_count"), F.lit(0.0)), 6)
    out = out.withColumn("null_pct", share)
    return out.withColumn("reliability", F.when(F.col("null_pct") < HIGH_BELOW, "high").when(F.col("null_pct") < MEDIUM_BELOW, "medium").otherwise("low"))


def dimensions(df: DataFrame, cols: Sequence[str], null_strategy: str = "bucket", n: int = 10) -> DataFrame:
    """The n most frequent values of each column with their share; nulls as ``__NULL__`` or left out."""
    marked = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("__NULL__")).alias(c) if null_strategy == "bucket" else F.col(c).cast("string").alias(c) for c in cols))
    counts = top_values(marked, cols, n)
    counts = counts if null_strategy == "bucket" else counts.filter("value is not null")
    facts = _one_pass(marked, list(cols), {"rows": lambda c: F.count(c), "distinct_count": lambda c: F.countDistinct(c)})
    out = counts.join(F.broadcast(facts), "column_name")
    return out.withColumn("pct", F.round(100 * ratio("n", "rows"), 2)).select("column_name", "value", "n", "rank", "distinct_count", "pct")


def magnitude(df: DataFrame, measure: str, dim: str, decoder: DataFrame | None = None, n: int = 10) -> DataFrame:
    """The n largest sums by dimension with their share of those shown; labels from a (code, description) decoder."""
    out = top_groups(df, dim, measure, n)
    if decoder is not None:
        out = out.join(decoder.select(F.col("code").alias(dim), F.col("description").alias("label")), dim, "left")
    return out


def code_table(df: DataFrame, c: str, decoder: DataFrame | None = None, source: str = "none") -> DataFrame:
    """Code, description, description_source ('none' where nothing matches), n."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("code")).agg(F.count("*").alias("n"))
    if decoder is None:
        return counts.select("code", F.lit(None).cast("string").alias("description"), F.lit("none").alias("description_source"), "n")
    out = counts.join(decoder.select(F.col("code").cast("string"), "description"), "code", "left")
    return out.select("code", "description", F.when(F.col("description").isNull(), "none").otherwise(source).alias("description_source"), "n")


_CODE, _TEXT = re.compile(r"code|key|id$|status$|type$|art$", re.I), re.compile(r"desc|text|name|label|bez", re.I)


def find_decoders(frames: Mapping[str, DataFrame], most_rows: int = 500) -> list[tuple[str, str, str]]:
    """(table, code column, description column) of tables shaped like decoders."""
    out = []
    for name, df in frames.items():
        code = [c for c in df.columns if _CODE.search(c)]
        text = [c for c in df.columns if _TEXT.search(c) and c not in code]
        if 2 <= len(df.columns) <= 4 and code and text and df.limit(most_rows + 1).count() <= most_rows:
            out.append((name, code[0], text[0]))
    return out


def pick_code_column(df: DataFrame, least: int = 2, most: int = 50) -> str | None:
    """A text column of few values, code-like names first, then the fewest values."""
    columns = [f.name for f in df.schema.fields if family(f.dataType) == "string"]
    if not columns:
        return None
    counts = df.agg(*(F.countDistinct(c).alias(c) for c in columns)).first().asDict()
    able = [c for c in columns if least <= counts[c] <= most]
    return min(able, key=lambda c: (not _CODE.search(c), counts[c], c), default=None)


def numeric_columns(df: DataFrame, excluded: Sequence[str] = ("MANDT", "mandt")) -> list[str]:
    """J7."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in excluded]


def baseline(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """N, min, max, avg, stddev_pop, p25 and p75 of numeric columns; those without values are left out."""
    d = lambda c: F.col(c).cast("double")
    fields = {"n": lambda c: F.count(c), "min": lambda c: F.min(d(c)), "max": lambda c: F.max(d(c)), "avg": lambda c: F.avg(d(c)), "stddev_pop": lambda c: F.stddev_pop(d(c))}
    columns = list(columns or numeric_columns(df))
    out = _one_pass(df, columns, fields).filter("n > 0")
    return out.join(F.broadcast(quantile_rows(df, columns, {"p25": 0.25, "p75": 0.75})), "column_name")


def segment_thresholds(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Quartiles of numeric columns; constant ones and those without values are left out."""
    d = lambda c: F.col(c).cast("double")
    fields = {"n": lambda c: F.count(c), "stddev_pop": lambda c: F.stddev_pop(d(c))}
    columns = list(columns or numeric_columns(df))
    out = _one_pass(df, columns, fields).filter("n > 0 and stddev_pop > 0").select("column_name")
    return out.join(F.broadcast(quantile_rows(df, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75})), "column_name")


def temporal_coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last day, span, share of nulls, distinct months and estimated missing months per date column."""
    columns = list(columns or [f.name for f in df.schema.fields if family(f.dataType) == "temporal"])
    types = {f.name: f.dataType for f in df.schema.fields}
    d = lambda c: sap_date(c) if family(types[c]) == "string" else F.col(c).cast("date")
    fields = {"min_date": lambda c: F.min(d(c)), "max_date": lambda c: F.max(d(c)), "rows": lambda c: F.count("*"), "present": lambda c: F.count(d(c)), "months": lambda c: F.countDistinct(F.date_trunc("month", d(c)))}
    out = _one_pass(df, columns, fields).withColumn("span_days", F.datediff("max_date", "min_date"))
    gaps = F.greatest(F.lit(0), F.floor(F.col("span_days") / 30) + 1 - F.col("months"))
    return out.select("column_name", "min_date", "max_date", "span_days", F.round(100 * (1 - ratio("present", "rows")), 6).alias("null_pct"), "months", gaps.cast("long").alias("gap_months"))


def month_gaps(df: DataFrame, c: str) -> DataFrame:
    """The months between the first and the last that have no rows, exactly."""
    months = df.select(F.trunc(F.col(c).cast("date"), "MM").alias("month")).filter("month is not null").distinct()
    ends = months.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).join(months, "month", "left_anti")


def column_roles(df: DataFrame, dictionary: Mapping[str, str] | None = None) -> dict[str, str]:
    """Date, measure, key or attribute by the dictionary's type, else by the column's own."""
    fixed = {"DATS": "date", "DATE": "date", "TIMS": "date", "TIME": "date", "DEC": "measure", "QUAN": "measure", "CURR": "measure", "FLTP": "measure"}
    out = {}
    for f in df.schema.fields:
        kind = fixed.get((dictionary or {}).get(f.name, "").upper())
        if kind is None:
            kind = "date" if family(f.dataType) == "temporal" else "measure" if isinstance(f.dataType, (T.DecimalType, T.FractionalType)) else "key" if key_columns(df, {}, [f.name]) else "attribute"
        out[f.name] = kind
    return out


_KEY_NAME = re.compile(r"(_ID|_KEY|_NR|_NUM|KEY)$", re.I)


def key_columns(df: DataFrame, roles: Mapping[str, str] | None = None, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with the role key, else those named like one."""
    columns = list(columns or df.columns)
    return [c for c in columns if (roles or {}).get(c) == "key"] or [c for c in columns if _KEY_NAME.search(c)]


def find_primary_key(df: DataFrame, cols: Sequence[str] | None = None, client: str | None = None, widest: int = 4, most: int = 10, least_ratio: float = 0.999) -> list[str]:
    """The first of single columns, client pairs and composites whose tuples are unique and not null; [] if none.

    One pass gives every column's nulls and approximate distinct values: columns with nulls, and tuples whose values
    can't make as many combinations as there are rows, are out. The rest are counted exactly, a few at a time.
    """
    cols = list(cols if cols is not None else df.columns)[:most]
    levels = [[(c,) for c in cols]] + ([[(client, c) for c in cols if c != client]] if client in cols else [])
    levels += [list(itertools.combinations(cols, k)) for k in range(2, widest + 1)]
    facts = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)), *(F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(cols))).first()
    if not facts["rows"]:
        return []
    most_values = {c: 1.2 * facts[f"d{i}"] + 2 for i, c in enumerate(cols) if not facts[f"n{i}"]}  # ten standard errors above the estimate
    for level in levels:
        able = [combo for combo in level if all(c in most_values for c in combo) and math.prod(most_values[c] for c in combo) >= least_ratio * facts["rows"]]
        for at in range(0, len(able), AT_ONCE):
            part = able[at : at + AT_ONCE]
            r = df.agg(*(F.countDistinct(F.struct(*combo)).alias(f"d{i}") for i, combo in enumerate(part))).first()
            for i, combo in enumerate(part):
                if r[f"d{i}"] / facts["rows"] >= least_ratio:
                    return list(combo)
    return []


def foreign_key(a: DataFrame, b: DataFrame, key_a: str, key_b: str | None = None) -> DataFrame:
    """One row: distinct keys of a, those present in b, integrity and confidence (high from 95 %, medium from 80 %)."""
    mine = a.select(F.col(key_a).alias("k")).filter("k is not null").distinct()
    other = b.select(F.col(key_b or key_a).alias("k")).distinct().withColumn("hit", F.lit(1))
    out = mine.join(other, "k", "left").agg(F.count("*").alias("distinct_keys"), F.count("hit").alias("matched"))
    out = out.withColumn("integrity", F.round(ratio("matched", "distinct_keys"), 6))
    return out.withColumn("confidence", F.when(F.col("integrity") >= 0.95, "high").when(F.col("integrity") >= 0.80, "medium").otherwise("none"))


def relationship_shape(a: DataFrame, b: DataFrame, key_a: str, key_b: str | None = None) -> DataFrame:
    """one_to_one, many_to_one, one_to_many or many_to_many, by true duplication (two or more, and over 0.1 %)."""
    side = lambda df, k, p: df.filter(F.col(k).isNotNull()).agg(F.count("*").alias(f"{p}_rows"), F.countDistinct(k).alias(f"{p}_keys"))
    out = side(a, key_a, "left").crossJoin(side(b, key_b or key_a, "right"))
    many = lambda p: ((F.col(f"{p}_rows") - F.col(f"{p}_keys")) >= 2) & ((F.col(f"{p}_rows") - F.col(f"{p}_keys")) > 0.001 * F.col(f"{p}_rows"))
    return out.withColumn("shape", F.when(many("left") & many("right"), "many_to_many").when(many("left"), "many_to_one").when(many("right"), "one_to_many").otherwise("one_to_one"))


def sum_match_exact(header: DataFrame, detail: DataFrame, key: str, measure: str) -> DataFrame:
    """Header rows whose measure equals the sum of their details'."""
    sums = detail.groupBy(key).agg(F.sum(measure).alias("_sum"))
    return header.join(sums, key).agg(F.count("*").alias("compared"), F.count_if(F.col(measure) == F.col("_sum")).alias("matched"))


def find_bridges(edges: DataFrame) -> DataFrame:
    """Two-hop ways (from_table, bridge, to_table) over foreign keys (from_table, to_table) where no direct one exists."""
    a = edges.select("from_table", F.col("to_table").alias("bridge")).distinct()
    b = edges.select(F.col("from_table").alias("bridge"), "to_table").distinct()
    both = a.join(b, "bridge").filter("from_table <> to_table")
    return both.join(edges.select("from_table", "to_table").distinct(), ["from_table", "to_table"], "left_anti").select("from_table", "bridge", "to_table").distinct()


def grain_relationship(a: DataFrame, b: DataFrame, key: str, measure_a: str, measure_b: str, tolerance: float = 0.01) -> DataFrame:
    """Share of shared keys whose sums agree within the tolerance; high from 99 %, medium from 90 %."""
    x = a.groupBy(key).agg(F.sum(F.col(measure_a).cast("double")).alias("_a"))
    y = b.groupBy(key).agg(F.sum(F.col(measure_b).cast("double")).alias("_b"))
    close = F.abs(F.col("_a") - F.col("_b")) <= tolerance * F.abs(F.col("_a"))
    out = x.join(y, key).agg(F.count("*").alias("shared_keys"), F.count_if(close).alias("agreeing"))
    out = out.withColumn("match_rate", F.round(ratio("agreeing", "shared_keys"), 6))
    return out.withColumn("confidence", F.when(F.col("match_rate") >= 0.99, "high").when(F.col("match_rate") >= 0.90, "medium").otherwise("none"))


def join_candidates(a: DataFrame, b: DataFrame, roles_a: Mapping[str, str] | None = None, roles_b: Mapping[str, str] | None = None, evidence: Sequence[tuple[str, str]] = ()) -> list[tuple[str, str, str]]:
    """(column of a, column of b, source): shared_name, fk_evidence, key_role or name_suffix; by schema alone. Source E is :func:`value_overlap`."""
    ta, tb = ({f.name: family(f.dataType) for f in df.schema.fields} for df in (a, b))
    out = [(c, c, "shared_name") for c in ta if tb.get(c) == ta[c]]
    out += [(x, y, "fk_evidence") for x, y in evidence if ta.get(x) and ta.get(x) == tb.get(y)]
    out += [(x, y, "key_role") for x in ta for y in tb if x != y and (roles_a or {}).get(x) == (roles_b or {}).get(y) == "key" and ta[x] == tb[y] and x.split("_")[-1] == y.split("_")[-1]]
    out += [(x, y, "name_suffix") for x in ta for y in tb if x != y and ta[x] == tb[y] and len(s := _common_suffix(x, y)) >= 2]
    return list({(x, y): (x, y, s) for x, y, s in reversed(out)}.values())[::-1]


def _common_suffix(x: str, y: str) -> list[str]:
    same = itertools.takewhile(lambda p: p[0] == p[1], zip(reversed(x.lower().split("_")), reversed(y.lower().split("_")), strict=False))
    return [p[0] for p in same]


def keyish_columns(df: DataFrame, text_least: int = 10, int_least: int = 500) -> list[str]:
    """Text of ten distinct values or more, whole numbers of 500 or more (approximately counted); never fractions."""
    able = {f.name: text_least if family(f.dataType) == "string" else int_least for f in df.schema.fields if family(f.dataType) == "string" or isinstance(f.dataType, INTEGRAL)}
    if not able:
        return []
    counts = df.agg(*(F.approx_count_distinct(c).alias(c) for c in able)).first().asDict()
    return [c for c in able if counts[c] >= able[c]]


def value_overlap(small: DataFrame, large: DataFrame, key_small: str, key_large: str, n: int = 200) -> DataFrame:
    """Of n sampled distinct values of one column, those present in the other; a candidate from 50 % on."""
    sample = sample_keys(small.select(F.col(key_small).cast("string").alias("k")), ["k"], n)
    there = large.select(F.col(key_large).cast("string").alias("k")).distinct().withColumn("hit", F.lit(1))
    out = sample.join(there, "k", "left").agg(F.count("*").alias("sampled"), F.count("hit").alias("matched"))
    return out.withColumn("overlap", F.round(ratio("matched", "sampled"), 6)).withColumn("is_candidate", F.coalesce(F.col("overlap") >= 0.5, F.lit(False)))


# Fixed value: tables with fewer distinct keys are known whole, and say so.
SAMPLE_FLOOR = 50


def _fanout(sample: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of sampled keys and pre-counted partners: the fan-out figures over all of them, those without partners counting 0."""
    n = F.coalesce(F.col("n"), F.lit(0))
    whole = lambda e: F.round(F.coalesce(e, F.lit(0.0)), 6)
    out = sample.join(counts, list(keys), "left").agg(
        F.count("*").alias("sampled"), F.count_if(n > 0).alias("matched"), whole(F.avg(n.cast("double"))).alias("avg_fanout"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_fanout"), whole(F.stddev_pop(n.cast("double"))).alias("stddev_fanout")
    )
    return out.withColumn("sample_saturated", F.col("sampled").between(1, SAMPLE_FLOOR - 1))


def measure_fanout(small: DataFrame, large: DataFrame, keys: Sequence[str], n: int = 500) -> DataFrame:
    """Rows of ``large`` per sampled key of ``small``: sampled, matched, avg, max, stddev, and whether there were so few keys (under 50) that all were sampled.

    Keys are counted once on the large side, so a hot key costs a partial count, not a join of its rows.
    """
    counts = large.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    return _fanout(sample_keys(small, keys, n), counts, keys)


def measure_bridge(t1: DataFrame, t3: DataFrame, t2: DataFrame, key1: str, key2: str, n: int = 500) -> DataFrame:
    """Rows of t2 per sampled key of t1 by way of t3, from counts of t2's keys."""
    far = t2.filter(F.col(key2).isNotNull()).groupBy(key2).agg(F.count("*").alias("m"))
    counts = t3.filter(F.col(key1).isNotNull()).groupBy(key1, key2).agg(F.count("*").alias("w")).join(far, key2, "left").groupBy(key1).agg(F.sum(F.col("w") * F.coalesce("m", F.lit(0))).alias("n"))
    return _fanout(sample_keys(t1, [key1], n), counts, [key1])


def classify_fanout() -> Column:
    """Class of a row of fan-out figures; the rules apply in order."""
    share, avg, sd = ratio("matched", "sampled"), F.col("avg_fanout"), F.coalesce("stddev_fanout", F.lit(0.0))
    return (
        F.when(F.coalesce(share, F.lit(0.0)) < 0.10, "no_signal")
        .when((avg > 100) | ((sd > avg) & (avg > 1.1)), "catastrophic_fanout")
        .when((share < 0.5) & (sd > avg), "no_signal")
        .when((avg >= 1.5) & (avg <= 100) & (sd / avg < 1), "header_detail")
        .when((avg >= 0.9) & (avg <= 1.1) & (sd < 0.5) & (share > 0.8), "per_record_key")
        .when(avg > 1.1, "header_detail")
        .otherwise("no_signal")
    )


def join_cardinality(a: DataFrame, b: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("a", "b"), n: int = 500) -> DataFrame:
    """A row per direction with figures and class; is_top marks the smaller table's (ties: the first).

    safe_direction is the pair's: a direction of one record a key, the first of two; else one from header to detail; else null.
    """
    rows = a.agg(F.count("*").alias("rows_a")).crossJoin(b.agg(F.count("*").alias("rows_b")))
    one = lambda x, y, label: measure_fanout(x, y, keys, n).withColumn("direction", F.lit(label)).withColumn("fanout_class", classify_fanout())
    out = one(a, b, f"{names[0]}->{names[1]}").union(one(b, a, f"{names[1]}->{names[0]}")).crossJoin(rows)
    first = F.col("direction") == f"{names[0]}->{names[1]}"
    safe = F.col("fanout_class").isin("per_record_key", "header_detail")
    rank = F.when(safe, F.when(F.col("fanout_class") == "per_record_key", 0).otherwise(2) + F.when(first, 0).otherwise(1))
    best = out.agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), "direction"))).alias("_best"))
    out = out.crossJoin(F.broadcast(best)).withColumn("safe_direction", F.col("_best.direction")).drop("_best")
    return out.withColumn("is_safe", safe).withColumn("is_top", F.when(F.col("rows_a") <= F.col("rows_b"), first).otherwise(~first)).drop("rows_a", "rows_b")


def bridge_candidates(t1: DataFrame, t2: DataFrame, t3: DataFrame, roles3: Mapping[str, str], direct_classes: Sequence[str] = ()) -> list[tuple[str, str]]:
    """Pairs of t3's key columns that t1 and t2 share with it, families alike; none if a direct join of t1 and t2 is one record a key."""
    if "per_record_key" in direct_classes:
        return []
    f1, f2, f3 = ({f.name: family(f.dataType) for f in t.schema.fields} for t in (t1, t2, t3))
    keys = [c for c in f3 if roles3.get(c) == "key"]
    return [(x, y) for x in keys for y in keys if x != y and f1.get(x) == f3[x] and f2.get(y) == f3[y]]


#: Values of a filter column up to which its reachability is measured.
MOST_VALUES = 1000


def filter_reachability(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], most: int = MOST_VALUES) -> DataFrame:
    """column_name, value, total_rows, reachable_rows, is_reachable, status, reason: a row for every value of every filter column of ``b``.

    reachable_rows are rows of ``a`` joined with ``b`` by the key; total_rows those of ``b``. a's keys are counted
    and met by b once for all columns, whose values are then counted together. A column of more than ``most``
    values has one row instead, skipped with its reason.
    """
    # Columns that are over it by far aren't counted at all: their estimate is off by a few hundredths.
    rough = b.agg(*(F.approx_count_distinct(c, 0.02).alias(c) for c in columns)).first().asDict()
    able = [c for c in columns if rough[c] <= 2 * most]
    ways = a.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_ways"))
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in able))
    counted = b.join(ways, key, "left").select(F.inline(cells), "_ways") if able else None
    skipped = lambda df: df.select("column_name", F.lit(None).cast("string").alias("value"), *(F.lit(None).cast("long").alias(x) for x in ("total_rows", "reachable_rows")), F.lit(None).cast("boolean").alias("is_reachable"), F.lit("skipped").alias("status"), F.lit("high_cardinality").alias("reason"))
    far = skipped(b.sparkSession.createDataFrame([(c,) for c in columns if c not in able], "column_name string"))
    if counted is None:
        return far
    values = counted.filter("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("total_rows"), F.coalesce(F.sum("_ways"), F.lit(0)).alias("reachable_rows"))
    number = values.groupBy("column_name").agg(F.count("*").alias("_values"))
    found = values.join(F.broadcast(number), "column_name")
    good = found.filter(F.col("_values") <= most).select("column_name", "value", "total_rows", "reachable_rows", (F.col("reachable_rows") > 0).alias("is_reachable"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("reason"))
    return good.union(skipped(number.filter(F.col("_values") > most))).union(far)


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows, non-null, completeness, distinct, min, max and, where the values are numbers, avg and quartiles."""
    d = lambda c: F.col(c).try_cast("double")
    types = {f.name: family(f.dataType) for f in df.schema.fields}
    num = lambda c, e: e if types[c] == "numeric" else F.lit(None).cast("double")
    fields = {
        "rows": lambda c: F.count("*"),
        "non_null": lambda c: F.count(c),
        "distinct_count": lambda c: F.countDistinct(c),
        "min_value": lambda c: F.min(F.col(c)).cast("string"),
        "max_value": lambda c: F.max(F.col(c)).cast("string"),
        "avg": lambda c: num(c, F.round(F.avg(d(c)), 6)),
    }
    cols = list(cols or df.columns)
    quartiles = quantile_rows(df, [c for c in cols if types[c] == "numeric"], {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    rounded = quartiles.select("column_name", *(F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")))
    out = _one_pass(df, cols, fields).join(F.broadcast(rounded), "column_name", "left")
    return out.withColumn("completeness_pct", F.round(100 * ratio("non_null", "rows"), 2))


def lens(df: DataFrame, kind: str, measure: str, dim: str | None = None, date: str | None = None, edges: Sequence[float] = (), n: int = 10) -> DataFrame:
    """Overview, by_dimension, ranking, time_trend, cumulative, variance, bucketing or part_to_whole."""
    total = F.sum(F.col(measure).cast("decimal(18,2)")).cast("double").alias("total")
    month = F.trunc(F.col(date).cast("date"), "MM").alias("month") if date else None
    if kind == "overview":
        return df.agg(F.count("*").alias("n"), total, F.round(F.avg(measure), 6).alias("avg"), F.min(measure).alias("min"), F.max(measure).alias("max"))
    if kind == "by_dimension":
        return df.groupBy(dim).agg(F.count("*").alias("n"), total)
    if kind == "ranking":
        return df.groupBy(dim).agg(total).orderBy(F.desc("total"), dim).limit(n)
    if kind == "time_trend":
        return df.groupBy(month).agg(F.count("*").alias("n"), total)
    if kind == "cumulative":
        w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
        return df.groupBy(month).agg(total).withColumn("running_total", F.round(F.sum("total").over(w), 2))
    if kind == "variance":
        w = Window.orderBy("month")
        return df.groupBy(month).agg(total).withColumn("change", F.round(F.col("total") - F.lag("total").over(w), 2))
    if kind == "bucketing":
        bucket = reduce(lambda acc, e: acc + (F.col(measure) >= e).cast("int"), edges, F.lit(0))
        return df.filter(F.col(measure).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), total)
    if kind == "part_to_whole":
        return share_of_total(df.withColumn(measure, F.col(measure).cast("decimal(18,2)").cast("decimal(28,2)")), dim, measure).withColumn(measure, F.col(measure).cast("double"))
    raise ValueError(f"no lens {kind!r}")


def catalog_overview(frames: Mapping[str, DataFrame], evidence: DataFrame | None = None) -> DataFrame:
    """Rows, columns and evidence rows of every table."""
    from stratum.sources.tables import row_counts

    counts = row_counts(frames)
    width = F.create_map(*(F.lit(x) for name, df in frames.items() for x in (name, len(df.columns))))
    out = counts.withColumn("column_count", width[F.col("table_name")])
    if evidence is None:
        return out.withColumn("evidence_rows", F.lit(0).cast("long"))
    known = evidence.filter("superseded_by is null").groupBy(F.col("source_tables").alias("table_name")).agg(F.count("*").alias("evidence_rows"))
    return out.join(known, "table_name", "left").withColumn("evidence_rows", F.coalesce("evidence_rows", F.lit(0)))
