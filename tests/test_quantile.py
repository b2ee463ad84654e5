"""Exact quantiles by ranges against Spark's percentile."""

import math
import time

import pytest
from pyspark.sql import functions as F

from stratum.operators.quantile import exact_quantiles

PS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("most", [90, 700, 100_000])
def test_same_as_percentile(spark, most):
    df = spark.range(5000).selectExpr(
        "id % 977 * 1.25 AS few", "cast(hash(id) AS double) AS many", "CASE WHEN id % 3 > 0 THEN 7 ELSE id END AS hot", "cast(NULL AS int) AS none", "CASE WHEN id % 2 = 0 THEN cast(id % 11 AS decimal(9,2)) END AS half", "5 AS same",
        "CASE WHEN id % 5 = 0 THEN double('NaN') WHEN id % 7 = 0 THEN double('-Infinity') ELSE id END AS odd",
    )
    got = exact_quantiles(df, df.columns, PS, most)
    row = df.agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, PS))).alias(c) for c in df.columns)).first()
    for c in df.columns:
        want = row[c] or [None] * len(PS)
        assert all((a is None and b is None) or a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got[c], want, strict=True)), (c, got[c], want)
    assert exact_quantiles(df.limit(0), ["few"], [0.5], most) == {"few": [None]} and exact_quantiles(df, [], PS) == {}


@pytest.mark.parametrize("most", [60, 400])
def test_nulls_nan_and_outliers(spark, most):
    df = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN NULL WHEN id % 5 = 0 THEN double('NaN') ELSE id END AS gaps", "CASE WHEN id % 3 = 0 THEN -1e300 WHEN id % 3 = 1 THEN id / 1000 ELSE 1e300 * id END AS far", "CASE WHEN id < 3990 THEN double('NaN') ELSE id END AS few", "double('NaN') AS nan", "CASE WHEN id % 2 = 0 THEN -0.0D ELSE 0.0D END AS zero")
    got = exact_quantiles(df, df.columns, PS, most)
    row = df.agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, PS))).alias(c) for c in df.columns)).first()
    assert all(a == b or (math.isnan(a) and math.isnan(b)) for c in df.columns for a, b in zip(got[c], row[c], strict=True))


def test_ranges_are_told_by_compiled_code(spark):
    """A million rows took over half a minute when every value was compared with 63 cuts in one expression, too long a method to be compiled."""
    df = spark.range(1_000_000).selectExpr("id * 7919 % 1000003 AS many", "id % 50 AS few", "hash(id) AS h")
    began = time.time()
    got = exact_quantiles(df, df.columns, [0.01, 0.5, 0.999], 50_000)
    took = time.time() - began
    row = df.agg(*(F.percentile(F.col(c).cast("double"), F.array(F.lit(0.01), F.lit(0.5), F.lit(0.999))).alias(c) for c in df.columns)).first()
    assert got == {c: row[c] for c in df.columns} and took < 25
