import datetime as dt

from pyspark.sql import functions as F

from stratum.functions import lists, scalars


def one(spark, column, **values):
    df = spark.range(1).select(*(v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_null_and_empty_hash_alike_in_one_recipe_only(spark):
    null = F.lit(None).cast("string")
    assert one(spark, scalars.hash_key("a", "b"), a=null, b="x") == one(spark, scalars.hash_key("a", "b"), a="", b="x")
    assert one(spark, scalars.surrogate_key("a"), a=null) != one(spark, scalars.surrogate_key("a"), a="")


def test_sap_date_needs_eight_digits_of_a_date(spark):
    assert one(spark, scalars.sap_date("d"), d="20240131") == dt.date(2024, 1, 31)
    for bad in ("2024013", "20241399", "", "abcdefgh"):
        assert one(spark, scalars.sap_date("d"), d=bad) is None


def test_month_diff_counts_boundaries(spark):
    assert one(spark, scalars.month_diff("a", "b"), a=F.lit("2024-01-31").cast("date"), b=F.lit("2024-02-01").cast("date")) == 1


def test_ratio_of_zero_is_null_and_match_of_null_false(spark):
    assert one(spark, scalars.pct("a", "b"), a=1, b=0) is None
    assert one(spark, scalars.within_pct("a", "b", 0.05), a=10.0, b=F.lit(None).cast("double")) is False
    assert one(spark, scalars.within_pct("a", "b", 0.05), a=100.0, b=96.0) is True


def test_bands_health_and_kpi(spark):
    assert one(spark, scalars.band("a", (0, 10), ("low", "mid", "high"), "none"), a=10.0) == "high"
    assert one(spark, scalars.band("a", (0, 10), ("low", "mid", "high"), "none"), a=F.lit(None).cast("double")) == "none"
    assert one(spark, scalars.health("a", 3, 14, False), a=4) == "YELLOW"
    assert one(spark, scalars.format_kpi("a", "%", F.lit("GREEN")), a=91.88) == "91.9% [GREEN]"


def test_lists_and_json(spark):
    assert one(spark, lists.list_has("a", "mseg"), a="MKPF, Mseg") is True
    assert one(spark, lists.list_has("a", "seg"), a="MKPF, Mseg") is False
    df = spark.createDataFrame([(1, '[{"k":1},{"k":2}]'), (2, None)], "id int, j string")
    assert [(r.id, r.e.k if r.e else None) for r in lists.json_rows(df, "j", "struct<k:int>", "p", "e").orderBy("id", "p").collect()] == [(1, 1), (1, 2), (2, None)]
    assert scalars.is_date_name("posting_date") and scalars.is_date_name("BUDAT") and not scalars.is_date_name("MENGE")
