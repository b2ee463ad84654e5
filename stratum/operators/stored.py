"""A stored vault (C1, C2, C5, C7, C8): tables kept by the hash of their key, which increments meet without shuffling what is stored.

Tables that only grow (hubs, links, histories) are bucketed by the columns that tell whether a row is
known, so that a load shuffles the increment alone to the stored buckets and appends what is new. Tables that
are merged are kept in a folder a bucket: a merge reads and replaces the folders that the increment
touches, and no others. Either way a load that fails before its commit leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators.vault import HubSpec, LinkSpec, SatSpec, align_schema, load_hub, load_link, load_sat
from stratum.sources.scratch import written

BUCKETS = 64


def store(df: DataFrame, name: str, keys: Sequence[str], path: str, buckets: int = BUCKETS) -> DataFrame:
    """Append rows to the table ``name`` at ``path``, bucketed by ``keys``; makes it where it isn't there. Returns the table."""
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, keys[0], *keys[1:]).sortBy(*keys)
    writer.mode("append").option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def _existing(spark: SparkSession, name: str) -> DataFrame | None:
    if not spark.catalog.tableExists(name):
        return None
    spark.catalog.refreshTable(name)
    return spark.table(name)


def store_hub(stage: DataFrame, spec: HubSpec, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The hub after the load of a stage; only keys that it lacks are written."""
    return store(load_hub(stage, _existing(stage.sparkSession, name), spec), name, [spec.key], path, buckets)


def store_link(stage: DataFrame, spec: LinkSpec, name: str, path: str, buckets: int = BUCKETS, **options) -> DataFrame:
    """The link after the load of a stage."""
    return store(load_link(stage, _existing(stage.sparkSession, name), spec, **options), name, [spec.key], path, buckets)


def store_sat(stage: DataFrame, spec: SatSpec, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The history after the load of a stage; rows whose key and change hash are stored already aren't written."""
    if not spec.history or spec.compare != "history":
        raise ValueError("a history that only grows is stored this way; merge others by merge_stored")
    return store(load_sat(stage, _existing(stage.sparkSession, name), spec), name, [spec.key, *spec.child, "hashdiff"], path, buckets)


def high_water(stage: DataFrame, name: str, column: str) -> DataFrame:
    """Rows of the stage that are later than the newest stored one, which the table's statistics give."""
    known = _existing(stage.sparkSession, name)
    newest = known.agg(F.max(column)).first()[0] if known is not None else None
    return stage if newest is None else stage.filter(F.col(column) > F.lit(newest))


def merge_stored(incoming: DataFrame, keys: Sequence[str], path: str, buckets: int = BUCKETS, newest_by: str = "load_date") -> DataFrame:
    """The table at ``path`` after a merge: incoming rows replace stored ones with equal keys, the newest of each key counting.

    Only folders of buckets that incoming rows fall into are read and replaced. Columns that one side lacks are null.
    """
    spark = incoming.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = written(_newest(incoming, keys, newest_by).withColumn("_bucket", bucket), "increment")
    touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]  # as many as there are buckets at most
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # Spark's analysis error for a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    if stored is not None and touched:
        old = stored.filter(F.col("_bucket").isin(touched))
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
        condition = same[0]
        for x in same[1:]:
            condition = condition & x
        rows = written(align_schema(old.alias("o").join(rows.select(*keys).alias("r"), condition, "left_anti"), rows), "merged")
    rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def _newest(rows: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """One row a key: the newest, of equally new ones that with the greatest values."""
    rest = [by, *(c for c in rows.columns if c not in (*keys, by))]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in rows.columns))
