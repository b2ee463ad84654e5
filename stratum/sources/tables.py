"""Sources, sinks and table accounting (inventory A1 to A12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_seed(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A1, A2: a CSV with a header. With a schema, empty text is null and quotes are doubled; else types are inferred from all rows."""
    reader = spark.read.option("header", True).option("escape", '"').option("nullValue", "")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """table_name and row_count of every frame, in one job."""
    return reduce(DataFrame.union, (df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in frames.items()))


def assert_min_rows(frames: Mapping[str, DataFrame], least: Mapping[str, int]) -> None:
    """A3: raise where a table has fewer rows than it must plausibly have."""
    short = {r.table_name: r.row_count for r in row_counts(frames).collect() if r.row_count < least.get(r.table_name, 0)}
    if short:
        raise ValueError(f"too few rows: {short}; at least {({k: least[k] for k in short})} are needed")


def register_layer(spark: SparkSession, root: str, layer: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """A4: every table below root that can be read becomes the view layer_name; views of missing ones go."""
    out = {}
    for name in names:
        try:
            df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
        except Exception as e:  # Spark's analysis error for a path that is not there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            spark.catalog.dropTempView(f"{layer}_{name}")
            continue
        df.createOrReplaceTempView(f"{layer}_{name}")
        out[name] = df
    return out


def export_layer(frames: Mapping[str, DataFrame], root: str) -> None:
    """A5: write every frame as Parquet with zstd, a folder each."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root.rstrip('/')}/{name}.parquet")


def prune_stale(spark: SparkSession, root: str, live: Sequence[str]) -> list[str]:
    """Delete exported tables that are no longer live; their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if name.endswith(".parquet") and name.removesuffix(".parquet") not in live:
            system.delete(status.getPath(), True)
            gone.append(name.removesuffix(".parquet"))
    return sorted(gone)


def export_manifest(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table, and one hash over all counts."""
    counts = row_counts(frames)
    whole = counts.agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "table_name", "row_count"))), ",")).alias("combined_hash"))
    return counts.crossJoin(F.broadcast(whole))


def content_hash(df: DataFrame) -> DataFrame:
    """row_count and an order-insensitive fingerprint, in one pass without a sort."""
    row = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns))
    return df.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"))


def log_ingestion(log: DataFrame, run_id: str, started: str, finished: str, frames: Mapping[str, DataFrame]) -> DataFrame:
    """The log with one more row: run, times, rows in all, tables touched."""
    row = row_counts(frames).agg(F.sum("row_count").alias("row_count_total"), F.array_join(F.sort_array(F.collect_list("table_name")), ",").alias("tables_touched"))
    row = row.select(F.lit(run_id).alias("run_id"), F.lit(started).cast("timestamp").alias("started_at_utc"), F.lit(finished).cast("timestamp").alias("finished_at_utc"), "row_count_total", "tables_touched")
    return log.unionByName(row, allowMissingColumns=True)


def parity_audit(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame]) -> DataFrame:
    """A10: table_name, left_rows, right_rows, verdict: PARITY, DIVERGENT or ABSENT (on one side)."""
    a, b = row_counts(left).withColumnRenamed("row_count", "left_rows"), row_counts(right).withColumnRenamed("row_count", "right_rows")
    verdict = F.when(F.col("left_rows").isNull() | F.col("right_rows").isNull(), "ABSENT").when(F.col("left_rows") == F.col("right_rows"), "PARITY").otherwise("DIVERGENT")
    return a.join(b, "table_name", "full_outer").withColumn("verdict", verdict)


def assert_safe_write(old: DataFrame, new: DataFrame, floor: int = 0, most_deleted: int | None = None) -> None:
    """Refuse a write that leaves fewer rows than floor or deletes more than most_deleted."""
    counts = {r.table_name: r.row_count for r in row_counts({"old": old, "new": new}).collect()}
    if counts["new"] < floor:
        raise ValueError(f"{counts['new']} rows are fewer than the floor of {floor}")
    if most_deleted is not None and counts["old"] - counts["new"] > most_deleted:
        raise ValueError(f"{counts['old'] - counts['new']} rows would go; at most {most_deleted} may")


def build_dictionary(df: DataFrame, name: str, docs: Mapping[str, str] | None = None) -> DataFrame:
    """Per column its type, its smallest value as an example and its description, in one pass."""
    docs = docs or {}
    one = df.agg(*(F.min(F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema.fields))
    rows = F.array(*(F.struct(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"`{f.name}`").alias("example"), F.lit(docs.get(f.name)).cast("string").alias("description")) for f in df.schema.fields))
    return one.select(F.inline(rows))
