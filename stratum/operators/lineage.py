"""Lineage as edge tables (inventory M1 to M7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.relational import grand_total, stack_counts
from stratum.sources.scratch import written


def pipeline_edges(models: DataFrame) -> DataFrame:
    """M1: from_model, from_layer, to_model, to_layer, from models (model, layer, refs as an array); unknown refs are sources."""
    refs = models.select(F.col("model").alias("to_model"), F.col("layer").alias("to_layer"), F.explode("refs").alias("from_model"))
    known = models.select(F.col("model").alias("from_model"), F.col("layer").alias("from_layer"))
    return refs.join(known, "from_model", "left").select("from_model", F.coalesce("from_layer", F.lit("source")).alias("from_layer"), "to_model", "to_layer").distinct()


def column_origin(lineage: DataFrame, hops: int = 10) -> DataFrame:
    """M2: model, column, origin_model, origin_column, hops, from direct steps (model, column, from_model, from_column).

    Follows each column back to what no step explains; chains longer than ``hops`` (cycles among them)
    end there. Pointers are doubled: ways of 1, 2, 4, 8 steps come from joining the last with
    themselves, and those that add up to ``hops`` are joined, so that ten hops take four joins.
    """
    at = ["origin_model", "origin_column"]
    power = written(lineage.select("model", "column", F.col("from_model").alias(at[0]), F.col("from_column").alias(at[1]), F.lit(1).alias("hops")).distinct(), "steps")

    def on(ways: DataFrame, more: DataFrame) -> DataFrame:
        """Each way gone on; one that has come to its origin stays."""
        next_ = more.select(F.col("model").alias(at[0]), F.col("column").alias(at[1]), F.col(at[0]).alias("_m"), F.col(at[1]).alias("_c"), F.col("hops").alias("_n"))
        both = ways.join(next_, at, "left")
        return written(both.select("model", "column", F.coalesce("_m", at[0]).alias(at[0]), F.coalesce("_c", at[1]).alias(at[1]), (F.col("hops") + F.coalesce("_n", F.lit(0))).alias("hops")).distinct(), "steps")

    found: DataFrame | None = None
    while True:
        if hops & 1:
            found = on(found, power) if found is not None else power
        hops >>= 1
        if not hops:
            return found
        power = on(power, power)


def star_edges(origins: DataFrame, identities: Mapping[str, tuple[str, str]]) -> DataFrame:
    """M3: fact, dimension, join_key where a fact carries a dimension's identity (dimension to (origin model, column))."""
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("origin_model"), F.lit(c).alias("origin_column")) for d, (m, c) in identities.items()))
    known = origins.sparkSession.range(1).select(F.inline(rows))
    facts = origins.filter(F.col("model").startswith("fact_"))
    return facts.join(F.broadcast(known), ["origin_model", "origin_column"]).select(F.col("model").alias("fact"), "dimension", F.col("column").alias("join_key")).distinct()


def date_edges(columns: DataFrame, preference: Sequence[str]) -> DataFrame:
    """M4: each fact's date column to the calendar: the first of the preference, else the first by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preference)), F.col("column")), F.lit(0)), F.lit(len(preference) + 1))
    return columns.filter("is_date").groupBy(F.col("model").alias("fact")).agg(F.min_by("column", F.struct(rank, "column")).alias("join_key")).withColumn("dimension", F.lit("dim_date"))


def downstream(edges: DataFrame, model: str) -> DataFrame:
    """M5."""
    return edges.filter(F.col("from_model") == model).select("to_model").distinct()


def downstream_all(edges: DataFrame, model: str, hops: int = 10) -> DataFrame:
    """M5: everything reachable from a model within ``hops``, with the fewest hops; the model itself where a cycle leads back.

    Only the models of the newest hop meet the edges, and each hop is a table of its own, so that no
    plan holds the hops before it. Ends when a hop finds nothing new.
    """
    step = written(edges.select("from_model", "to_model").distinct(), "edges")
    found = [written(step.filter(F.col("from_model") == model).select("to_model", F.lit(1).alias("hops")), "hop")]
    while len(found) < hops and not found[-1].isEmpty():
        front = found[-1].select(F.col("to_model").alias("from_model")).join(step, "from_model").select("to_model").distinct()
        new = front.join(reduce(DataFrame.union, found).select("to_model"), "to_model", "left_anti")
        found.append(written(new.withColumn("hops", F.lit(len(found) + 1)), "hop"))
    return reduce(DataFrame.union, found)


def archive_impact(owners: DataFrame, edges: DataFrame, term: str, terms: DataFrame | None = None) -> DataFrame:
    """M6: model, impact: models of the term that other terms own too (shared), and others' models that read its models (downstream).

    With ``terms`` (term_id, status) only terms that stand there own anything, and archived ones own nothing; a blank status is active.
    """
    own = owners.filter(F.col("term_id") == term).select("model").distinct()
    others = owners.filter(F.col("term_id") != term)
    if terms is not None:
        live = terms.groupBy("term_id").agg(F.min(F.coalesce(F.trim("status"), F.lit(""))).alias("status")).filter("status <> 'archived'")
        others = others.join(live.select("term_id"), "term_id", "left_semi")
    shared = own.join(others, "model", "left_semi").withColumn("impact", F.lit("shared"))
    reads = edges.join(own.select(F.col("model").alias("from_model")), "from_model", "left_semi").select(F.col("to_model").alias("model")).distinct()
    hit = reads.join(others, "model", "left_semi").join(own, "model", "left_anti").withColumn("impact", F.lit("downstream"))
    return shared.union(hit)


def pipeline_summary(layers: Mapping[str, DataFrame]) -> DataFrame:
    """M7: rows per layer with the grand total."""
    return grand_total(stack_counts(layers), "n")
