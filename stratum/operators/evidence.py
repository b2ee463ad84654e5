"""Evidence store (inventory L1 to L15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.operators.scan import numbered
from stratum.functions.lists import list_has, list_values

#: Columns of a finding.
EVIDENCE = "id string, analysis_type string, executed_at_utc timestamp, result_json string, promoted boolean, promoted_at_utc timestamp, promoted_to_target_id string, run_id string, query_sql string, row_count long, error_message string, status string, superseded_by string, executed_by string, schema_version string, source_tables string, domain_name string, last_source_ingestion_at timestamp"
#: What every table of a scope needs, and what every pair does.
PER_TABLE = ("completeness", "dimensions", "magnitude", "code_tables", "date_coverage", "segmentation")
PER_PAIR = ("grain_relationship",)


def append_evidence(evidence: DataFrame, new: DataFrame) -> DataFrame:
    """L1: one union for all new rows."""
    return evidence.unionByName(new, allowMissingColumns=True)


def supersede(evidence: DataFrame, new: DataFrame) -> DataFrame:
    """L2: current rows of a (type, tables) that ``new`` holds point to its first new id; superseded ones stay."""
    first = new.groupBy("analysis_type", "source_tables").agg(F.min("id").alias("_by"))
    old = evidence.join(first, ["analysis_type", "source_tables"], "left")
    hit = F.col("superseded_by").isNull() & F.col("_by").isNotNull()
    old = old.withColumns({"superseded_by": F.when(hit, F.col("_by")).otherwise(F.col("superseded_by")), "status": F.when(hit, "superseded").otherwise(F.col("status"))})
    return append_evidence(old.select(evidence.columns), new)


def latest_evidence(evidence: DataFrame, analysis_type: str | None = None) -> DataFrame:
    """L3: the newest successful row per (type, tables)."""
    rows = evidence.filter("status = 'success'")
    rows = rows.filter(F.col("analysis_type") == analysis_type) if analysis_type else rows
    w = Window.partitionBy("analysis_type", "source_tables").orderBy(F.desc("executed_at_utc"), F.desc("id"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def coverage(scope: DataFrame, evidence: DataFrame) -> DataFrame:
    """L4: analysis_type, source_tables, is_covered for every analysis that a scope (table_name) needs.

    A magnitude finding covers the baseline too; skipped findings cover. The scope is ready when all are covered.
    """
    names = scope.select("table_name").distinct()
    single = names.select(F.explode(F.array(*map(F.lit, (*PER_TABLE, "baseline")))).alias("analysis_type"), F.col("table_name").alias("source_tables"))
    other = names.toDF("other")
    both = names.join(other, F.col("table_name") < F.col("other")).select(F.explode(F.array(*map(F.lit, PER_PAIR))).alias("analysis_type"), F.concat_ws(",", "table_name", "other").alias("source_tables"))
    done = evidence.filter("status in ('success', 'skipped') and superseded_by is null").select("analysis_type", F.array_join(F.sort_array(list_values("source_tables")), ",").alias("source_tables"))
    done = done.union(done.filter("analysis_type = 'magnitude'").select(F.lit("baseline"), "source_tables")).distinct().withColumn("is_covered", F.lit(True))
    return single.union(both).join(done, ["analysis_type", "source_tables"], "left").withColumn("is_covered", F.coalesce("is_covered", F.lit(False)))


_ITERATIONS = "struct<iterations:array<struct<iter_num:int,analyst_action:string,llm_response:struct<blockers:array<struct<short_title:string,type:string,resolves_in:string,tables:string>>>>>>"
_RESOLUTIONS = "struct<blockers_resolution:array<struct<blocker_short_title:string,status:string,evidence:string>>>"


def blocker_state(terms: DataFrame, results: DataFrame) -> DataFrame:
    """term_id, short_title, type, resolves_in, tables, state, evidence.

    The blockers of the term's newest confirmed iteration against its newest resolution: RESOLVED,
    AMBIGUOUS, or PENDING where nothing says more.
    """
    one = terms.select(F.col("id").alias("term_id"), F.explode(F.from_json("scope_derivation_history_json", _ITERATIONS)["iterations"]).alias("it")).filter("it.analyst_action = 'confirmed'")
    newest = one.groupBy("term_id").agg(F.max_by("it", "it.iter_num").alias("it"))
    blockers = newest.select("term_id", F.explode("it.llm_response.blockers").alias("b")).select("term_id", "b.short_title", "b.type", "b.resolves_in", "b.tables")
    w = Window.partitionBy("term_id").orderBy(F.desc("executed_at_utc"), F.desc("id"))
    last = results.filter("row_type = 'sufficiency'").withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    said = last.select("term_id", F.explode(F.from_json("sufficiency_json", _RESOLUTIONS)["blockers_resolution"]).alias("r")).select("term_id", F.col("r.blocker_short_title").alias("short_title"), F.upper("r.status").alias("said"), "r.evidence")
    out = blockers.join(said, ["term_id", "short_title"], "left")
    return out.withColumn("state", F.when(F.col("said") == "RESOLVED", "RESOLVED").when(F.col("said").isin("AMBIGUOUS", "PARTIAL"), "AMBIGUOUS").otherwise("PENDING")).drop("said")


def prior_evidence(results: DataFrame, mapping: DataFrame, glossary: DataFrame, term: str, n: int = 20) -> DataFrame:
    """The newest results of other live terms that share a source table with the term; superseded ones name their successor."""
    tables = mapping.filter(F.col("business_term_id") == term).select("source_table").distinct()
    others = mapping.filter(F.col("business_term_id") != term).join(tables, "source_table", "left_semi").select(F.col("business_term_id").alias("term_id")).distinct()
    live = glossary.filter("status <> 'archived'").select(F.col("id").alias("term_id"))
    return results.join(others, "term_id", "left_semi").join(live, "term_id", "left_semi").withColumn("successor_id", F.col("superseded_by")).orderBy(F.desc("executed_at_utc"), "id").limit(n)


def resolve_scope(sources: Sequence[tuple[str, DataFrame]], live: DataFrame) -> DataFrame:
    """term_id, table_name, scope_source: each term's tables from the first source that has any; only live tables stay."""
    rows = None
    for rank, (name, df) in enumerate(sources):
        part = df.select("term_id", "table_name").withColumn("scope_source", F.lit(name)).withColumn("_rank", F.lit(rank))
        rows = part if rows is None else rows.union(part)
    rows = rows.join(live.select("table_name").distinct(), "table_name", "left_semi")
    best = rows.groupBy("term_id").agg(F.min("_rank").alias("_rank"))
    return rows.join(best, ["term_id", "_rank"]).select("term_id", "table_name", "scope_source").distinct()


def sweep_orphans(runs: DataFrame, ttl_hours: int, as_of: str) -> DataFrame:
    """Runs in progress for longer than the time to live become failed, with the reason."""
    old = (F.col("status") == "in_progress") & (F.col("started_at_utc") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(ttl_hours)} hours"))
    return runs.withColumns({"error_message": F.when(old, F.lit(f"orphaned: in progress for over {ttl_hours} hours")).otherwise(F.col("error_message")), "status": F.when(old, "failed").otherwise(F.col("status"))})


def merge_join_keys(declared: DataFrame, found: DataFrame, least: float = 0.95) -> DataFrame:
    """left_table, right_table, join_key, provenance: a found key (integrity from ``least``) wins over a declared one."""
    strong = found.filter(F.col("integrity") >= least).groupBy("left_table", "right_table").agg(F.max_by("join_key", "integrity").alias("_found"))
    out = declared.join(strong, ["left_table", "right_table"], "full_outer")
    return out.select("left_table", "right_table", F.coalesce("_found", "join_key").alias("join_key"), F.when(F.col("_found").isNotNull(), "evidence").otherwise("declared").alias("provenance"))


def gather_evidence(evidence: DataFrame, table: str, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """analysis_type and findings of one table: the newest of each required type, all current ones of optional types."""
    own = evidence.filter(list_has("source_tables", table) & F.col("superseded_by").isNull() & (F.col("status") == "success"))
    w = Window.partitionBy("analysis_type").orderBy(F.desc("executed_at_utc"), F.desc("id"))
    rows = own.withColumn("_r", F.row_number().over(w)).filter((F.col("analysis_type").isin(*required) & (F.col("_r") == 1)) | F.col("analysis_type").isin(*optional))
    return rows.groupBy("analysis_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "result_json"))), lambda x: x["result_json"]).alias("findings"))


def select_facts(facts: DataFrame, scope: str, layer: str, categories: Sequence[str]) -> DataFrame:
    """Active facts for a scope and layer in the given categories, by priority."""
    return facts.filter((F.col("status") == "active") & list_has("scope", scope) & list_has("layers", layer) & F.col("category").isin(*categories)).orderBy(F.desc("priority"), "fact_id")


def skipped_row(spark: SparkSession, analysis_type: str, tables: Sequence[str], reason: str, run_id: str, executed_at: str) -> DataFrame:
    """The finding that there is nothing to analyse."""
    payload = F.to_json(F.struct(F.lit(reason).alias("reason")))
    row = spark.range(1).select(F.concat_ws("-", F.lit(analysis_type), F.lit(run_id)).alias("id"), F.lit(analysis_type).alias("analysis_type"), F.lit(executed_at).cast("timestamp").alias("executed_at_utc"), payload.alias("result_json"), F.lit("skipped").alias("status"), F.lit(",".join(sorted(tables))).alias("source_tables"), F.lit(run_id).alias("run_id"))
    return spark.createDataFrame([], EVIDENCE).unionByName(row, allowMissingColumns=True)


def with_ids(df: DataFrame, existing: DataFrame, order: Sequence[str | Column], prefix: str = "", column: str = "id") -> DataFrame:
    """Ids that follow the largest stored one, in one sequence that ranges of rows number side by side."""
    last = existing.agg(F.coalesce(F.max(F.regexp_extract(F.col(column), r"(\d+)$", 1).try_cast("long")), F.lit(0)).alias("_last"))
    out = numbered(df, order, "_n").crossJoin(F.broadcast(last))
    return out.withColumn(column, F.concat(F.lit(prefix), (F.col("_n") + F.col("_last")).cast("string"))).drop("_n", "_last")


def lineage_coverage(scope: DataFrame, lineage: DataFrame) -> DataFrame:
    """table_name with has_model: whether any model reads it."""
    known = lineage.select(F.lower(F.trim("source_table")).alias("table_name")).distinct().withColumn("has_model", F.lit(True))
    return scope.select(F.lower(F.trim("table_name")).alias("table_name")).distinct().join(known, "table_name", "left").withColumn("has_model", F.coalesce("has_model", F.lit(False)))


def model_coverage(lineage: DataFrame, live: DataFrame) -> DataFrame:
    """Models downstream of each live source table."""
    return lineage.join(live.select(F.col("table_name").alias("source_table")).distinct(), "source_table", "left_semi").groupBy("source_table").agg(F.countDistinct("model").alias("models"))
