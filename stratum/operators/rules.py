"""Assertions that share a scan (K1 to K9): all rules of a table are told by one pass over its rows and one grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(x: str | Column) -> Column:
    return F.expr(x) if isinstance(x, str) else x


@dataclass
class RowRule:
    """Every row meets the condition; rows for which it is false are violations (``null_too``: or null)."""

    name: str
    condition: str | Column
    severity: str = "error"
    null_too: bool = False


@dataclass
class GroupRule:
    """Every group of equal keys meets ``holds``, a condition on n (rows), n_distinct (values of ``distinct``) and hits (rows that meet ``hit``).

    ``where`` chooses the rows; without keys there is one group. Groups that don't are violations.
    """

    name: str
    keys: Sequence[str | Column]
    holds: str
    severity: str = "error"
    where: str | Column = "true"
    distinct: str | Column | None = None
    hit: str | Column = "true"


@dataclass
class GridRule:
    """Every value of ``a`` stands with every value of ``b``; combinations without a row are violations."""

    name: str
    a: str
    b: str
    severity: str = "error"


def unique_rule(name: str, keys: Sequence[str], severity: str = "error", where: str = "true") -> GroupRule:
    """K1, K5, K7: no two rows (that meet the condition) with equal keys; rows with a null key don't count."""
    present = " and ".join(f"`{k}` is not null" for k in keys)
    return GroupRule(name, keys, "n = 1", severity, f"({where}) and {present}")


def with_partner(df: DataFrame, c: str, to: DataFrame, key: str, flag: str, carried: Sequence[str] = ()) -> DataFrame:
    """K3: ``df`` with a flag, true where the value has a partner and null where not, and the partner's columns; ``to`` has a key once (else its least row counts)."""
    side = to.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(F.lit(True).alias("flag"), *carried)).alias("_partner"))
    out = df.join(side, F.col(c) == F.col("_key"), "left")
    return out.withColumns({flag: F.col("_partner.flag"), **{x: F.col(f"_partner.{x}") for x in carried}}).drop("_key", "_partner")


Rule = RowRule | GroupRule | GridRule


def _cells(rule: Rule) -> list[Column]:
    """(rule, key, value, hit) that a row adds for the rule, null where it adds nothing."""

    def cell(name: str, key: Column, value: Column, hit: Column, keep: Column) -> Column:
        return F.when(keep, F.struct(F.lit(name).alias("rule"), key.cast("string").alias("key"), value.cast("string").alias("value"), hit.alias("hit")))

    none = F.lit(None)
    if isinstance(rule, RowRule):
        good = F.coalesce(_column(rule.condition).cast("boolean"), F.lit(not rule.null_too))
        return [cell(rule.name, none, none, F.lit(True), ~good)]
    text = lambda *c: F.to_json(F.struct(*(F.col(x).alias(f"k{i}") if isinstance(x, str) else x.alias(f"k{i}") for i, x in enumerate(c))), {"ignoreNullFields": "false"})
    if isinstance(rule, GridRule):
        there = F.col(rule.a).isNotNull() & F.col(rule.b).isNotNull()
        return [cell(f"{rule.name}\0a", text(rule.a), none, F.lit(True), F.col(rule.a).isNotNull()), cell(f"{rule.name}\0b", text(rule.b), none, F.lit(True), F.col(rule.b).isNotNull()), cell(f"{rule.name}\0ab", text(rule.a, rule.b), none, F.lit(True), there)]
    value = _column(rule.distinct) if rule.distinct is not None else none
    return [cell(rule.name, text(*rule.keys) if rule.keys else none, value, F.coalesce(_column(rule.hit).cast("boolean"), F.lit(False)), F.coalesce(_column(rule.where).cast("boolean"), F.lit(False)))]


def _told(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """test and violations of the rules that have any, from one pass over the table."""
    long = df.select(F.inline(F.filter(F.array(*(c for r in rules for c in _cells(r))), lambda x: x.isNotNull())))
    counts = long.groupBy("rule", "key", "value").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    groups = counts.groupBy("rule", "key").agg(F.sum("n").alias("n"), F.count("value").alias("n_distinct"), F.sum("hits").alias("hits"))
    bad = F.when(F.col("rule").isin([r.name for r in rules if isinstance(r, RowRule)]), F.col("n"))
    for r in rules:
        if isinstance(r, GroupRule):
            bad = bad.when(F.col("rule") == r.name, (~F.coalesce(F.expr(r.holds), F.lit(False))).cast("long"))
    found = groups.groupBy("rule").agg(F.sum(bad.otherwise(1)).alias("violations"))  # a grid's values count as one each
    grid = [r.name for r in rules if isinstance(r, GridRule)]
    if not grid:
        return found.withColumnRenamed("rule", "test")
    name, kind = F.split_part("rule", F.lit("\0"), F.lit(1)), F.split_part("rule", F.lit("\0"), F.lit(2))
    size = lambda k: F.coalesce(F.max(F.when(kind == k, F.col("violations"))), F.lit(0))
    return found.groupBy(name.alias("test")).agg(F.when(name.isin(grid), size("a") * size("b") - size("ab")).otherwise(F.max("violations")).alias("violations"))


def run_rules(tables: Mapping[str, tuple[DataFrame, Sequence[Rule]]]) -> DataFrame:
    """K6: test, severity, violations and status (pass, warn or fail) of all rules; each table is read once. Names of rules are unique."""
    spark = next(iter(tables.values()))[0].sparkSession
    named = spark.createDataFrame([(r.name, r.severity) for _, rules in tables.values() for r in rules], "test string, severity string")
    told = reduce(DataFrame.union, (_told(df, rules) for df, rules in tables.values() if rules))
    out = named.join(told, "test", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    return out.withColumn("status", F.when(F.col("violations") == 0, "pass").when(F.col("severity") == "warn", "warn").otherwise("fail"))
