"""Relational derivations (inventory O1 to O9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators.scan import carried_last, numbered_by
from stratum.functions.scalars import strip_prefix
from stratum.operators.relational import month_schedule


def deployed_devices(items: DataFrame, headers: DataFrame, prefix: str = "SN:", deploy: str = "201", back: str = "202") -> DataFrame:
    """O1: device_id, material_id, deployed_on, returned_on (the first return after it, if any) from movement items whose text holds the serial."""
    m = items.join(headers, "document_id").withColumn("device_id", strip_prefix("item_text", prefix))
    out = m.filter(F.col("movement_type") == deploy).groupBy("device_id", "material_id").agg(F.min("posting_date").alias("on")).withColumn("back", F.lit(None).cast("date"))
    returned = m.filter(F.col("movement_type") == back).select("device_id", F.lit(None).cast(m.schema["material_id"].dataType).alias("material_id"), F.col("posting_date").alias("on"), F.col("posting_date").cast("date").alias("back")).distinct()
    # Both kinds in one order from the latest on: a deployment meets the return that came last, if it is a later day's.
    both = carried_last(out.unionByName(returned), [F.desc("on"), F.col("back").asc_nulls_first()], "back", ["device_id"], "returned_on")
    return both.filter("back is null").select("device_id", "material_id", F.col("on").alias("deployed_on"), "returned_on")


def billing_schedule(devices: DataFrame, months: int, horizon: str) -> DataFrame:
    """O2: a row per device and month: from the month of deployment, at most ``months``, to the horizon, ending the month before a return."""
    term = F.add_months(F.trunc("deployed_on", "MM"), months - 1)
    end = F.least(term, F.lit(horizon).cast("date"), F.add_months(F.trunc("returned_on", "MM"), -1))
    return month_schedule(devices.withColumn("_end", end), "deployed_on", "_end", "bill_month").drop("_end")


def stock_from_movements(m: DataFrame) -> DataFrame:
    """O3: in less out, not below 0, per material and plant."""
    return m.groupBy("material_id", "plant").agg(F.greatest(F.lit(0.0), F.sum("signed_quantity")).alias("stock"))


def journal_from_invoices(headers: DataFrame, items: DataFrame) -> DataFrame:
    """A debit line per item and one credit line per document."""
    debit = items.select("document_id", F.lit("S").alias("side"), F.col("amount").cast("decimal(18,2)").alias("amount"), F.lit("goods").alias("account"), F.col("item_no").cast("int").alias("_order"))
    total = items.groupBy("document_id").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"))
    credit = headers.join(total, "document_id").select("document_id", F.lit("H").alias("side"), "amount", F.lit("vendor").alias("account"), F.lit(2147483647).alias("_order"))
    w = Window.partitionBy("document_id").orderBy("_order", "amount")
    return debit.union(credit).withColumn("line_no", F.row_number().over(w)).drop("_order")


def journal_from_billing(headers: DataFrame) -> DataFrame:
    """Receivable, revenue and tax of every document that is not cancelled."""
    amount, tax = F.col("net").cast("decimal(18,2)"), F.col("tax").cast("decimal(18,2)")
    line = lambda n, side, account, x: F.struct(F.lit(n).alias("line_no"), F.lit(side).alias("side"), F.lit(account).alias("account"), x.cast("decimal(18,2)").alias("amount"))
    lines = F.array(line(1, "S", "receivable", amount + tax), line(2, "H", "revenue", amount), line(3, "H", "tax", tax))
    return headers.filter("not cancelled").select("document_id", F.inline(lines))


def journal_from_movements(items: DataFrame) -> DataFrame:
    """A debit and a credit for every movement; an amount that is not positive counts as 1."""
    amount = F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.lit(1.0)).cast("decimal(18,2)")
    lines = F.array(F.struct(F.lit("S").alias("side"), F.lit("stock").alias("account"), amount.alias("amount")), F.struct(F.lit("H").alias("side"), F.lit("clearing").alias("account"), amount.alias("amount")))
    return items.select("document_id", F.inline(lines))


def journal_balanced(lines: DataFrame) -> DataFrame:
    """Documents whose debits and credits differ."""
    signed = F.when(F.col("side") == "S", F.col("amount")).otherwise(-F.col("amount"))
    return lines.groupBy("document_id").agg(F.sum(signed).alias("difference")).filter("difference <> 0")


def unpivot_status(devices: DataFrame) -> DataFrame:
    """device_id, status, status_date from a wide row per device; states without a date are left out."""
    states = ("received", "deployed", "returned", "returned_to_vendor")
    rows = F.array(*(F.struct(F.lit(s).alias("status"), F.col(f"{s}_on").cast("date").alias("status_date")) for s in states))
    return devices.select("device_id", F.inline(rows)).filter("status_date is not null")


def round_robin_pair(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str) -> DataFrame:
    """Rows of a each with one row of b of the same key, in turn."""
    x = numbered_by(a, [key], [order_a], "_i").withColumn("_i", F.col("_i") - 1)
    y = numbered_by(b, [key], [order_b], "_j").withColumn("_j", F.col("_j") - 1)
    size = y.groupBy(key).agg(F.count("*").alias("_n"))
    return x.join(size, key).withColumn("_j", F.col("_i") % F.col("_n")).join(y, [key, "_j"]).drop("_i", "_j", "_n")
