"""The second source: staging and vault of a shop, with surrogate keys, high-water marks and merges on a unique key."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalars import surrogate_key
from stratum.operators.vault import load_hwm, merge

# The source's tables and columns; columns with a type are cast to it.
STAGING = {
    "orders": {"order_id": None, "customer_id": None, "order_status": None, "order_purchase_timestamp": "timestamp", "order_approved_at": "timestamp", "order_delivered_carrier_date": "timestamp", "order_delivered_customer_date": "timestamp", "order_estimated_delivery_date": "timestamp"},
    "order_items": {"order_id": None, "order_item_id": None, "product_id": None, "seller_id": None, "shipping_limit_date": "timestamp", "price": "decimal(12,2)", "freight_value": "decimal(12,2)"},
    "customers": {"customer_id": None, "customer_unique_id": None, "customer_zip_code_prefix": None, "customer_city": None, "customer_state": None},
    "sellers": {"seller_id": None, "seller_zip_code_prefix": None, "seller_city": None, "seller_state": None},
    "products": {"product_id": None, "product_category_name": None, "product_weight_g": "int", "product_photos_qty": "int"},
    "category_translation": {"product_category_name": None, "product_category_name_english": None},
}


def place_hash(*cols: str) -> Column:
    """The second source's change hash of places: MD5 of the columns, null as empty, joined by one pipe."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)))


@dataclass
class IncrementSpec:
    """A vault model that is loaded by high-water mark and merged on its key.

    keys: hash key to the columns that it is made of, the model's own first; diff: columns of the change hash;
    payload: columns that are kept; loaded: the column that dates a row, or None for the time of the load.
    """

    table: str
    keys: Mapping[str, list[str]]
    payload: list[str]
    diff: list[str] = field(default_factory=list)
    diff_recipe: Callable[..., Column] = surrogate_key
    loaded: str | None = None
    where: str = "true"


VAULT = {
    "hub_order": IncrementSpec("orders", {"hk_order": ["order_id"]}, ["order_id"], loaded="order_purchase_timestamp"),
    "hub_product": IncrementSpec("products", {"hk_product": ["product_id"]}, ["product_id"]),
    "hub_seller": IncrementSpec("sellers", {"hk_seller": ["seller_id"]}, ["seller_id"], where="seller_id is not null"),
    "link_order_item": IncrementSpec("order_items", {"hk_order_item": ["order_id", "order_item_id"], "hk_order": ["order_id"], "hk_product": ["product_id"]}, ["order_id", "order_item_id", "product_id", "seller_id"], loaded="shipping_limit_date"),
    "sat_customer_identity": IncrementSpec("order_customers", {"hk_order": ["order_id"]}, ["customer_unique_id", "customer_id"], ["order_id", "customer_unique_id"]),
    "sat_customer_location": IncrementSpec("order_customers", {"hk_order": ["order_id"]}, ["customer_state", "customer_city", "customer_zip_code_prefix"], ["customer_state", "customer_city", "customer_zip_code_prefix"], place_hash),
    "sat_order_header": IncrementSpec("orders", {"hk_order": ["order_id"]}, ["order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"], ["order_status", "order_purchase_timestamp"], loaded="order_purchase_timestamp"),
    "sat_order_item_prices": IncrementSpec("order_items", {"hk_order_item": ["order_id", "order_item_id"]}, ["price", "freight_value"], ["price", "freight_value"], loaded="shipping_limit_date"),
    "sat_product_category": IncrementSpec("product_categories", {"hk_product": ["product_id"]}, ["product_category_name", "product_category_english", "product_weight_g", "product_photos_qty"], ["product_category_name", "product_category_english"]),
    "sat_seller_geo": IncrementSpec("sellers", {"hk_seller": ["seller_id"]}, ["seller_state", "seller_city", "seller_zip_code_prefix"], ["seller_state", "seller_city", "seller_zip_code_prefix"], place_hash, where="seller_id is not null"),
}


def stage_shop(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every raw table that is there, with the source's columns; and customers by order, products with their category, where both sides are."""
    out = {n: raw[n].select(*(F.col(c).try_cast(kind).alias(c) if kind else F.col(c) for c, kind in columns.items())) for n, columns in STAGING.items() if n in raw}
    if {"orders", "customers"} <= out.keys():
        out["order_customers"] = out["orders"].select("order_id", "customer_id").join(out["customers"], "customer_id")
    if {"products", "category_translation"} <= out.keys():
        named = out["products"].join(out["category_translation"], "product_category_name", "left")
        out["product_categories"] = named.withColumn("product_category_english", F.coalesce("product_category_name_english", F.lit("uncategorized")))
    return out


def load_increment(staged: Mapping[str, DataFrame], spec: IncrementSpec, existing: DataFrame | None, load_ts: str) -> DataFrame:
    """The model after the load: rows newer than the newest stored one take the place of those with the same key.

    Of rows with equal keys the newest stays; of equally new ones that with the greatest values.
    """
    rows = staged[spec.table].filter(spec.where)
    loaded = F.col(spec.loaded) if spec.loaded else F.lit(load_ts).cast("timestamp")
    keys = [surrogate_key(*columns).alias(k) for k, columns in spec.keys.items()]
    change = [spec.diff_recipe(*spec.diff).alias("hashdiff")] if spec.diff else []
    rows = rows.select(*keys, *change, *spec.payload, loaded.alias("load_date"), F.lit(f"shop.{spec.table}").alias("record_source"))
    key = next(iter(spec.keys))
    rest = ["load_date", *(c for c in rows.columns if c not in (key, "load_date"))]
    rows = rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(*(F.col(c) if c == key else F.col(f"_row.{c}") for c in rows.columns))
    return rows if existing is None else merge(existing, load_hwm(rows, existing, "load_date"), key)


def load_shop(raw: Mapping[str, DataFrame], load_ts: str, existing: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every model whose staging is there, after the load."""
    staged = stage_shop(raw)
    return {n: load_increment(staged, spec, (existing or {}).get(n), load_ts) for n, spec in VAULT.items() if spec.table in staged}
