"""Queries against their oracles on small tables that the driver's smallest ones don't cover."""

import re

import duckdb
import pytest

from stratum import queries_more, queries_store  # noqa: F401  (these register their queries beside those of the warehouse)
from stratum.queries import ORACLES, QUERIES

CUSTOMER = "CREATE TABLE customer AS SELECT unnest([1, 2, 3, 4, 5, 6, NULL])::BIGINT AS c_custkey"
# Customers 1 to 3 have orders, one of which has a negative key, one none and one no state; 4 to 6 have none.
ORDERS = """CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_orderdate TIMESTAMP);
INSERT INTO orders VALUES (1, 1, 'F', '1996-01-01'), (2, 1, 'P', '1996-01-01'), (-4, 2, 'O', '1996-01-02'), (3, 2, NULL, '1996-01-01'), (NULL, 3, NULL, '1996-01-03'), (9, NULL, 'P', '1996-01-03')"""


@pytest.fixture
def same(spark, tmp_path):
    def check(name, *tables):
        con = duckdb.connect()
        for sql in tables:
            con.execute(sql)
        for (table,) in con.execute("SELECT table_name FROM information_schema.tables").fetchall():
            con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        cursor = con.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        want = sorted(cursor.fetchall(), key=str)
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(df.columns) == sorted(names)
        plain = lambda row: tuple(round(x, 8) if isinstance(x, float) else x for x in row)
        assert sorted((plain(r) for r in df.select(*names).collect()), key=str) == sorted(map(plain, want), key=str)
        return want

    return check


def test_customers_without_orders_have_no_unreachable_values(same):
    want = same("k_check_filters", CUSTOMER, ORDERS)
    assert (4, 0, "unknown") in want and (2, 1, "refuse") in want


def test_blockers_of_customers_without_orders(same):
    want = same("l_blocker_state", CUSTOMER, ORDERS)
    assert ("T4", "a", "data", "source", "t", "PENDING", "o") in want and ("T6", "b", "data", "source", "t", "PENDING", None) in want


LINES = "CREATE TABLE lineitem AS SELECT i::BIGINT AS l_orderkey, i::BIGINT AS l_partkey, CASE WHEN i % 5 > 0 THEN i % 7 - 1 END AS l_linenumber, TIMESTAMP '1996-01-01' + INTERVAL (i % 90) DAY AS l_shipdate FROM range({n}) r(i)"


@pytest.mark.parametrize("n", [1_200_000, 7, 0])
def test_distinct_estimates_are_close(same, n):
    """Spark's default error of 5 % misses 1.2 million keys by over a tenth; lines without a number or with a negative one are rows, too; nothing is close to no value."""
    assert same("e_approx_distinct", LINES.format(n=n)) == [("l_orderkey", n > 0, n), ("l_partkey", n > 0, n), ("l_shipdate", n > 0, n)]


# Orders: 1 with two heads, 2 without one, 3 without a date, 4 not received, null; lines without an item number, stored twice, returned, of unknown vendor or part.
PURCHASES = """CREATE TABLE orders AS SELECT k::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 'F' AS o_orderstatus, 9.5 AS o_totalprice, d::TIMESTAMP AS o_orderdate FROM (VALUES (1, '1996-01-01'), (1, '1996-02-01'), (3, NULL), (4, '1996-01-09'), (5, '1996-07-01'), (NULL, '1996-01-01')) v(k, d);
CREATE TABLE lineitem AS SELECT k::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, p::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, q::DOUBLE AS l_quantity, 10.25 * q::DOUBLE AS l_extendedprice, f AS l_returnflag, o AS l_linestatus, d::TIMESTAMP AS l_shipdate, 0.05::DOUBLE AS l_discount, 0.02::DOUBLE AS l_tax FROM (VALUES
(1, 1, 1, 1, 5, 'A', 'F', '1996-03-01'), (1, 1, 2, 2, 3, 'A', 'F', '1996-02-20'), (1, 2, 1, 1, 7, 'R', 'F', '1996-02-25'), (1, NULL, 1, 1, 2, 'A', 'F', '1996-02-10'), (2, 1, 1, 2, 4, 'A', 'F', '1996-05-01'), (3, 1, 2, 1, 4, 'A', 'F', '1996-05-01'), (4, 1, 9, 2, 1, 'N', 'O', '1996-01-20'), (4, 2, 1, 9, 6, 'N', 'O', NULL),
(5, 1, 2, 1, 8, 'N', 'O', '1996-07-09'), (5, 2, 2, 2, 8, 'A', 'F', '1996-07-20'), (5, 2, 2, 2, 8, 'R', 'O', '1996-07-08'), (NULL, 1, 1, 1, 2, 'A', 'F', '1996-01-05'), (NULL, NULL, 1, 1, 2, 'A', 'F', '1996-01-04'), (5, NULL, NULL, NULL, 3, NULL, NULL, '1996-07-03')) v(k, n, p, s, q, f, o, d);
CREATE TABLE supplier AS SELECT unnest([1, 2, 3])::BIGINT AS s_suppkey, unnest(['v', 'w', 'x']) AS s_name, unnest([1, 1, 2]) AS s_nationkey;
CREATE TABLE part AS SELECT unnest([1, 2])::BIGINT AS p_partkey, unnest(['b1', 'b2']) AS p_brand, unnest(['PROMO', 'LARGE']) AS p_type, unnest([7, 30]) AS p_size;
CREATE TABLE nation AS SELECT unnest([1, 2]) AS n_nationkey, unnest(['NATION_1', 'NATION_2']) AS n_name, 1 AS n_regionkey;
CREATE TABLE region AS SELECT 1 AS r_regionkey, 'r' AS r_name;
CREATE TABLE customer AS SELECT 1::BIGINT AS c_custkey, 'c' AS c_name, 1 AS c_nationkey, 'BUILDING' AS c_mktsegment;
CREATE TABLE events AS SELECT 1::BIGINT AS event_id, 1::BIGINT AS user_id, 'click' AS event_type, TIMESTAMP '2024-01-01' AS ts"""


@pytest.mark.parametrize("name", ["purchase_orders", "wide_procurement", "procurement_health", "vendor_scorecard", "vendor_performance", "receipt_accuracy", "three_way_match"])
def test_purchases_of_odd_orders(same, name):
    assert same(name, PURCHASES)


@pytest.mark.parametrize("name", ["purchase_orders", "wide_procurement", "procurement_health"])
def test_purchases_of_no_orders(same, name):
    assert len(same(name, PURCHASES + ";DELETE FROM orders;DELETE FROM lineitem")) == 0


def test_order_items_travel_once_by_order(spark, same, tmp_path):
    """Items, receipts and the orders' three frames go to their order's place; only materials and vendors are looked up elsewhere."""
    same("wide_procurement", PURCHASES)
    keys = lambda name: [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString())]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(keys("purchase_orders")) == ["_order", "l_orderkey", "po_number", "po_number", "po_number"]
        assert sorted(k for k in keys("wide_procurement") if not k.startswith(("n_", "s_"))) == ["_order", "l_orderkey", "material_id", "material_id", "po_number", "po_number", "po_number", "vendor_id", "vendor_id"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any("lineitem" in f for f in QUERIES["procurement_health"](spark, str(tmp_path)).inputFiles())  # from sums that one run over the lines has stored
