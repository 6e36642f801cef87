"""Domain frames over the star-schema tables: clients, runs, run items, materials, usage; and the same in SQL for the oracle.

A run is a priced quotation (an order), a run item one of its lines. Cost is the part's retail price.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries take the present from here: no query reads the clock.
AS_OF, USAGE_AS_OF = "2001-11-30", "2024-02-01"
STATUS = {"F": "approved", "O": "pending_approval", "P": "rejected"}
OUTCOME = {"F": "won", "P": "lost"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(column: str, names: dict[str, str]) -> Column:
    return reduce(lambda c, x: c.when(F.col(column) == x[0], x[1]), names.items(), F)


def clients(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("client_id"), F.col("c_name").alias("client"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("lifetime_value"), F.col("c_nationkey").alias("nation_id"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("total_price"), F.col("o_orderpriority").alias("reason"),
        mapped("o_orderstatus", STATUS).alias("status"), mapped("o_orderstatus", OUTCOME).alias("outcome"),
    )


def materials(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("material_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("origin"),
        F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("base_cost"),
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("material_id"), F.col("l_suppkey").alias("supplier_id"),
        F.col("l_linenumber").alias("line_number"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("item_price"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_shipdate").alias("effective_at"), F.col("l_returnflag").alias("flag"),
    )


def costed_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with what the catalogue knows of their material; materials are an optional dimension."""
    return items(spark, d).join(materials(spark, d), "material_id", "left").withColumnRenamed("base_cost", "unit_cost")


def usage(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        F.col("event_id").alias("call_id"), F.col("ts").alias("created_at"), F.col("user_id").alias("tenant_id"), F.col("event_type").alias("service"),
        F.col("value").alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("event_type") != "error").alias("success"),
    )


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())} END"


CTES = {
    "clients": "SELECT c_custkey AS client_id, c_name AS client, c_mktsegment AS segment, c_acctbal AS lifetime_value, c_nationkey AS nation_id FROM customer",
    "runs": f"SELECT o_orderkey AS run_id, o_custkey AS client_id, o_orderdate AS created_at, o_totalprice AS total_price, o_orderpriority AS reason, {_case('o_orderstatus', STATUS)} AS status, {_case('o_orderstatus', OUTCOME)} AS outcome FROM orders",
    "materials": "SELECT p_partkey AS material_id, p_name AS name, p_brand AS origin, p_type AS category, p_size AS size, p_retailprice AS base_cost FROM part",
    "items": "SELECT l_orderkey AS run_id, l_partkey AS material_id, l_suppkey AS supplier_id, l_linenumber AS line_number, l_quantity AS quantity, l_extendedprice AS item_price, l_extendedprice / l_quantity AS unit_price, l_discount AS discount, l_tax AS tax, l_shipdate AS effective_at, l_returnflag AS flag FROM lineitem",
    "costed": "SELECT i.*, m.name, m.origin, m.category, m.size, m.base_cost AS unit_cost FROM items i LEFT JOIN materials m USING (material_id)",
    "usage": "SELECT event_id AS call_id, ts AS created_at, user_id AS tenant_id, event_type AS service, value AS cost, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, event_type <> 'error' AS success FROM events",
}


def sql(body: str, **more: str) -> str:
    """`body` with the domain frames it names, and `more`, as common table expressions."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in (CTES | more).items()) + " " + body
