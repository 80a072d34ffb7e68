"""Registry of queries and the pieces their SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lacuna import Roles
from lacuna.operators import coding
from lacuna.scratch import cut
from lacuna.sources.catalog import parquet_table, register

QUERIES: dict = {}
ORACLES: dict = {}


def check(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows can be checked."""
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


PART = Roles("p_partkey", ("p_retailprice", "p_size"), ("p_brand", "p_type"), ("p_size",), "p_type")
ORDERS = Roles("o_orderkey", ("o_totalprice",), ("o_orderstatus", "o_orderpriority"), (), "o_orderpriority")
CUSTOMER = Roles("c_custkey", ("c_acctbal",), ("c_mktsegment", "c_nationkey"), (), "c_mktsegment")
EVENTS = Roles("event_id", ("value",), ("event_type",), (), "event_type")
LINEITEM = Roles("l_key", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus"),
                 ("l_quantity",), "l_returnflag")

register("part", parquet_table("part.parquet", PART))
register("orders", parquet_table("orders.parquet", ORDERS))
register("customer", parquet_table("customer.parquet", CUSTOMER))
register("events", parquet_table("events.parquet", EVENTS))

LINE_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date))"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumn("l_key", F.expr(LINE_KEY))


def coded(df: DataFrame, roles: Roles) -> DataFrame:
    dimension = coding.build_dimension(df, roles.categorical)
    return cut(coding.encode(df, dimension, roles.categorical).select(roles.key, *roles.features), "coded")


# ---------------------------------------------------------------- pieces of SQL

def u_sql(*parts) -> str:
    """The keyed uniform. Parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 8))::BIGINT / 4294967296.0)"


def text_sql(name: str, numeric: bool) -> str:
    if not numeric:
        return name
    return f"regexp_replace(CAST(CAST({name} AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', '')"


def code_sql(name: str, source: str) -> str:
    """Subquery value -> 0-based code."""
    return (f"(SELECT v, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS c "
            f"FROM (SELECT DISTINCT {name} AS v FROM {source} WHERE {name} IS NOT NULL))")


def coded_sql(source: str, roles: Roles, out: str = "coded") -> str:
    """CTE ``out``: the table with category codes."""
    joins = " ".join(f"LEFT JOIN {code_sql(f, source)} AS d_{f} ON d_{f}.v = s.{f}" for f in roles.categorical)
    columns = ", ".join([f"s.{roles.key}", *[f"s.{f}" for f in roles.continuous],
                         *[f"d_{f}.c AS {f}" for f in roles.categorical]])
    return f"{out} AS MATERIALIZED (SELECT {columns} FROM {source} AS s {joins})"


LINE_SQL = f"lines AS (SELECT *, {LINE_KEY} AS l_key FROM lineitem)"


def holed_sql(source: str, roles: Roles, rate: float = 0.3, salt: str = "mcar", seed: int = 0, out: str = "holed") -> str:
    """CTE ``out``: cells hidden completely at random."""
    columns = ", ".join(f"CASE WHEN {u_sql(roles.key, repr(f), repr(salt), seed)} < {rate} THEN NULL ELSE {f} END AS {f}"
                        for f in roles.features)
    return f"{out} AS (SELECT {roles.key}, {columns} FROM {source})"


def long_sql(source: str, roles: Roles, value, out: str) -> str:
    """CTE ``out``: one row per cell, (k, f, v) with ``value(feature)`` as v."""
    return f"{out} AS (" + " UNION ALL ".join(
        f"SELECT {roles.key} AS k, '{f}' AS f, {value(f)} AS v FROM {source}" for f in roles.features) + ")"
