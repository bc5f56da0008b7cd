"""Sample tables derived from the given tables, in Spark and in SQL.

Rounding: ``snap`` rounds half up to six digits with a small bias, so that decimal ties
come out alike in engines whose sums differ in the last bits.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespool.plans import layout

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
              "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snap(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.5001) / 1e6


def sql_snap(e: str, name: str | None = None) -> str:
    return f"floor(({e})*1e6+0.5001)/1e6" + (f" AS {name}" if name else "")


def pulls(spark: SparkSession, sf_dir: str, reuse: bool = False) -> DataFrame:
    """lineitem as force-extension traces, one per supplier, in shipping order.

    ``reuse`` writes the table once for queries that read it in several passes.
    """
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("trace"), *LINE_ORDER, "l_tax")
    ranked = layout.index_samples(raw, LINE_ORDER)
    qty = F.col("l_quantity").cast("double")
    out = ranked.select(
        "trace", "i", "n", "chunk", (F.col("l_extendedprice") / 1e5).alias("d"), qty.alias("f"),
        (-qty).alias("f1"), (qty * (1 + F.col("l_tax"))).alias("f2"))
    return layout.settle(out) if reuse else out


PULLS = """pulls AS (SELECT l_suppkey AS trace,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate,l_orderkey,l_linenumber,
    l_partkey,l_quantity,l_extendedprice) - 1 AS i,
  count(*) OVER (PARTITION BY l_suppkey) AS n,
  l_extendedprice/1e5 AS d, CAST(l_quantity AS DOUBLE) AS f, -CAST(l_quantity AS DOUBLE) AS f1,
  CAST(l_quantity AS DOUBLE)*(1+l_tax) AS f2 FROM lineitem)"""


def signals(spark: SparkSession, sf_dir: str, reuse: bool = False) -> DataFrame:
    """events as irregularly timed traces, one per user."""
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace"), "event_id", "event_type",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', "
               "cast(ts as timestamp_ntz)) / 1e6D").alias("t"),
        F.col("value").cast("double").alias("x"))
    ranked = layout.index_samples(raw, ["event_id"])
    out = ranked.select("trace", "i", "n", "chunk", "t", "x", F.col("event_type").alias("lab"))
    return layout.settle(out) if reuse else out


SIGNALS = """signals AS (SELECT user_id AS trace,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
  count(*) OVER (PARTITION BY user_id) AS n,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))/1e6 AS t,
  CAST(value AS DOUBLE) AS x, event_type AS lab FROM events)"""


def sql_eps(force: str, lp: float, st: float | None = None) -> str:
    """Relative extension by binary search on the force law (independent of the engine's root)."""
    f = f"(({force})*{lp}/4.11)"
    search = (f"list_reduce(list_transform(range(1,56), lambda k: pow(0.5,k)), lambda l, s: "
              f"CASE WHEN 0.25/((1-l-s)*(1-l-s))-0.25+l+s <= {f} THEN l+s ELSE l END, 0.0::DOUBLE)")
    return search if st is None else f"({search} + ({force})/{st})"
