"""Queries on smoothing, decimation and contour length."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespool.catalog.registry import query
from tracespool.catalog.views import PULLS, pulls, snap, sql_eps, sql_snap
from tracespool.functions import wlc
from tracespool.operators import filters
from tracespool.operators.quantiles import exact_quantiles
from tracespool.plans import layout

# triangular kernel of width 5, written from the definition
DECIMATED = PULLS + """, dec AS (SELECT c.trace, c.i//5-1 AS i,
  sum((5-abs(x.i-c.i))*x.d)/25 AS d, sum((5-abs(x.i-c.i))*x.f)/25 AS f
  FROM pulls c JOIN pulls x ON x.trace=c.trace AND x.i BETWEEN c.i-4 AND c.i+4
  WHERE c.n>15 AND c.i>=5 AND c.i<c.n-5 AND c.i%5=0 GROUP BY c.trace, c.i)"""


def decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.boxcar_decimate(pulls(spark, sf_dir), ["d", "f"], 5)


@query("boxcar_decimate", f"WITH {DECIMATED} SELECT trace, i, {sql_snap('d','d')}, "
       f"{sql_snap('f','f')} FROM dec")
def _boxcar(spark, sf_dir):
    return decimated(spark, sf_dir).select("trace", "i", snap("d").alias("d"), snap("f").alias("f"))


LC_SQL = DECIMATED + f""", lc AS (SELECT trace, i, d/{sql_eps('f', 50, 1200)} AS lc FROM dec)"""


@query("pointwise_contour_length", f"WITH {LC_SQL} SELECT trace, i, {sql_snap('lc','lc')} FROM lc")
def _lc(spark, sf_dir):
    lc = wlc.contour_length(F.col("d"), F.col("f"), (50, None, 1200))
    return decimated(spark, sf_dir).select("trace", "i", snap(lc).alias("lc"))


@query("contour_length_per_trace", f"WITH {LC_SQL} SELECT trace, count(*) AS n, "
       f"{sql_snap('quantile_cont(lc,0.5)','lc_median')} FROM lc GROUP BY trace")
def flagship(spark, sf_dir):
    """Decimate, transform every point to contour length, exact median per trace."""
    lc = wlc.contour_length(F.col("d"), F.col("f"), (50, None, 1200))
    points = decimated(spark, sf_dir).withColumn("lc", lc)
    med = exact_quantiles(points, ["trace"], "lc", [0.5], layout.spread)
    return med.select("trace", "n", snap(F.col("q")[0]).alias("lc_median"))
