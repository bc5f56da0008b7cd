"""Force grids: handle stiffness, loading rate, rupture-force distributions, unwrapping."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespool.functions import physics, wlc
from tracespool.operators import filters, timejoin
from tracespool.plans import layout


def force_grid(per_trace: DataFrame, lo: float, hi: float, points: int) -> DataFrame:
    """One row per trace and grid force; ``trace, i, n, chunk`` make it a sample table."""
    step = (hi - lo) / (points - 1)
    grid = per_trace.withColumn("i", F.explode(F.expr(f"sequence(0L, {points - 1}L)")))
    return layout.with_chunk(grid.withColumn("n", F.lit(points).cast("bigint")).withColumn(
        "force", F.lit(float(lo)) + F.col("i") * step))


def total_stiffness(grid: DataFrame, keq: str, model: tuple, lo: float, hi: float, points: int) -> DataFrame:
    """Stiffness of trap and handles in series; the handle part is the numerical gradient.

    The grid is known, so neighbouring forces are computed instead of looked up.
    """
    h = (hi - lo) / (points - 1)
    f = F.col("force")
    here, below, above = (wlc.extension(v, *model) for v in (f, f - h, f + h))
    grid = grid.withColumn("_x", here).withColumn("_xa", F.when(F.col("i") > 0, below)).withColumn(
        "_xb", F.when(F.col("i") < points - 1, above))
    hd, hs = F.col("_x") - F.col("_xa"), F.col("_xb") - F.col("_x")
    inner = (hd * hd * h + hs * hs * h) / (hs * hd * (hd + hs))
    slope = F.when(F.col("i") == 0, h / hs).when(F.col("i") == points - 1, h / hd).otherwise(inner)
    return grid.withColumn("k_total", 1 / (1 / F.col(keq) + 1 / slope)).drop("_x", "_xa", "_xb")


def loading_rate(grid: DataFrame, speed: float) -> DataFrame:
    return grid.withColumn("loading_rate", F.col("k_total") * float(speed))


def rupture_distribution(grid: DataFrame, rate: Column) -> DataFrame:
    """``pdf, cdf, survival`` of the rupture force for a rate over a loading-rate grid."""
    layout.unpacked_sizes(grid.sparkSession)
    hazard = layout.settle(grid.withColumn("_h", F.try_divide(rate, F.col("loading_rate"))))
    area = filters.cumulative_area(hazard, "force", "_h", "_area")
    live = F.exp(-F.col("_area"))
    return area.withColumn("survival", live).withColumn("cdf", 1 - live).withColumn(
        "pdf", F.col("_h") * live).drop("_h", "_area")


def inverse_sample(grid: DataFrame, x: str, pdf: str, draws: int, seed: int = 0) -> DataFrame:
    """``draws`` values per trace from a tabulated density, by its interpolated inverse CDF.

    Uniform numbers come from a hash of (trace, draw, seed): the same on every run and
    for any partitioning.
    """
    layout.unpacked_sizes(grid.sparkSession)
    cum = layout.settle(filters.cumulative_area(grid, x, pdf, "_c"))
    top = cum.groupBy("trace").agg(F.max("n").alias("n"), F.max("_c").alias("_top"))
    table = layout.spread(cum, top).select("trace", (F.col("_c") / F.col("_top")).alias("u"), F.col(x).alias("value"))
    table = table.groupBy("trace", "u").agg(F.min("value").alias("value"))
    asks = top.select("trace", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    asks = asks.withColumn("u", F.pmod(F.xxhash64("trace", "draw", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52))
    return timejoin.interpolate(asks, table, "u", "value")


def unwrapping_roots(rows: DataFrame, dx: str, f1: str, f2: str, contour: float, lp: float, radius: float,
                     lo: float, hi: float, spacing: float = 0.01, st: float | None = None) -> DataFrame:
    """All released lengths (nm) in a range that explain a distance change at constant load.

    Roots of eps2 x + L0 (eps2 - eps1) + peel(x) - 2 R = dx are bracketed on a grid and
    bisected; a row may have none, one or several.  The right side is smooth, so each
    bracket holds one root.

    Between the zeros of the derivative, eps2 = 2 R w sin(w x), the left side runs one way, so a stretch of grid points
    holds at most one bracket and only stretches whose ends differ in sign are searched, by halving.
    """
    count = int(math.floor((hi - lo) / spacing)) + 1
    rate = physics.peeling_rate()

    def excess(x: Column) -> Column:
        return (F.col("_e2") * x + contour * (F.col("_e2") - F.col("_e1"))
                + physics.peeling_term(x, radius) - 2 * radius - F.col(dx))

    def at(j: Column) -> Column:
        return F.lit(float(lo)) + j * spacing

    e1, e2 = (wlc.relative_extension(F.col(c), lp, st) for c in (f1, f2))
    base = rows.withColumn("_e1", e1).withColumn("_e2", e2)
    rise = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_e2") / (2 * radius * rate))))
    full = 2 * math.pi
    turns = range(math.floor(lo * rate / full) - 1, math.ceil(hi * rate / full) + 2)
    flat = [F.greatest(F.lit(0.0), F.least(F.lit(count - 1.0), ((angle + full * m) / rate - lo) / spacing))
            for m in turns for angle in (rise, math.pi - rise)]
    marks = [F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"),
             *[c for x in flat for c in (F.floor(x), F.least(F.floor(x) + 1, F.lit(count - 1)))]]
    base = base.withColumn("_p", F.array_sort(F.array_distinct(F.array(*marks))))
    part = F.explode(F.arrays_zip(F.slice("_p", 1, F.size("_p") - 1).alias("p"), F.slice("_p", 2, F.size("_p") - 1).alias("q")))
    ends = base.withColumn("_s", part).withColumn("_l", F.col("_s.p")).withColumn("_r", F.col("_s.q")).drop("_p", "_s")
    ends = ends.withColumn("_yl", excess(at(F.col("_l")))).withColumn("_yr", excess(at(F.col("_r"))))
    ends = ends.where((F.col("_yl") == 0) | (F.col("_yl") * F.col("_yr") < 0))
    dlc = _root_udf(contour, radius, lo, spacing, count)("_e1", "_e2", dx, "_l", "_r", "_yl")
    return ends.withColumn("dlc", dlc).drop("_e1", "_e2", "_l", "_r", "_yl", "_yr")


def _root_udf(contour: float, radius: float, lo: float, spacing: float, count: int):
    """UDF that finds the bracket of a stretch of grid points by halving, then bisects it."""
    rate, halve = physics.peeling_rate(), max(1, count - 1).bit_length()

    @F.pandas_udf("double")
    def root(e1: pd.Series, e2: pd.Series, dx: pd.Series, l: pd.Series, r: pd.Series, yl: pd.Series) -> pd.Series:
        e1, e2, dx, l, r, yl = (c.to_numpy() for c in (e1, e2, dx, l, r, yl))
        shift = contour * (e2 - e1)

        def excess(x):
            return e2 * x + shift + 2 * radius * np.cos(rate * x) - 2 * radius - dx

        # the first point whose sign is not that of the beginning ends the bracket
        first = l
        for _ in range(halve):
            mid = (l + r) // 2
            same = excess(lo + mid * spacing) * yl > 0
            l, r = np.where(same, mid, l), np.where(same, r, mid)
        cell = np.where(yl == 0, first, np.where(excess(lo + r * spacing) == 0, r, l))
        a = lo + cell * spacing
        ya = excess(a)
        acc = a
        for k in range(1, 53):
            step = acc + spacing * 0.5 ** k
            acc = np.where(excess(step) * ya > 0, step, acc)
        return pd.Series(np.where(ya == 0, a, acc))

    return root
