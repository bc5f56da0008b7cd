"""Robust line fits and the stiffness correction built on them."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.functions import wlc
from tracespool.operators import polyfit
from tracespool.operators.stats import mad
from tracespool.plans import layout

LOCAL_ROWS = 1 << 20  # traces up to this size are fitted inside one task


def _line(x: np.ndarray, y: np.ndarray, c: float, max_iter: int, tol: float) -> tuple[float, float]:
    """Huber line by reweighting with a MAD scale."""
    m, b = np.polyfit(x, y, 1)
    for _ in range(max_iter):
        r = y - (m * x + b)
        s = 1.4826 * np.median(np.abs(r - np.median(r)))
        if not np.isfinite(s) or s == 0:
            break
        w = 1 / np.maximum(np.abs(r) / (s * c), 1)
        xm, ym = np.average(x, weights=w), np.average(y, weights=w)
        m2 = np.sum(w * (x - xm) * (y - ym)) / np.sum(w * (x - xm) ** 2)
        b2 = ym - m2 * xm
        close = max(abs(m2 - m), abs(b2 - b)) < tol * max(1.0, abs(m), abs(b))
        m, b = m2, b2
        if close:
            break
    return float(m), float(b)


def huber_line(samples: DataFrame, x: str, y: str, c: float = 1.345, max_iter: int = 50, tol: float = 1e-8,
               min_points: int = 20, local_rows: int | None = None) -> DataFrame:
    """``trace, slope, intercept, points``; NULL with fewer than ``min_points`` points or a constant ``x``.

    Points with a NULL or NaN are left out.

    Traces of at most ``local_rows`` points are fitted in one task each.  Longer ones
    iterate together: exact MAD of the residuals and weighted sums, both distributed.
    """
    limit = local_rows or LOCAL_ROWS
    ok = samples.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(
        "trace", "i", "chunk", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ok = layout.settle(ok)
    size = layout.settle(ok.groupBy("trace").agg(F.count(F.lit(1)).alias("points"), F.max("chunk").alias("_last"),
                                                   (F.min("_x") < F.max("_x")).alias("_varies")))
    enough = size.where(f"points >= {min_points} and _varies")
    small = layout.spread(ok, enough.where(f"points <= {limit}").select("trace", "_last"))
    kind = samples.schema["trace"].dataType.simpleString()

    def fit_one(pdf):
        m, b = _line(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), c, max_iter, tol)
        return pd.DataFrame({"trace": [pdf["trace"].iloc[0]], "slope": [m], "intercept": [b]})

    lines = layout.by_group(small, "trace").groupBy("trace").applyInPandas(fit_one, f"trace {kind}, slope double, intercept double")
    big = enough.where(f"points > {limit}").select("trace", "_last")
    if not big.isEmpty():
        lines = lines.unionByName(_huber_rounds(layout.settle(layout.spread(ok, big)), c, max_iter, tol))
    return layout.settle(size.select("trace", "points").join(lines, "trace", "left"))


def _huber_rounds(rows: DataFrame, c: float, max_iter: int, tol: float) -> DataFrame:
    model = polyfit.fit(rows, "_x", "_y", 1)
    pair = ["trace", F.col("coeffs")[0].alias("intercept"), F.col("coeffs")[1].alias("slope"), "_last"]
    lines = layout.settle(model.select(*pair).withColumn("_on", F.lit(True)))
    for _ in range(max_iter):
        live = lines.where("_on")
        if live.isEmpty():
            break
        res = layout.spread(rows, live.select("trace", "slope", "intercept", "_last")).withColumn(
            "_r", F.col("_y") - F.col("slope") * F.col("_x") - F.col("intercept"))
        res = layout.settle(res.drop("slope", "intercept"))
        scale = mad(res.select("trace", "i", "chunk", "_r"), ["trace"], "_r", layout.spread).where("sigma > 0")
        scale = layout.settle(scale.select("trace", "sigma").join(live.select("trace", "_last"), "trace"))
        wide = layout.spread(res, scale).withColumn("_wt", 1 / F.greatest(F.abs("_r") / (F.col("sigma") * c), F.lit(1.0)))
        new = polyfit.fit(wide, "_x", "_y", 1, "_wt").select(
            "trace", F.col("coeffs")[0].alias("_b"), F.col("coeffs")[1].alias("_m"))
        step = lines.join(new, "trace", "left")
        change = F.greatest(F.abs(F.col("_m") - F.col("slope")), F.abs(F.col("_b") - F.col("intercept")))
        still = F.coalesce(change >= tol * F.greatest(F.lit(1.0), F.abs("slope"), F.abs("intercept")), F.lit(False))
        lines = layout.settle(step.select(
            "trace", F.coalesce("_b", "intercept").alias("intercept"), F.coalesce("_m", "slope").alias("slope"), "_last",
            (F.col("_on") & still).alias("_on")))
    return lines.select("trace", "slope", "intercept")


def compliance(samples: DataFrame, position: str, force: str, model: tuple, before: str, after: str, state: str,
               variable: int = 0, padding: int = 100, end_points: int = 800, **options) -> tuple[DataFrame, DataFrame]:
    """True stiffness from force against position minus model extension, and corrected extension.

    The model's ``variable`` component takes the contour length in column ``state``.  The
    last ``end_points`` samples up to ``after`` are used, or, when fewer lie ``padding``
    past ``before``, all of those.
    """
    lp, _, *rest = model[variable]
    eps = wlc.relative_extension(F.col(force), lp, rest[0] if rest else None)
    known = [c for k, c in enumerate(model) if k != variable]
    tether = F.col(state) * eps + (wlc.extension(F.col(force), *known) if known else 0.0)
    start = F.when(F.col(after) + 1 - F.col(before) - padding > end_points, F.col(after) + 1 - end_points).otherwise(
        F.col(before) + padding)
    part = samples.where((F.col("i") >= start) & (F.col("i") <= F.col(after))).withColumn("_free", F.col(position) - tether)
    lines = huber_line(part, "_free", force, **options).select("trace", F.col("slope").alias("stiffness"))
    sizes = samples.groupBy("trace").agg(F.max("n").alias("n"))
    out = layout.spread(samples, layout.settle(lines.join(sizes, "trace")))
    return lines, out.withColumn("corrected", F.col(position) - F.try_divide(F.col(force), F.col("stiffness")))
