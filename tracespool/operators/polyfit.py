"""Polynomial least squares per trace from distributed sums.

The position is scaled to [-1, 1] and expanded in Legendre polynomials, whose normal
equations stay well conditioned at high degree.  Spark sums the products per trace; the
small systems are then solved row by row.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from numpy.polynomial import legendre
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespool.plans import layout


def basis(u: Column, degree: int) -> Column:
    """Array of Legendre polynomials 0..degree at ``u``."""
    if degree == 0:
        return F.array(F.lit(1.0))
    if degree == 1:
        return F.array(F.lit(1.0), u)
    orders = F.sequence(F.lit(1), F.lit(degree - 1))
    return F.aggregate(orders, F.array(F.lit(1.0), u), lambda acc, k: F.array_append(
        acc, ((2 * k + 1) * u * F.get(acc, k) - k * F.get(acc, k - 1)) / (k + 1)))


def fit(samples: DataFrame, x: str, y: str, degree: int, weight: str | None = None) -> DataFrame:
    """One row per trace: ``coeffs`` (ascending in x), ``r2``, ``sse``, ``m`` and helper columns.

    Rows with a NULL in x or y are left out.  ``coeffs`` are exact to rounding for
    moderate degrees; `predict` uses the Legendre form and has no such limit.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    ok = samples.select("trace", "chunk", F.when(both, F.col(x)).cast("double").alias("_x"),
                        F.when(both, F.col(y)).cast("double").alias("_y"),
                        (F.col(weight) if weight else F.lit(1.0)).alias("_w"))
    span = layout.settle(ok.groupBy("trace").agg(
        F.max("chunk").alias("_end"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.avg("_y").alias("_ybar")))
    rows = layout.spread(ok.where("_x is not null"), span.withColumn("_last", F.col("_end")))
    mid, half = (F.col("_lo") + F.col("_hi")) / 2, (F.col("_hi") - F.col("_lo")) / 2
    rows = rows.withColumn("_half", F.when(half == 0, 1.0).otherwise(half)).withColumn("_mid", mid)
    rows = rows.withColumn("_b", basis((F.col("_x") - F.col("_mid")) / F.col("_half"), degree))
    p = degree + 1
    dy = F.col("_y") - F.col("_ybar")
    b = [F.get("_b", F.lit(k)) for k in range(p)]
    gram = [F.sum(F.col("_w") * b[j] * b[k]) for j in range(p) for k in range(j, p)]
    right = [F.sum(F.col("_w") * b[j] * dy) for j in range(p)]
    sums = rows.groupBy("trace", "_mid", "_half", "_ybar", "_end").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("_w") * dy * dy).alias("_yy"),
        F.sum("_w").alias("_sw"), F.sum(F.col("_w") * dy).alias("_wy"),
        F.array(*gram).alias("_g"), F.array(*right).alias("_r"))
    upper = [(j, k) for j in range(p) for k in range(j, p)]
    kind = samples.schema["trace"].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                row = dict(zip(pdf.columns, r))
                g = np.zeros((p, p))
                for v, (j, k) in zip(row["_g"], upper):
                    g[j, k] = g[k, j] = v
                rhs = np.asarray(row["_r"], float)
                inv = np.linalg.pinv(g, rcond=1e-14, hermitian=True)
                c = inv @ rhs
                sse = max(row["_yy"] - 2 * c @ rhs + c @ g @ c, 0.0)
                sst = row["_yy"] - row["_wy"] ** 2 / row["_sw"]
                poly = np.polynomial.Polynomial(legendre.leg2poly(c))
                raw = poly(np.polynomial.Polynomial([-row["_mid"] / row["_half"], 1 / row["_half"]])).coef
                raw = np.pad(raw, (0, p - len(raw)))
                raw[0] += row["_ybar"]
                c[0] += row["_ybar"]
                out.append((row["trace"], row["m"], raw.tolist(), 1 - sse / sst if sst > 0 else None, sse,
                            c.tolist(), inv.ravel().tolist(), row["_mid"], row["_half"], row["_end"]))
            yield pd.DataFrame(out, columns=["trace", "m", "coeffs", "r2", "sse", "_leg", "_inv", "_mid", "_half", "_last"])

    return layout.settle(sums.mapInPandas(solve, f"trace {kind}, m bigint, coeffs array<double>, r2 double, sse double, "
                         "_leg array<double>, _inv array<double>, _mid double, _half double, _last bigint"))


def _attach(samples: DataFrame, model: DataFrame, x: str, degree: int) -> DataFrame:
    joined = layout.spread(samples, model)
    return joined.withColumn("_b", basis((F.col(x) - F.col("_mid")) / F.col("_half"), degree))


def predict(samples: DataFrame, model: DataFrame, x: str, degree: int, out: str = "predicted") -> DataFrame:
    """Model value at each sample of the same traces (any position)."""
    rows = _attach(samples, model.select("trace", "_leg", "_mid", "_half", "_last"), x, degree)
    value = F.aggregate(F.zip_with("_b", "_leg", lambda a, c: a * c), F.lit(0.0), lambda a, v: a + v)
    return rows.withColumn(out, value).drop("_b", "_leg", "_mid", "_half")


def residuals(samples: DataFrame, model: DataFrame, x: str, y: str, degree: int) -> DataFrame:
    """Add ``residual`` and internally studentised ``studentised``, from each row's leverage."""
    p = degree + 1
    rows = _attach(samples, model.select("trace", "_leg", "_inv", "_mid", "_half", "_last", "m", "sse"), x, degree)
    value = F.aggregate(F.zip_with("_b", "_leg", lambda a, c: a * c), F.lit(0.0), lambda a, v: a + v)
    idx = F.sequence(F.lit(0), F.lit(p * p - 1))
    lever = F.aggregate(idx, F.lit(0.0), lambda a, k: a + F.get("_inv", k) * F.get(
        F.col("_b"), F.floor(k / p).cast("int")) * F.get(F.col("_b"), k % p))
    rows = rows.withColumn("residual", F.col(y) - value).withColumn("leverage", lever)
    scale = F.sqrt(F.try_divide("sse", F.col("m") - p) * (1 - F.col("leverage")))
    return rows.withColumn("studentised", F.col("residual") / F.when(scale > 0, scale)).drop(
        "_b", "_leg", "_inv", "_mid", "_half", "m", "sse")


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution with an integer number of degrees."""
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) / math.sqrt(math.pi * half) if half > 0 else 0.0
    for k in range(1, (df - 1) // 2 + 1):
        term *= half / (k - 0.5)
        total += term
    return total


def breusch_pagan(samples: DataFrame, x: str, y: str, degree: int, level: float = 0.05) -> DataFrame:
    """Regress squared residuals on the design: ``lm``, ``p_value`` and ``heteroscedastic`` (0/1)."""
    model = fit(samples, x, y, degree)
    res = residuals(samples, model, x, y, degree).select(
        "trace", "chunk", F.col(x).alias("x"), (F.col("residual") * F.col("residual")).alias("r2"))
    second = fit(res, "x", "r2", degree)
    tail = F.udf(lambda v: None if v is None else _chi2_tail(v, degree), "double")  # one value per trace
    lm = second.select("trace", (F.col("m") * F.col("r2")).alias("lm"))
    return lm.withColumn("p_value", tail("lm")).withColumn(
        "heteroscedastic", (F.col("p_value") < level).cast("int"))


def detrend(samples: DataFrame, y: str, degree: int = 3, x: str | None = None) -> DataFrame:
    """Add polynomial ``baseline`` and ``detrended``; the position defaults to the index."""
    pos = F.col(x) if x else F.col("i").cast("double")
    rows = samples.withColumn("_pos", pos)
    model = fit(rows, "_pos", y, degree)
    out = predict(rows, model, "_pos", degree, "baseline")
    return out.withColumn("detrended", F.col(y) - F.col("baseline")).drop("_pos")


def remove_instability(samples: DataFrame, channel: str, reference: str, degree: int = 31,
                       compat: bool = False) -> DataFrame:
    """Subtract the slow part of what a reference channel does not explain.

    The channel is regressed on the reference; ``compat`` regresses the other way round.
    """
    left, right = (reference, channel) if compat else (channel, reference)
    line = layout.settle(samples.groupBy("trace").agg(
        F.max("n").alias("n"), F.regr_slope(left, right).alias("_a"), F.regr_intercept(left, right).alias("_c")))
    rows = layout.spread(samples, line).withColumn(
        "_r", F.col(channel) - (F.col("_a") * F.col(reference) + F.col("_c"))).drop("_a", "_c")
    out = detrend(layout.settle(rows), "_r", degree)
    return out.withColumn("corrected", F.col(channel) - F.col("baseline")).drop("_r", "detrended")
