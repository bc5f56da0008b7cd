"""Slow drift of extension and trap position."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespool.operators import filters, polyfit, runs, sets
from tracespool.operators.stats import mad
from tracespool.plans import layout


def velocity_drift(samples: DataFrame, value: str, rate: float, smooth_time: float = 1.0,
                   mad_factor: float = 5.0, order: int = 1) -> DataFrame:
    """Add ``drift`` and ``corrected``: velocity spikes screened out by MAD, then integrated.

    The drift is the integral of a polynomial of degree ``order - 1`` through the negated
    velocities of the smoothed signal that lie within ``mad_factor`` MADs of their median.
    Traces of fewer than two widths and two samples have no velocity and are left out.
    """
    width = int(smooth_time * rate)
    base = samples.select("trace", "i", "n", "chunk", value)
    # no window kept here leaves the trace, so short traces need no reflected ends
    low = filters.triangle(base, [value], width).where(f"i >= {width} and i < n - {width}")
    vel = layout.sliding(low, 0, 1, {"_v": lambda w, f: (F.lead(value).over(w) - F.col(value)) * rate})
    vel = layout.settle(vel.where(f"i < n - {width} - 1").select(
        "trace", "i", "n", "chunk", ((F.col("i") + 0.5) / rate).alias("_t"), "_v"))
    lim = mad(vel.drop("n"), ["trace"], "_v", layout.spread)
    sizes = vel.groupBy("trace").agg(F.max("n").alias("_size"))
    lim = layout.settle(lim.drop("n").join(sizes, "trace").select(
        "trace", F.col("_size").alias("n"), "median", "mad"))
    good = layout.spread(vel, lim).where(F.abs(F.col("_v") - F.col("median")) < mad_factor * F.col("mad"))
    model = polyfit.fit(good.withColumn("_neg", -F.col("_v")), "_t", "_neg", order - 1)
    rates = layout.settle(model.select("trace", "coeffs").join(
        samples.groupBy("trace").agg(F.max("n").alias("n")), "trace"))
    t = F.col("i") / rate
    terms = [F.get("coeffs", F.lit(k)) * F.pow(t, F.lit(k + 1)) / (k + 1) for k in range(order)]
    total = terms[0]
    for extra in terms[1:]:
        total = total + extra
    out = layout.spread(samples, rates).withColumn("drift", total).drop("coeffs")
    return out.withColumn("corrected", F.col(value) + F.col("drift"))


def trap_drift_signal(channels: str, bead1: Column, bead2: Column, f1: Column, f2: Column, k1: Column, k2: Column,
                      trap: Column, slope: Column) -> Column:
    """Trap separation seen by the camera minus the commanded position."""
    centre1, centre2 = bead1 - f1 / k1 / 1000, bead2 - f2 / k2 / 1000
    if channels == "both":
        return centre1 - centre2 - trap * slope
    if channels == "1x":
        return centre1 - trap * slope
    if channels == "2x":
        return -centre2
    raise ValueError("channels must be both, 1x or 2x")


def passive_drift(samples: DataFrame, modes: DataFrame, time: str, signal: str, order: int = 1,
                  edge: float = 0.1) -> DataFrame:
    """Shared polynomial through all pauses of a trace, each pause with its own offset.

    Subtracting each pause's means leaves plain least squares for the shared terms, so
    sums per pause and then per trace are enough.  Gives ``trace, n, t0, coeffs`` with
    coefficients of ``(t - t0)^1..order``.
    """
    t0 = samples.groupBy("trace").agg(F.max("n").alias("n"), F.min_by(time, "i").alias("t0"))
    t0 = layout.settle(t0)
    pauses = modes.where("mode = 'pause'").select(
        "trace", "start", F.col("last").alias("stop"), F.struct("k", "t_start", "t_stop").alias("pause"))
    inside = runs.assign(samples.select("trace", "i", "n", "chunk", time, signal), pauses, "pause")
    # the pause's last sample closes it, but lies inside the trimmed edge
    inside = inside.where((F.col(time) >= F.col("pause.t_start") + edge) & (F.col(time) <= F.col("pause.t_stop") - edge)
                          & F.col(signal).isNotNull())
    rows = layout.spread(inside, t0).withColumn("_u", F.col(time) - F.col("t0"))
    p = range(1, order + 1)
    x = {j: F.pow("_u", F.lit(j)) for j in range(1, 2 * order + 1)}
    per = rows.groupBy("trace", "pause").agg(
        F.count(F.lit(1)).alias("m"), F.avg(signal).alias("_y"), *[F.avg(x[j]).alias(f"_x{j}") for j in p],
        *[F.sum(x[j]).alias(f"_s{j}") for j in x], *[F.sum(x[j] * F.col(signal)).alias(f"_r{j}") for j in p])
    gram = [F.sum(F.col(f"_s{j + k}") - F.col("m") * F.col(f"_x{j}") * F.col(f"_x{k}")) for j in p for k in p]
    right = [F.sum(F.col(f"_r{j}") - F.col("m") * F.col(f"_x{j}") * F.col("_y")) for j in p]
    sums = per.groupBy("trace").agg(F.array(*gram).alias("_g"), F.array(*right).alias("_b"),
                                    F.sum("m").alias("points"), F.count(F.lit(1)).alias("pauses"))
    kind = samples.schema["trace"].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            out = [np.linalg.lstsq(np.reshape(g, (order, order)), np.asarray(b), rcond=None)[0].tolist()
                   for g, b in zip(pdf["_g"], pdf["_b"])]
            yield pd.DataFrame({"trace": pdf["trace"], "points": pdf["points"], "pauses": pdf["pauses"], "coeffs": out})

    fits = sums.where(f"points > {order} + pauses").mapInPandas(
        solve, f"trace {kind}, points bigint, pauses bigint, coeffs array<double>")
    return layout.settle(fits.join(t0, "trace"))


def correct_spatial(samples: DataFrame, fits: DataFrame, time: str, value: str, slope: Column | None = None,
                    only_positive: bool = False, min_velocity: float = -1.5e-5, order: int = 1) -> DataFrame:
    """Add ``drift`` and ``corrected``.  With ``only_positive`` a trace whose drift ever runs
    faster than ``min_velocity`` downwards is left uncorrected."""
    k = F.lit(1.0) if slope is None else slope
    u = F.col(time) - F.col("t0")
    drift = sum((F.get("coeffs", F.lit(p - 1)) * F.pow(u, F.lit(p)) for p in range(1, order + 1)), F.lit(0.0)) / k
    speed = sum((p * F.get("coeffs", F.lit(p - 1)) * F.pow(u, F.lit(p - 1)) for p in range(1, order + 1)), F.lit(0.0)) / k
    rows = layout.spread(samples, fits.select("trace", "n", "t0", "coeffs"))
    rows = rows.withColumn("drift", drift).withColumn("drift_velocity", speed).drop("t0", "coeffs")
    if only_positive:
        rows = layout.settle(rows)
        low = rows.groupBy("trace").agg(F.max("n").alias("n"), F.min("drift_velocity").alias("_min"))
        rows = layout.spread(rows, low).withColumn(
            "drift", F.when(F.col("_min") < min_velocity, 0.0).otherwise(F.col("drift"))).drop("_min")
    return rows.withColumn("corrected", F.col(value) + F.col("drift"))


# Recordings that follow each passive recording of a set, in order of measurement.
FOLLOWERS = {"01": ["fecS01", "fecS02", "fecS03", "spm02", "dct02"], "02": ["fecS03"]}


def set_offsets(own: DataFrame) -> DataFrame:
    """Offset of every later recording of a set from the drift at the end of its passive ones.

    ``own`` is ``base, run, offset`` with the drift gathered in each passive recording
    itself; the second recording starts from the first one's offset, so offsets add up.
    """
    number = F.regexp_extract("run", r"^(?:dct|spm)(\d\d)$", 1)
    later = F.when(number == "01", F.array(*[F.lit(r) for r in FOLLOWERS["01"]])).when(
        number == "02", F.array(*[F.lit(r) for r in FOLLOWERS["02"]]))
    pushed = own.select("base", F.explode(later).alias("run"), "offset")
    return pushed.groupBy("base", "run").agg(F.sum("offset").alias("offset"))


def apply_set_offsets(samples: DataFrame, offsets: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Shift extension and trap position of recordings by their set's offset."""
    return sets.apply_offsets(samples, offsets, cols)
