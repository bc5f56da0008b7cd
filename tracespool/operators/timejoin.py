"""Joins on time within a trace, without range joins.

Both sides are put on one time line, cut into slots of a bounded number of rows, and the
nearest neighbours are carried along it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.plans import layout


def _slotted(line: DataFrame) -> DataFrame:
    return layout.slotted(line, ["trace"], ["_ord"])


def nearest(target: DataFrame, source: DataFrame, time: str, cols: Sequence[str],
            tolerance: float | None = None) -> DataFrame:
    """Attach ``cols`` of the nearest source row to each target row, NULL past ``tolerance``.

    A tie goes to the earlier source row.  Source times are unique per trace; ``src_t`` is
    the matched time.
    """
    payload = F.struct(F.col(time).alias("_t"), *cols)
    marks = source.select("trace", F.col(time).alias("_t"), F.lit(1).alias("_kind"), payload.alias("_src"))
    asks = target.select("trace", F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.struct(
        *target.columns).alias("_row"))
    line = marks.unionByName(asks, allowMissingColumns=True).where("_t is not null")
    line = _slotted(line.withColumn("_ord", F.struct("_t", "_kind", F.xxhash64("_row").alias("_h"))))
    both = layout.fill(line, {"_prev": "_src"}, block="_slot", order="_ord")
    both = layout.fill(both, {"_next": "_src"}, block="_slot", order="_ord", backward=True)
    rows = both.where("_kind = 0")
    gap = lambda c: F.abs(F.col(f"{c}._t") - F.col("_t"))
    take_next = F.col("_prev").isNull() | (F.col("_next").isNotNull() & (gap("_next") < gap("_prev")))
    hit = F.when(take_next, F.col("_next")).otherwise(F.col("_prev"))
    if tolerance is not None:
        hit = F.when(F.abs(hit["_t"] - F.col("_t")) <= tolerance, hit)
    return rows.withColumn("_hit", hit).select(
        "_row.*", F.col("_hit._t").alias("src_t"), *[F.col(f"_hit.{c}").alias(c) for c in cols])


def exact_subset(retained: DataFrame, source: DataFrame, time: str, cols: Sequence[str],
                 median_step: float) -> DataFrame:
    """Match retained times to the grid they were taken from; an off-grid time raises."""
    tol = max(1e-12, median_step * 1e-6)
    found = nearest(retained, source, time, cols, tol)
    problem = F.raise_error(F.concat(F.lit("retained time off the source grid in trace "),
                                     F.col("trace").cast("string"))).cast("double")
    return found.withColumn("src_t", F.when(F.col("src_t").isNotNull(), F.col("src_t")).otherwise(problem))


def regions(saved: DataFrame, time: str, step: float) -> DataFrame:
    """Contiguous stretches of saved samples (a gap over 1.5 steps splits), half a step wider."""
    cut = layout.sliding(saved, 1, 0, {"_new": lambda w, f: F.coalesce(
        (F.col(time) - F.lag(time).over(w) > 1.5 * step).cast("bigint"), F.lit(1))})
    runs_ = layout.running_sum(cut, {"_k": "_new"})
    return runs_.groupBy("trace", F.expr("cast(_k - 1 as bigint)").alias("k")).agg(
        (F.min(time) - step / 2).alias("lo"), (F.max(time) + step / 2).alias("hi"))


def within_regions(samples: DataFrame, spans: DataFrame, time: str) -> DataFrame:
    """Samples inside any closed region ``[lo, hi]``; regions of a trace do not overlap."""
    opening = spans.select("trace", F.col("lo").alias("_t"), F.lit(0).alias("_kind"), F.col("hi").alias("_hi"))
    rows = samples.select("trace", F.col(time).alias("_t"), F.lit(1).alias("_kind"),
                          F.struct(*samples.columns).alias("_row"))
    line = opening.unionByName(rows, allowMissingColumns=True)
    line = _slotted(line.withColumn("_ord", F.struct("_t", "_kind", F.xxhash64("_row", "_hi").alias("_h"))))
    filled = layout.fill(line, {"_end": "_hi"}, block="_slot", order="_ord")
    return filled.where("_kind = 1 and _t <= _end").select("_row.*")


def frame_average(frames: DataFrame, fast: DataFrame, time: str, cols: Sequence[str]) -> DataFrame:
    """Mean of fast samples in each frame interval, from a frame's time to the next frame's.

    The last frame has no end and is left out, as are frames without fast samples.
    """
    opening = frames.select("trace", F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.struct(
        *frames.columns).alias("_frame"))
    rows = fast.select("trace", F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.struct(
        *cols).alias("_row"))
    line = opening.unionByName(rows, allowMissingColumns=True)
    line = _slotted(line.withColumn("_ord", F.struct("_t", "_kind", F.xxhash64("_row").alias("_h"))))
    filled = layout.fill(line, {"_in": "_frame"}, block="_slot", order="_ord")
    last = frames.groupBy("trace").agg(F.max(time).alias("_end"))
    means = filled.where("_kind = 1 and _in is not null").groupBy("trace", "_in").agg(
        *[F.avg(f"_row.{c}").alias(c) for c in cols], F.count(F.lit(1)).alias("points"))
    out = means.join(last, "trace").where(F.col(f"_in.{time}") < F.col("_end"))
    return out.select("_in.*", *cols, "points")


def interpolate(grid: DataFrame, source: DataFrame, x: str, y: str) -> DataFrame:
    """Linear interpolation of ``y`` at the grid's ``x``; ends are held constant."""
    marks = source.select("trace", F.col(x).alias("_t"), F.lit(0).alias("_kind"),
                          F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("_src"))
    asks = grid.select("trace", F.col(x).alias("_t"), F.lit(1).alias("_kind"), F.struct(*grid.columns).alias("_row"))
    line = marks.unionByName(asks, allowMissingColumns=True)
    line = _slotted(line.withColumn("_ord", F.struct("_t", "_kind", F.xxhash64("_row").alias("_h"))))
    both = layout.fill(line, {"_a": "_src"}, block="_slot", order="_ord")
    both = layout.fill(both, {"_b": "_src"}, block="_slot", order="_ord", backward=True).where("_kind = 1")
    frac = F.try_divide(F.col("_t") - F.col("_a.x"), F.col("_b.x") - F.col("_a.x"))
    value = F.coalesce(F.when(F.col("_b").isNull() | (F.col("_a.x") == F.col("_t")), F.col("_a.y")),
                       F.when(F.col("_a").isNull(), F.col("_b.y")),
                       F.col("_a.y") + frac * (F.col("_b.y") - F.col("_a.y")))
    return both.select("_row.*", value.alias(y))
