"""Peaks, transitions, tether rupture, states and pauses of ideal traces."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespool.operators import filters, runs, sets
from tracespool.operators.stats import mad
from tracespool.plans import layout


def local_maxima(samples: DataFrame, value: str, rows: int | None = None) -> DataFrame:
    """``trace, at, height`` of strict maxima; a flat top counts once, at its middle."""
    tops = runs.dwells(samples, value, rows)
    flagged = layout.sliding(runs.as_rows(tops, rows), 1, 1, {
        "_up": lambda w, f: F.lag("level").over(w) < F.col("level"),
        "_down": lambda w, f: F.lead("level").over(w) < F.col("level")}, rows)
    return flagged.where("_up and _down").select(
        "trace", F.expr("(start + stop - 1) div 2").alias("at"), F.col("level").alias("height"))


def _ranked(peaks: DataFrame, rows: int | None) -> DataFrame:
    size = rows or layout.CHUNK_ROWS
    out = layout.running_sum(peaks.withColumn("chunk", F.expr(f"at div {size}L")), {"_r": F.lit(1)}, order=["at"])
    return layout.with_chunk(out.withColumn("i", F.expr("cast(_r - 1 as bigint)")).drop("_r"), rows)


LOCAL_ROWS = 1 << 20  # groups up to this size are settled inside one task


def thin_peaks(peaks: DataFrame, distance: int, rows: int | None = None, local_rows: int | None = None,
               max_rounds: int = 200) -> DataFrame:
    """Drop peaks closer than ``distance`` to a higher kept peak; equal heights keep the later.

    Peaks influence each other only along chains of short gaps.  Chains of at most
    ``local_rows`` peaks are settled in one task each, from the highest peak down.
    Longer chains go through rounds over windows: a peak that is highest in its
    neighbourhood is kept and clears it, which breaks the chain into shorter ones.
    Peaks without a height (NULL or NaN) are left out first.
    """
    peaks = peaks.where(F.col("height").isNotNull() & ~F.isnan(F.col("height").cast("double")))
    if distance <= 1:
        return peaks
    limit = local_rows or LOCAL_ROWS
    done, left = None, layout.settle(peaks)
    for _ in range(max_rounds):
        part = layout.settle(_chains(left, distance, rows))
        size = part.groupBy("trace", "_part").agg(F.count(F.lit(1)).alias("_m"))
        long = layout.settle(size.where(f"_m > {limit}"))
        short = part.join(long, ["trace", "_part"], "left_anti")
        kept = layout.by_group(short, "trace", "_part").groupBy("trace", "_part").applyInPandas(
            _greedy(distance - 1), peaks.select("trace", "at", "height").schema)
        done = kept if done is None else done.unionByName(kept)
        if long.isEmpty():
            return layout.settle(done)
        rest = part.join(long, ["trace", "_part"], "left_semi").select("trace", "at", "height")
        won, left = _clear_round(rest, distance, rows)
        done = done.unionByName(won)
    raise RuntimeError("peak thinning did not settle; raise local_rows or max_rounds")


def _chains(peaks: DataFrame, distance: int, rows: int | None) -> DataFrame:
    apart = layout.sliding(_ranked(peaks, rows), 1, 0, {
        "_cut": lambda w, f: F.coalesce((F.col("at") - F.lag("at").over(w) >= distance).cast("bigint"), F.lit(1))}, rows)
    return layout.running_sum(apart, {"_part": "_cut"}).select("trace", "_part", "at", "height")


def _clear_round(peaks: DataFrame, distance: int, rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Keep local winners; return them and the peaks none of them suppresses."""
    reach = distance - 1  # positions are integers: at most this many peaks on a side
    near = lambda a: F.abs(a - F.col("at")) < distance
    win = layout.sliding(_ranked(peaks, rows), reach, reach, {
        "_w": lambda w, f: F.collect_list(F.struct("height", "at")).over(f)}, rows)
    best = F.array_max(F.filter("_w", lambda p: near(p["at"])))
    top = layout.settle(win.withColumn("_top", best == F.struct("height", "at")).select("trace", "at", "height", "_top"))
    seen = layout.sliding(_ranked(top, rows), reach, reach, {
        "_w": lambda w, f: F.collect_list(F.when(F.col("_top"), F.col("at"))).over(f)}, rows)
    left = layout.settle(seen.where(~F.exists("_w", near)).select("trace", "at", "height"))
    return top.where("_top").select("trace", "at", "height"), left


def _greedy(reach: int):
    def settle_chain(pdf):
        pdf = pdf.sort_values("at")
        at, height = pdf["at"].to_numpy(), pdf["height"].to_numpy()
        free, keep = np.ones(len(at), bool), np.zeros(len(at), bool)
        for p in np.lexsort((at, height))[::-1]:
            if free[p]:
                keep[p] = True
                lo, hi = np.searchsorted(at, [at[p] - reach, at[p] + reach + 1])
                free[lo:hi] = False
        return pdf.loc[keep, ["trace", "at", "height"]]

    return settle_chain


def force_drops(samples: DataFrame, force: str, threshold: float = 0.5, distance: int = 5, window: int = 5,
                rows: int | None = None) -> DataFrame:
    """Peaks followed by a drop above ``threshold`` within ``window`` samples."""
    peaks = thin_peaks(local_maxima(samples, force, rows), distance, rows=rows)
    low = layout.sliding(samples.select("trace", "i", "n", "chunk", force), 0, window - 1,
                         {"_low": lambda w, f: F.min(force).over(f)}, rows)
    hit = peaks.join(low.select("trace", F.col("i").alias("at"), "_low"), ["trace", "at"])
    return hit.withColumn("drop", F.col("height") - F.col("_low")).where(F.col("drop") > threshold).drop("_low")


def transitions(samples: DataFrame, force: str, cutoff: float = 2.0, threshold: float = 0.5, distance: int = 5,
                window: int = 5, add_rupture: bool = True, rows: int | None = None) -> DataFrame:
    """Transition positions per trace: force drops above ``cutoff``, then the last sample.

    Samples below the cutoff are removed first, so distances count the remaining ones.
    The last sample is always listed for a trace without drops.
    """
    high = layout.settle(layout.reindex(samples.where(F.col(force) > cutoff).select(
        "trace", "i", "n", "chunk", force), rows, keep="src"))
    drops = force_drops(high, force, threshold, distance, window, rows)
    found = drops.join(high.select("trace", F.col("i").alias("at"), "src"), ["trace", "at"]).select(
        "trace", F.col("src").alias("at"), F.lit(False).alias("is_end"))
    found = layout.settle(found)
    ends = samples.groupBy("trace").agg((F.max("n") - 1).alias("at")).withColumn("is_end", F.lit(True))
    if not add_rupture:
        ends = ends.join(found.select("trace").distinct(), "trace", "left_anti")
    size = rows or layout.CHUNK_ROWS
    both = found.unionByName(ends).withColumn("chunk", F.expr(f"at div {size}L"))
    out = layout.running_sum(both, {"_r": F.lit(1)}, order=["at"])
    return out.select("trace", F.expr("cast(_r - 1 as bigint)").alias("k"), "at", "is_end")


def tether_rupture(samples: DataFrame, force: str, base_points: int, min_force: float, smooth: int,
                   curve: str = "curve_type", max_force: float | None = None) -> DataFrame:
    """Position where the tether breaks, per trace.

    Seen from the detached end: the smoothed force first rises faster than three
    deviations of the base slope, above ``min_force``; from there it is climbed to the
    first sample that does not increase.  Without ``max_force`` the highest raw force
    after that position is taken; with it, the walk continues down to ``max_force``.
    """
    turned = F.col(curve) != "R"
    back = layout.settle(sets.flip(samples.select("trace", "i", "n", "chunk", curve, force), turned))
    low = layout.settle(filters.boxcar_smooth(back.select("trace", "i", "n", "chunk", force), [force], smooth))
    slope = filters.derivative(low, force)
    slope = layout.settle(layout.sliding(slope, 0, 1, {
        "_next": lambda w, f: F.lead(force).over(w)}).select("trace", "i", "n", "chunk", force, "slope", "_next"))
    base = F.when(F.col("i").between(smooth, base_points), F.col("slope"))
    limit = slope.groupBy("trace").agg(F.max("n").alias("n"), (F.avg(base) + 3 * F.stddev_pop(base)).alias("_lim"))
    rise = layout.spread(slope, limit).where((F.col("slope") > F.col("_lim")) & (F.col(force) > min_force))
    first = rise.groupBy("trace").agg(F.min("i").alias("_i0"))
    sizes = slope.groupBy("trace").agg(F.max("n").alias("n"))
    first = layout.settle(sizes.join(first, "trace", "left"))
    flat = F.coalesce(F.col("_next") <= F.col(force), F.lit(True))
    climb = layout.spread(slope, first).where((F.col("i") >= F.col("_i0")) & flat)
    top = climb.groupBy("trace").agg(F.min("i").alias("_top"))
    at = layout.settle(first.join(top, "trace", "left").select("trace", "n", F.coalesce("_top", F.lit(0)).alias("_at")))
    if max_force is not None:
        walk = layout.spread(slope, at).where((F.col("i") >= F.col("_at")) & (F.col(force) <= max_force))
        down = walk.groupBy("trace").agg(F.min("i").alias("_stop"))
        at = layout.settle(at.join(down, "trace", "left").select("trace", "n", F.coalesce("_stop", F.col("n") - 1).alias("_at")))
    kinds = samples.groupBy("trace").agg(F.max(curve).alias(curve))
    own = layout.settle(at.join(kinds, "trace").withColumn(
        "_at", F.when(turned, F.col("n") - 1 - F.col("_at")).otherwise(F.col("_at"))))
    if max_force is not None:
        return own.select("trace", F.col("_at").alias("rupture_index"))
    after = layout.spread(samples, own.drop(curve)).where(F.col("i") >= F.col("_at"))
    return after.groupBy("trace").agg(F.min_by("i", F.struct(-F.col(force), F.col("i"))).alias("rupture_index"))


def states(changes: DataFrame, reference: Column, change: str = "dlc", from_end: bool = False,
           rows: int | None = None) -> DataFrame:
    """Cumulative states of ordered transitions ``trace, k``.

    ``change`` of row k is the step from transition k to k+1 (ignored on the last row).
    States start at ``reference``, or end at it with ``from_end``.
    """
    base = runs.as_rows(changes.withColumn(change, F.coalesce(change, F.lit(0.0))), rows)
    base = layout.sliding(base, 1, 0, {"_prev": lambda w, f: F.coalesce(F.lag(change).over(w), F.lit(0.0))}, rows)
    run = layout.running_sum(base, {"cumulative": "_prev"}).drop("_prev")
    if from_end:
        total = run.groupBy("trace").agg(F.max("k").alias("_m"), F.max_by("cumulative", "k").alias("_total"))
        run = layout.salted(run, total, ["trace"], salt="k")
        value = reference - (F.col("_total") - F.col("cumulative"))
        return run.withColumn("state", value).drop("_m", "_total", "i", "chunk")
    return run.withColumn("state", reference + F.col("cumulative")).drop("i", "chunk")


def ideal_pauses(dwells: DataFrame, mad_factor: float = 5.0) -> DataFrame:
    """Dwells longer than median + factor x MAD of the dwell lengths of their trace."""
    rows = layout.settle(runs.as_rows(dwells).withColumn("_len2", (F.col("stop") - F.col("start")).cast("double")))
    lim = mad(rows.select("trace", "i", "chunk", "_len2"), ["trace"], "_len2", layout.spread)
    lim = lim.select("trace", (F.col("median") + mad_factor * F.col("mad")).alias("threshold"))
    out = layout.salted(rows, lim, ["trace"], salt="k").where("_len2 > threshold")
    return out.select("trace", "start", "stop", "level", "threshold")
