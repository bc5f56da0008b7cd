"""Distributions, robust statistics and quality filters."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespool.functions import wlc
from tracespool.operators import runs
from tracespool.operators.quantiles import exact_quantiles
from tracespool.plans import layout

Attach = Callable[[DataFrame, DataFrame], DataFrame]


def by_bins(keys: Sequence[str]) -> Attach:
    """Attach for groups whose number is a parameter (bins): their table is broadcast."""
    return lambda rows, table: rows.join(F.broadcast(table), list(keys))


def pooled(df: DataFrame) -> DataFrame:
    """One constant group over all rows."""
    return df.withColumn("_all", F.lit(0))


def mad(df: DataFrame, keys: Sequence[str], value: str, attach: Attach) -> DataFrame:
    """``keys, n, median, mad, sigma``; sigma is 1.4826 MAD.  NaN and infinities are ignored."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    med = exact_quantiles(finite, keys, value, [0.5], attach)
    med = layout.settle(med.withColumn("median", F.col("q")[0]).drop("q"))
    base = finite.drop("n") if "n" in finite.columns else finite
    dev = attach(base, med).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    out = exact_quantiles(dev, keys, "_dev", [0.5], attach).select(*keys, F.col("q")[0].alias("mad"))
    return med.drop("_last").join(out, list(keys)).withColumn("sigma", 1.4826 * F.col("mad"))


def clip_symmetric(df: DataFrame, keys: Sequence[str], value: str, q: float, attach: Attach,
                   out: str = "clipped", center: bool = True) -> DataFrame:
    """Clip to the q-quantile of the distance from the median (or from zero)."""
    if center:
        mid = exact_quantiles(df, keys, value, [0.5], attach).withColumn("_mid", F.col("q")[0]).drop("q")
    else:
        tail = [F.max("chunk").alias("_last")] if "chunk" in df.columns else []
        mid = df.groupBy(*keys).agg(F.count(value).alias("n"), F.max(F.lit(0.0)).alias("_mid"), *tail)
    mid = layout.settle(mid)
    rows = df.drop("n") if "n" in df.columns else df
    dev = attach(rows, mid).withColumn("_dev", F.abs(F.col(value) - F.col("_mid")))
    thr = exact_quantiles(dev.drop("_mid"), keys, "_dev", [q], attach).select(
        *keys, F.col("q")[0].alias("_thr"))
    lim = layout.settle(mid.join(thr, list(keys)))
    lo, hi = F.col("_mid") - F.col("_thr"), F.col("_mid") + F.col("_thr")
    keep_n = "n" in df.columns
    joined = attach(df.withColumnRenamed("n", "_len") if keep_n else df, lim)
    joined = joined.drop("n").withColumnRenamed("_len", "n") if keep_n else joined.drop("n")
    joined = joined.withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(F.least(value, hi), lo)))
    return joined.drop("_mid", "_thr")


def tukey_fence(df: DataFrame, keys: Sequence[str], value: str, attach: Attach) -> DataFrame:
    q = exact_quantiles(df, keys, value, [0.25, 0.75], attach)
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select(*keys, F.col("q")[0].alias("q1"), (F.col("q")[0] - 1.5 * iqr).alias("lower"),
                    (F.col("q")[1] + 1.5 * iqr).alias("upper"))


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sorted distinct values and the share of observations at or below each."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(
        *keys, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("_c"))
    slots = layout.add_slots(counts, keys, ["x"], salt="x").drop("n")
    run = layout.running_sum(slots, {"_cum": "_c"}, keys=keys, block="_slot", order=["x"])
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    return layout.salted(run, total, keys, salt="x").select(
        *keys, "x", (F.col("_cum") / F.col("_n")).alias("cdf"))


def bin_index(x: Column, lo: Column, width: Column) -> Column:
    """Number of edges ``lo + k width`` at or below x, minus one, exact at the edges."""
    k = F.floor((x - lo) / width)
    up = (lo + (k + 1) * width <= x).cast("bigint")
    down = (lo + k * width > x).cast("bigint")
    return k + up - down


def residence_time(samples: DataFrame, value: str, width: float, dt: float = 1.0) -> DataFrame:
    """Time spent per uniform bin from the minimum up; empty bins are listed too.

    The bin that only holds the final edge is dropped, so a maximum that lies exactly
    on it is not counted.
    """
    ends = samples.groupBy("trace").agg(F.max("chunk").alias("_last"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    w = F.lit(float(width))
    bins = (F.ceil((F.col("_hi") + w - F.col("_lo")) / w) - 1).cast("bigint")
    ends = layout.settle(ends.withColumn("_bins", bins))
    rows = layout.spread(samples.drop("n"), ends)
    got = rows.groupBy("trace", bin_index(F.col(value), F.col("_lo"), w).alias("bin")).agg(
        F.count(F.lit(1)).alias("_c"))
    grid = ends.where("_bins > 0").select("trace", "_lo", F.explode(F.expr("sequence(0L, _bins - 1)")).alias("bin"))
    full = grid.join(got, ["trace", "bin"], "left")
    lo = F.col("_lo") + F.col("bin") * w
    return full.select("trace", "bin", (0.5 * (lo + (F.col("_lo") + (F.col("bin") + 1) * w))).alias("center"),
                       (F.coalesce("_c", F.lit(0)) * float(dt)).alias("tau"))


def histogram(df: DataFrame, value: str, bins: int | None = None, density: bool = True) -> DataFrame:
    """Pooled histogram with ``bins`` bins, or Sturges' number; the last bin is closed."""
    n, lo, hi = df.agg(F.count(value), F.min(value), F.max(value)).first()  # one row
    if not n:
        raise ValueError("no values to count")
    b = bins or math.ceil(math.log2(n)) + 1
    w = (hi - lo) / b
    rows = df.select(value).where(F.col(value).isNotNull())
    idx = F.least(bin_index(F.col(value), F.lit(lo), F.lit(w)), F.lit(b - 1)) if w else F.lit(0).cast("bigint")
    got = rows.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    full = df.sparkSession.range(b).withColumnRenamed("id", "bin").join(got, "bin", "left")
    c = F.coalesce("_c", F.lit(0))
    return full.select("bin", (lo + F.col("bin") * w).alias("left_edge"), c.alias("count"),
                       (c / (n * w if w else 1.0)).alias("density"))


def joint_histogram(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """2-D counts with both marginals (NULL marks the summed axis), in one aggregate."""
    binned = df.select(F.floor(F.col(x) / x_width).alias("bx"), F.floor(F.col(y) / y_width).alias("by"))
    return binned.groupingSets([["bx", "by"], ["bx"], ["by"]], "bx", "by").agg(F.count(F.lit(1)).alias("n"))


def binned_summary(df: DataFrame, force: str, value: str, edges: Sequence[float],
                   min_points: int = 2000) -> DataFrame:
    """Median, quartiles and count of ``value`` per force bin; NULL below ``min_points``."""
    grid = F.array(*[F.lit(float(e)) for e in edges])
    idx = F.size(F.filter(grid, lambda e: e <= F.col(force))) - 1
    binned = df.withColumn("bin", idx).where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    q = exact_quantiles(binned, ["bin"], value, [0.5, 0.25, 0.75], by_bins(["bin"]))
    all_bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    out = all_bins.join(F.broadcast(q), "bin", "left")
    enough = F.col("n") >= min_points
    center = F.element_at(grid, F.col("bin") + 1) / 2 + F.element_at(grid, F.col("bin") + 2) / 2
    return out.select("bin", center.alias("center"), *[
        F.when(enough, F.col("q")[k]).alias(c) for k, c in enumerate(("median", "q25", "q75"))],
        F.coalesce("n", F.lit(0)).alias("n"))


def rmsd(samples: DataFrame, measured: Column, predicted: Column, keep: Column | None = None) -> DataFrame:
    """Root mean square deviation per trace over the rows where ``keep`` holds."""
    rows = samples.where(keep) if keep is not None else samples
    return rows.groupBy("trace").agg(
        F.sqrt(F.avg((measured - predicted) * (measured - predicted))).alias("rmsd"),
        F.count(F.lit(1)).alias("points"))


def nominal_rate(samples: DataFrame, time: str) -> DataFrame:
    """1 / median of the time steps that are at most 1.5 times the smallest one."""
    dts = layout.sliding(samples, 1, 0, {"_dt": lambda w, f: F.col(time) - F.lag(time).over(w)})
    dts = layout.settle(dts.where("_dt > 0").select("trace", "i", "n", "chunk", "_dt"))
    low = dts.groupBy("trace").agg(F.max("n").alias("n"), F.min("_dt").alias("_min"))
    regular = layout.spread(dts, low).where("_dt <= 1.5 * _min")
    q = exact_quantiles(regular, ["trace"], "_dt", [0.5], layout.spread)
    return q.select("trace", (1 / F.col("q")[0]).alias("rate"))


def failures(rules: dict[int, Column]) -> Column:
    """Codes of all rules that do not hold, as an array; NULL counts as not holding."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code))
                              for code, ok in rules.items()]), lambda c: c.isNotNull())


def trace_filter(per_trace: DataFrame, size: tuple[float, float], max_initial: float | None = None,
                 min_final: float | None = None, max_rmsd: float = 0.4) -> DataFrame:
    """Add ``codes``: 6 size, 7 initial force, 8 final force, 9 deviation from the model."""
    rules = {6: F.col("size").between(*size)}
    if max_initial is not None:
        rules[7] = F.col("initial_force") < max_initial
    if min_final is not None:
        rules[8] = F.col("final_force") > min_final
    rules[9] = F.col("rmsd") < max_rmsd
    return per_trace.withColumn("codes", failures(rules))


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns become 0."""
    moments = df.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)],
                     *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(cols)]).first()  # one row
    return df.withColumns({c: (F.col(c) - moments[f"m{k}"]) / (moments[f"s{k}"] or 1.0)
                           for k, c in enumerate(cols)})


def pair_distances(samples: DataFrame, value: str, upper: float, bins: int,
                   weight: str | None = None) -> DataFrame:
    """Density of |x_i - x_j| over all ordered pairs of a trace, without forming pairs.

    The count of partners within a distance is a rank difference, so each distinct value
    asks for the running count at value + edge.  Work grows with values x bins.
    ``weight`` weighs a pair by the mean of its two weights.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    ok = samples.where(F.col(value).isNotNull() & ~F.isnan(value))
    vals = layout.settle(ok.groupBy("trace", F.col(value).alias("x")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(w).alias("s")))
    step = upper / bins
    edges = F.array(*[F.lit(step * k if k < bins else float(upper)) for k in range(bins + 1)])
    asks = (vals.select("trace", F.posexplode(edges).alias("k", "e"), "x", F.col("c").alias("ac"),
                        F.col("s").alias("as_"))
            .select("trace", (F.col("x") + F.col("e")).alias("x"), "k", "ac", "as_", F.lit(0).alias("c"),
                    F.lit(0.0).alias("s"), F.when(F.col("k") == bins, 1).otherwise(-1).alias("tag")))
    points = vals.select("trace", "x", F.lit(-1).alias("k"), F.lit(0).alias("ac"), F.lit(0.0).alias("as_"),
                         "c", "s", F.lit(0).alias("tag"))
    # at equal x an edge comes before the points, the closing edge after them
    line = layout.slotted(points.unionByName(asks), ["trace"], ["x"])
    run = layout.running_sum(line, {"_n": "c", "_s": "s"}, block="_slot", order=["x", "tag", "k"])
    # sum over pairs (a, b) with x_b below the edge: partners for ac copies of a
    below = run.where("k >= 0").groupBy("trace", "k").agg(
        F.sum(F.col("ac") * F.col("_n")).alias("pairs"),
        F.sum((F.col("as_") * F.col("_n") + F.col("ac") * F.col("_s")) / 2).alias("mass"))
    same = vals.groupBy("trace").agg(F.sum(F.col("c") * F.col("c")).alias("_sn"),
                                     F.sum(F.col("s") * F.col("c")).alias("_ss"))
    col = "mass" if weight else "pairs"
    tie = "_ss" if weight else "_sn"
    cum = below.groupBy("trace").agg(F.map_from_entries(F.collect_list(F.struct("k", col))).alias("m"))
    out = cum.join(same, "trace").select("trace", "m", tie, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    one_way = F.col("m")[F.col("bin") + 1] - F.col("m")[F.col("bin")]
    both = 2 * one_way - F.when(F.col("bin") == 0, F.col(tie)).otherwise(0)
    total = 2 * (F.col("m")[bins] - F.col("m")[0]) - F.col(tie)
    return out.select("trace", "bin", ((F.col("bin") + 0.5) * step).alias("center"),
                      both.cast("double").alias("weight"), (both / total / step).alias("density"))


def noise_points(samples: DataFrame, lc: str, force: str, width: int = 501, clip_q: float = 0.995,
                 estimator: str = "mad") -> DataFrame:
    """Local noise of a contour-length trace against force, pooled over traces.

    Differences are clipped at a quantile of their size; the running MAD (or deviation)
    is scaled to a standard deviation of single points.
    """
    from tracespool.operators import filters

    dd = layout.sliding(samples.select("trace", "i", "n", "chunk", lc, force), 0, 1, {
        "_d": lambda w, f: F.lead(lc).over(w) - F.col(lc),
        "force_mid": lambda w, f: 0.5 * (F.col(force) + F.lead(force).over(w))})
    dd = layout.settle(dd.where("i < n - 1").select("trace", "i", "n", "chunk", "_d", "force_mid"))
    cut = layout.settle(clip_symmetric(dd, ["trace"], "_d", clip_q, layout.spread, "_c", center=False))
    if estimator == "mad":
        out = filters.running_mad(cut, "_c", width, "sigma").withColumn("sigma", F.col("sigma") / 0.6745 / math.sqrt(2))
    else:
        out = filters.running_std(cut, "_c", width, 1, "sigma").withColumn("sigma", F.col("sigma") / math.sqrt(2))
    return out.where("sigma is not null and force_mid is not null").select("trace", "i", "force_mid", "sigma")


def trace_noise(samples: DataFrame, lc: str, force: str, min_force: float = 4.0, clip_q: float = 0.995) -> DataFrame:
    """One noise estimate per trace from the clipped differences above a force."""
    high = layout.settle(layout.reindex(samples.where(F.col(force) > min_force).select("trace", "i", "n", "chunk", lc)))
    dd = layout.sliding(high, 0, 1, {"_d": lambda w, f: F.lead(lc).over(w) - F.col(lc)})
    dd = layout.settle(dd.where("i < n - 1").select("trace", "i", "n", "chunk", "_d"))
    cut = layout.settle(clip_symmetric(dd, ["trace"], "_d", clip_q, layout.spread, "_c", center=False))
    return mad(cut, ["trace"], "_c", layout.spread).select(
        "trace", (F.col("mad") / 0.6745 / math.sqrt(2)).alias("sigma"))


def stiffness_error(samples: DataFrame, k1: str, k2: str, bead1: str, bead2: str, f1: str, f2: str,
                    trap: str | None = None, force_range: tuple[float, float] = (5.0, 20.0)) -> DataFrame:
    """Ratio of the slope of force against bead position (um) to the nominal stiffness, both traps."""
    x1 = F.col(bead1) - F.col(trap) if trap else F.col(bead1)
    lo, hi = force_range
    ok = (-F.col(f1) > lo) & (F.col(f2) > lo) & (-F.col(f1) < hi) & (F.col(f2) < hi)
    fit = samples.where(ok).groupBy("trace").agg(
        (F.regr_slope(F.col(f1), x1) / 1000 / F.max(k1)).alias("ratio1"),
        (F.regr_slope(F.col(f2), F.col(bead2)) / 1000 / F.max(k2)).alias("ratio2"))
    return fit


def mean_in_range(per_trace: DataFrame, cols: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Overall correction: mean of all values of several columns that lie in a range."""
    rows = per_trace.select(F.explode(F.array(*cols)).alias("v")).where((F.col("v") > lo) & (F.col("v") < hi))
    return rows.agg(F.avg("v").alias("correction"), F.count("v").alias("used"))


def stiffness_change(before: DataFrame, after: DataFrame, cols: Sequence[str] = ("k1", "k2", "keq")) -> DataFrame:
    """After/before ratio of stiffnesses per trace; NULL when one is missing."""
    b = before.select("trace", *[F.col(c).alias(f"_b_{c}") for c in cols])
    joined = b.join(after.select("trace", *cols), "trace", "full")
    return joined.select("trace", *[(F.col(c) / F.when(F.col(f"_b_{c}") != 0, F.col(f"_b_{c}"))).alias(f"{c}_ratio") for c in cols])


def observed_against_predicted(segments: DataFrame, observed: str = "dlc_obs", predicted: str = "dlc_pred") -> DataFrame:
    """Percent error and correction factor of observed contour-length changes."""
    p = F.when(F.col(predicted) != 0, F.col(predicted))
    return segments.withColumn("percent_error", (F.col(observed) - F.col(predicted)) / p * 100).withColumn(
        "correction_factor", F.col(predicted) / F.when(F.col(observed) != 0, F.col(observed)))


def passive_metrics(samples: DataFrame, segments: DataFrame, position: str, distance: str, force: str, reference: float = 7.0,
                    tolerance: float = 0.1, lp: float = 50.0, st: float | None = None) -> DataFrame:
    """Change of extension and contour length from each segment ``trace, k, start, stop`` to the next one of its trace.

    Each segment is read at its sample nearest to the ``reference`` force (the first of equals).  ``dext`` is the change of
    ``position`` between the two, ``dlc_pred`` that change over the relative extension at the reference, and ``dlc_obs`` the change
    of the pointwise contour length from the first of the two samples to the last one before the second.  NULL where a segment does not come
    within ``tolerance`` of the reference, or has no samples.  Percent error and correction factor are added.
    """
    rows = samples.select("trace", "i", "n", "chunk", F.col(position).alias("p"), F.col(distance).alias("d"), F.col(force).alias("f"))
    inside = runs.assign(rows, segments).where("segment is not null and f is not null and not isnan(f)")
    gap = F.abs(F.col("f") - reference)
    near = inside.groupBy("trace", F.col("segment").alias("k")).agg(F.min_by(F.struct("i", "p", gap.alias("gap")), F.struct(gap, F.col("i"))).alias("_at"))
    order = layout.index_samples(segments.select("trace", "k", "start").join(near, ["trace", "k"], "left"), ["start"])
    pairs = layout.sliding(order, 0, 1, {"_k2": lambda w, f: F.lead("k").over(w), "_to": lambda w, f: F.lead("_at").over(w)}).where("_k2 is not null")
    ok = (F.col("_at.gap") <= tolerance) & (F.col("_to.gap") <= tolerance)
    pairs = layout.settle(pairs.select("trace", "k", F.col("_k2").alias("next_k"), F.when(ok, F.col("_at.i")).alias("_a"), F.when(ok, F.col("_to.i") - 1).alias("_b"),
                                       F.when(ok, F.col("_to.p") - F.col("_at.p")).alias("dext")))
    ends = pairs.where("_b >= _a").select("trace", "k", F.explode(F.array("_a", "_b")).alias("i"), "_a").distinct()
    lc = layout.with_chunk(ends).join(rows.drop("n"), ["trace", "chunk", "i"]).withColumn("_lc", F.try_divide("d", wlc.relative_extension(F.col("f"), lp, st)))
    seen = lc.groupBy("trace", "k").agg((F.max_by("_lc", "i") - F.min_by("_lc", "i")).alias("dlc_obs"))
    eps = wlc.relative_extension(F.lit(float(reference)), lp, st)
    out = pairs.join(seen, ["trace", "k"], "left").select("trace", "k", "next_k", "dext", (F.col("dext") / eps).alias("dlc_pred"), "dlc_obs")
    return observed_against_predicted(out)
