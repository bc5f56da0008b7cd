"""Whole jobs from raw channels to annotated, consolidated traces.

Every job is a composition of operators; manual review enters between jobs as tables of
decisions and edits.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespool.functions import ids, physics, wlc
from tracespool.operators import align, detect, filters, legs, polyfit, runs, sets, stats, stepfit
from tracespool.plans import layout
from tracespool.sources import scan


NO_BASELINE, NO_RAMP, BAD_CAMERA = 1, 2, 3  #: error codes of traces without results of their own
TOO_SHORT = 5  #: error code of a trace with too few samples to filter


def _lengths(samples: DataFrame, *more: Column) -> DataFrame:
    return samples.groupBy("trace").agg(F.max("n").alias("n"), *more)


def baseline_models(baselines: DataFrame, ranges: DataFrame, factor: int, rate: float, degree: int,
                    window: float = 0.25) -> DataFrame:
    """Offsets and force polynomials of each baseline recording inside its range.

    ``baselines`` is ``trace, i, n, chunk, trap, f1, f2``; ``ranges`` is ``baseline, lo, hi``.
    """
    low = layout.settle(filters.boxcar_decimate(baselines, ["trap", "f1", "f2"], factor))
    low = low.withColumn("t", F.col("i") * factor / rate)
    early = F.col("t") <= window
    off = _lengths(low, F.avg(F.when(early, F.col("f1"))).alias("off1"), F.avg(F.when(early, F.col("f2"))).alias("off2"))
    off = layout.settle(off.join(ranges.withColumnRenamed("baseline", "trace"), "trace"))
    zeroed = layout.spread(low, off).where((F.col("trap") > F.col("lo")) & (F.col("trap") < F.col("hi")))
    zeroed = layout.settle(zeroed.withColumn("f1", F.col("f1") - F.col("off1")).withColumn("f2", F.col("f2") - F.col("off2")))
    one = polyfit.fit(zeroed, "trap", "f1", degree).select("trace", F.col("coeffs").alias("c1"), F.col("r2").alias("r2_1"))
    two = polyfit.fit(zeroed, "trap", "f2", degree).select("trace", F.col("coeffs").alias("c2"), F.col("r2").alias("r2_2"))
    return layout.settle(off.drop("n").join(one, "trace").join(two, "trace").withColumnRenamed("trace", "baseline"))


def camera_models(camera: DataFrame, ranges: DataFrame, diameters: tuple[float, float] = (0.0, 0.0), degree: int = 1,
                  least_r2: float | None = 0.99) -> DataFrame:
    """Bead separation seen by the camera as a polynomial of the trap position: ``baseline, coeffs, intercept, r2, error_code``.

    ``camera`` is ``trace, i, n, chunk, trap, bead1, bead2`` at the camera's rate, one trace per baseline recording.  The separation is the
    distance of the centres less both radii; frames without it (NULL or exactly 0) and those outside the open range of
    the baseline (``ranges``: ``baseline, lo, hi``) are left out.  A fit below ``least_r2`` (NULL too) has ``error_code`` ``BAD_CAMERA``.
    """
    per = layout.settle(_lengths(camera).join(ranges.withColumnRenamed("baseline", "trace"), "trace"))
    gap = F.col("bead1") - F.col("bead2") - sum(diameters) / 2
    seen = layout.spread(camera, per).withColumn("gap", gap).where((F.col("gap") != 0) & (F.col("trap") > F.col("lo")) & (F.col("trap") < F.col("hi")))
    model = polyfit.fit(layout.settle(seen.select("trace", "i", "chunk", "trap", "gap")), "trap", "gap", degree)
    bad = F.lit(False) if least_r2 is None else ~F.coalesce(F.col("r2") >= least_r2, F.lit(False))
    return layout.settle(model.select(F.col("trace").alias("baseline"), "coeffs", F.col("coeffs")[0].alias("intercept"), "r2",
                                      F.when(bad, BAD_CAMERA).otherwise(0).alias("error_code")))


def calibrated_by_camera(rows: DataFrame, models: DataFrame, offset: bool = False) -> DataFrame:
    """Preprocessed ``rows`` with ``cal_trap`` and ``cal_d`` from the camera's models of their baselines.

    With ``offset``, ``trap`` and ``d`` are moved by the model's intercept as well.  Rows of a baseline whose model is bad get its
    error code (an earlier code stays) and no calibrated values, those without a model no values either.
    """
    known = models.select("baseline", F.col("coeffs").alias("_c"), F.col("intercept").alias("_b"), F.col("error_code").alias("_code"))
    out = layout.salted(rows, known, ["baseline"], "left", "concat(trace, ':', i)")
    good = (F.col("_code") == 0) & (F.col("error_code") == 0)
    cal = F.when(good, physics.polyval(F.col("trap"), F.col("_c")))
    out = out.withColumn("cal_trap", cal).withColumn("cal_d", physics.molecular_extension(F.col("cal_trap"), F.col("bead_diff")))
    if offset:
        out = out.withColumns({c: F.col(c) + F.when(good, F.col("_b")).otherwise(0.0) for c in ("trap", "d")})
    code = F.when(F.col("error_code") == 0, F.coalesce("_code", F.lit(0))).otherwise(F.col("error_code"))
    return out.withColumn("error_code", code).drop("_c", "_b", "_code")


def error_codes(wanted: DataFrame, ramps: DataFrame, rows: DataFrame) -> DataFrame:
    """``trace, error_code`` of every ramp asked for (``trace``): ``NO_RAMP`` without samples, else that of its rows."""
    there = ramps.groupBy("trace").agg(F.lit(0).alias("_there"))
    code = rows.groupBy("trace").agg(F.max("error_code").alias("_code"))
    return wanted.select("trace").distinct().join(there, "trace", "left").join(code, "trace", "left").select(
        "trace", F.when(F.col("_there").isNull(), NO_RAMP).otherwise(F.coalesce("_code", F.lit(0))).alias("error_code"))


def preprocess(ramps: DataFrame, baselines: DataFrame, calpars: DataFrame, factor: int, rate: float, degree: int = 3,
               zero_end: bool = False) -> DataFrame:
    """Baseline-corrected differential force and extension of every ramp.

    ``ramps`` is ``trace, baseline, i, n, chunk, trap, f1, f2``.  Each baseline is modelled
    once.  Ramps without a baseline come back with ``error_code`` 1 and no samples changed, those
    too short to decimate as one row without values and ``error_code`` ``TOO_SHORT``.
    """
    ranges = layout.settle(sets.calibration_range(
        ramps.withColumnRenamed("trap", "pos"), baselines.select(F.col("trace").alias("baseline"), F.col("trap").alias("pos")), "pos"))
    models = baseline_models(baselines, ranges, factor, rate, degree)
    models = models.join(sets.stiffness_pivot(calpars), "baseline", "left")
    low = layout.settle(filters.boxcar_decimate(ramps, ["trap", "f1", "f2"], factor))
    owner = ramps.groupBy("trace").agg(F.max("baseline").alias("baseline"))
    per = layout.settle(_lengths(low).join(owner, "trace").join(models.withColumn("_hit", F.lit(True)), "baseline", "left"))
    rows = layout.spread(low, per).withColumn("t", F.col("i") * factor / rate)
    rows = rows.withColumn("error_code", F.when(F.col("_hit").isNull(), NO_BASELINE).otherwise(0))
    inside = F.col("_hit").isNull() | ((F.col("trap") > F.col("lo")) & (F.col("trap") < F.col("hi")))
    rows = rows.where(inside)
    for c, o, k in (("f1", "off1", "c1"), ("f2", "off2", "c2")):
        rows = rows.withColumn(c, F.when(F.col("_hit"), F.col(c) - F.col(o) - physics.polyval(F.col("trap"), F.col(k))).otherwise(F.col(c)))
    rows = rows.drop("off1", "off2", "c1", "c2", "lo", "hi", "r2_1", "r2_2", "_hit", "src")
    rows = layout.settle(layout.reindex(layout.settle(rows)))
    if zero_end:
        rows = sets.zero_final(rows, "t", ["f1", "f2"])
    beads = physics.bead_signals(*[F.col(c) for c in ("f1", "f2", "k1", "k2")])
    short = filters.too_short(ramps, filters.boxcar_least(factor)).select("trace", F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("chunk"))
    short = short.join(owner, "trace").withColumn("n", F.lit(0).cast("bigint")).withColumn("error_code", F.lit(TOO_SHORT))
    return rows.withColumn("b", beads).select(
        "trace", "baseline", "i", "n", "chunk", "t", "trap", "f1", "f2", F.col("b.x1").alias("bead1"), F.col("b.x2").alias("bead2"),
        F.col("b.dx").alias("bead_diff"), F.col("b.diff_f").alias("f"),
        physics.molecular_extension(F.col("trap"), F.col("b.dx")).alias("d"), "error_code").unionByName(short, allowMissingColumns=True)


def postprocess(samples: DataFrame, decisions: DataFrame | None, factor: int, model: Sequence, rough: align.Box,
                fine: tuple[align.Box, align.Box | None], base_points: int = 50, min_force: float = 5.0,
                smooth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Align, find the rupture and keep or discard: aligned full-rate samples and a per-trace table.

    Alignment and rupture use decimated traces; offsets are then added to all samples.
    ``decisions`` (``trace, seq, keep``) override the automatic result: a trace is kept
    when the model box of the rough alignment held samples.  A trace too short to decimate is
    listed with ``error_code`` ``TOO_SHORT``, is not kept and is not moved.
    """
    low = layout.settle(filters.boxcar_decimate(samples, ["d", "f"], factor))
    first = align.align(low, rough, model=model)
    moved = layout.settle(align.shift_samples(low, first))
    second = align.align(moved, fine[0], fine[1], model=model)
    both = first.select("trace", "doff", "foff").unionByName(second.select("trace", "doff", "foff"))
    total = both.groupBy("trace").agg(F.sum("doff").alias("doff"), F.sum("foff").alias("foff"))
    kinds = samples.groupBy("trace").agg(F.max("n").alias("n"), F.max("curve_type").alias("curve_type"))
    tagged = layout.spread(moved.select("trace", "i", "n", "chunk", "f"), layout.settle(kinds))
    rupture = detect.tether_rupture(layout.settle(tagged), "f", base_points, min_force, smooth)
    short = filters.too_short(samples, filters.boxcar_least(factor)).select("trace", F.lit(TOO_SHORT).alias("error_code"))
    per = kinds.join(total, "trace", "left").join(first.select("trace", "aligned"), "trace", "left").join(rupture, "trace", "left")
    per = per.join(short, "trace", "left").withColumns({c: F.coalesce(c, F.lit(d)) for c, d in (
        ("aligned", False), ("doff", 0.0), ("foff", 0.0), ("error_code", 0))})
    per = per.withColumn("rupture_index", F.least(physics.fine_index(F.col("rupture_index"), factor), F.col("n") - 1))
    per = per.withColumn("keep", F.col("aligned"))
    if decisions is not None:
        per = sets.latest_decision(per, decisions, ["keep"])
    per = layout.settle(per)
    out = layout.spread(samples, per.select("trace", "n", "doff", "foff", "rupture_index", "keep"))
    out = out.withColumn("d_aln", F.col("d") + F.col("doff")).withColumn("f_aln", F.col("f") + F.col("foff"))
    return out.drop("doff", "foff"), per


def contour_length_traces(samples: DataFrame, factor: int, model: Sequence, d: str = "d_aln", f: str = "f_aln") -> DataFrame:
    """Cut at the rupture, decimate, then transform each point (filter first, transform second)."""
    # written once, with what is read of it: renumbering takes several passes, decimation one
    aligned = layout.settle(samples.select("trace", "i", "n", "chunk", "curve_type", "rupture_index", d, f))
    low = filters.boxcar_decimate(sets.at_rupture(aligned).select("trace", "i", "n", "chunk", d, f), [d, f], factor)
    return low.withColumn("lc", wlc.contour_length(F.col(d), F.col(f), *model))


def annotate(low: DataFrame, per_trace: DataFrame, reference_lc: float, cutoff: float = 2.0, threshold: float = 0.5,
             distance: int = 5, window: int = 5, edits: DataFrame | None = None, from_end: bool = False,
             lp: float = 50.0, st: float | None = None, **leg_options) -> DataFrame:
    """One row per transition: position, size, cumulative size and state.

    Relax curves are read backwards; positions refer to the trace as given.
    """
    from tracespool.operators import edits as manual

    kinds = layout.settle(per_trace.select("trace", "curve_type").join(_lengths(low), "trace"))
    turned = layout.settle(sets.flip(layout.spread(low, kinds), F.col("curve_type") == "R"))
    found = detect.transitions(turned, "f", cutoff, threshold, distance, window)
    if edits is not None:
        at = manual.edit_transitions(found.select("trace", "at"), edits)
        ranked = layout.index_samples(at, ["at"])
        found = ranked.select("trace", F.col("i").alias("k"), "at")
    found = layout.settle(found.select("trace", "k", "at"))
    steps, whole = legs.transition_sizes(turned, found, lp=lp, st=st, **leg_options)
    sized = layout.settle(found.join(steps.select("trace", "k", "force", "dext", "dlc"), ["trace", "k"], "left"))
    out = detect.states(sized, F.lit(float(reference_lc)), "dlc", from_end)
    out = out.join(whole, "trace", "left").join(kinds, "trace")
    at = F.when(F.col("curve_type") == "R", F.col("n") - 1 - F.col("at")).otherwise(F.col("at"))
    return out.select("trace", "k", at.alias("at"), "curve_type", "force", "dext", "dlc", F.col("cumulative").alias("dlc_sum"),
                      "state", "total_dext", "total_dlc")


def consolidate(parts: Sequence[DataFrame], annotations: DataFrame, model: Sequence, box: align.Box,
                size: tuple[float, float], max_rmsd: float, max_initial: float | None = None,
                min_final: float | None = None, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Union datasets, filter traces by size, force and fit; samples with ``kept`` and a per-trace table."""
    samples = layout.settle(scan.union_sources(*parts))
    d, f = F.col("d_aln"), F.col("f_aln")
    fit = stats.rmsd(samples.select("trace", "d_aln", "f_aln"), f, wlc.force_udf(*model)(d), physics.box(d, f, *box))
    ends = annotations.groupBy("trace").agg(
        F.coalesce(F.max_by("dlc_sum", "k"), F.max("total_dlc")).alias("size"),
        F.min_by("at", "k").alias("_first"), F.max_by("at", "k").alias("_last"))
    points = samples.select("trace", F.col("i").alias("_i"), f.alias("_f"))
    first = ends.select("trace", F.col("_first").alias("_i")).join(points, ["trace", "_i"]).select("trace", F.col("_f").alias("initial_force"))
    last = ends.select("trace", F.col("_last").alias("_i")).join(points, ["trace", "_i"]).select("trace", F.col("_f").alias("final_force"))
    per = ends.select("trace", "size").join(first, "trace", "left").join(last, "trace", "left").join(
        fit.select("trace", "rmsd"), "trace", "left")
    per = stats.trace_filter(per, size, max_initial, min_final, max_rmsd).withColumn("keep", F.size("codes") == 0)
    if decisions is not None:
        per = sets.latest_decision(per, decisions, ["keep"])
    per = layout.settle(per)
    return scan.mark_kept(samples, per.where("keep")), per


def motor_postprocess(samples: DataFrame, model: Sequence, box: align.Box, factor: int,
                      representative: str = "fecS03") -> tuple[DataFrame, DataFrame]:
    """Align each set by its representative ramp and shift the whole set alike."""
    low = layout.settle(filters.boxcar_decimate(samples, ["d", "f"], factor))
    own = align.align(low, box, model=model)
    c = F.col("trace")
    runs_ = own.select("trace", "n", "doff", "aligned", ids.trace_base(c).alias("base"), ids.run_type(c).alias("run"))
    per = layout.settle(sets.from_representative(runs_, "base", "run", representative, ["doff", "aligned"]))
    sizes = _lengths(samples)
    shift = layout.settle(per.drop("n").join(sizes, "trace").select("trace", "n", F.coalesce("set_doff", F.lit(0.0)).alias("_o")))
    return layout.spread(samples, shift).withColumn("d", F.col("d") + F.col("_o")).drop("_o"), per


def motor_traces(samples: DataFrame, rate: float, factor: int, model: Sequence, pause_mad: float = 5.0,
                 penalty_factor: float = 1.0, min_dwell: int = 5, min_step: float = 0.4, tolerance: float = 0.4,
                 mode_options: dict | None = None, kind: str = "bessel", cutoff: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contour length, trap modes and ideal trace of motor recordings.

    Filter and decimate, transform to contour length (bp), split the trap trajectory into
    modes, fit steps inside each mode segment, and call dwells far longer than usual pauses.
    """
    low = layout.settle(filters.zero_phase_lowpass(samples, ["trap", "d", "f"], factor, kind, cutoff=cutoff))
    lc = layout.settle(low.withColumn("t", F.col("i") * factor / rate).withColumn(
        "lc", physics.um_to_bp(wlc.contour_length(F.col("d"), F.col("f"), *model))))
    segments = layout.settle(runs.modes(lc, "t", "trap", **(mode_options or {})))
    # neighbours share their border sample; steps are fitted on half-open segments
    last = segments.groupBy("trace").agg(F.max("k").alias("_end"))
    spans = segments.join(last, "trace").select("trace", "k", "start", F.when(
        F.col("k") == F.col("_end"), F.col("last") + 1).otherwise(F.col("last")).alias("stop"))
    fitted = stepfit.clean_dwells(stepfit.find_steps(lc, "lc", layout.settle(spans), penalty_factor), min_dwell, min_step)
    none = fitted.limit(0).select("trace", "start", "stop", "level")
    ideal = layout.settle(stepfit.ideal_trace(none, fitted, tolerance).select("trace", "k", "start", "stop", "level"))
    pauses = detect.ideal_pauses(runs.merge_equal(ideal), pause_mad)
    return lc, ideal, pauses
