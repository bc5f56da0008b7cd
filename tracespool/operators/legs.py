"""Size of transitions: legs before and after, extension change and contour length."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.functions import wlc
from tracespool.operators import paths, runs
from tracespool.plans import layout


def legs(transitions: DataFrame, padding: int = 5) -> DataFrame:
    """Interval ``trace, k, start, stop, at`` that leads up to each transition ``trace, k, at``."""
    rows = layout.sliding(runs.as_rows(transitions.select("trace", "k", "at")), 1, 0, {
        "_prev": lambda w, f: F.coalesce(F.lag("at").over(w), F.lit(0))})
    return layout.settle(rows.select("trace", "k", (F.col("_prev") + padding).alias("start"),
                                     (F.col("at") + 1).alias("stop"), "at"))


def leg_samples(samples: DataFrame, leg: DataFrame, d: str, f: str) -> DataFrame:
    """Samples with the leg they belong to: ``trace, i, chunk, k, at, _start, d, f``."""
    real = leg.where("start < stop").withColumn("leg", F.struct("k", "at", F.col("start").alias("a")))
    rows = runs.assign(samples.select("trace", "i", "n", "chunk", F.col(d).alias("d"), F.col(f).alias("f")), real, "leg")
    return layout.settle(rows.where("leg is not null").select(
        "trace", "i", "chunk", "leg.k", "leg.at", F.col("leg.a").alias("_start"), "d", "f"))


def start_legs(rows: DataFrame, nfit: int = 50, navg: int = 5) -> DataFrame:
    """Force and distance at each transition: from a line through the last ``nfit`` samples,
    else the mean of the last ``navg``, else NULL."""
    size = F.max(F.col("at") + 1 - F.col("_start"))
    last = F.col("i") > F.col("at") - nfit
    few = F.col("i") > F.col("at") - navg
    x, y = F.when(last, F.col("d")), F.when(last, F.col("f"))
    agg = rows.groupBy("trace", "k").agg(
        size.alias("_m"), F.regr_slope(y, x).alias("_a"), F.regr_intercept(y, x).alias("_b"),
        F.max(F.when(F.col("i") == F.col("at"), F.col("d"))).alias("_d"),
        F.avg(F.when(few, F.col("d"))).alias("_dm"), F.avg(F.when(few, F.col("f"))).alias("_fm"))
    fit, mean = F.col("_m") > nfit, F.col("_m") > navg
    return agg.select("trace", "k", F.when(fit, F.col("_a") * F.col("_d") + F.col("_b")).when(mean, F.col("_fm")).alias("force"),
                      F.when(fit, F.col("_d")).when(mean, F.col("_dm")).alias("x1"))


def end_legs(rows: DataFrame, requests: DataFrame, nfit: int = 50, navg: int = 5, avg_range: float = 0.1,
             fit_range: float = 0.75) -> DataFrame:
    """Distance on a leg at a given force.

    ``requests`` is ``trace, path, k, force``.  From its force minimum on, the leg is
    restricted to the force band.  ``x_fit`` comes from a line refitted around the point
    nearest to the force, ``x_avg`` from the mean around it; ``x_min``..``x_max`` is the
    range of the points behind ``x_fit``.
    """
    low = rows.groupBy("trace", "k").agg(F.min_by("i", F.struct("f", "i")).alias("_from"))
    asked = layout.settle(requests.join(low, ["trace", "k"]).select("trace", "path", "k", "force", "_from"))
    band = layout.salted(rows.select("trace", "i", "chunk", "k", "d", "f"), asked, ["trace", "k"], salt="i").where(
        (F.col("i") >= F.col("_from")) & (F.abs(F.col("f") - F.col("force")) < fit_range))
    band = layout.settle(layout.running_sum(band, {"_r": F.lit(1)}, keys=("trace", "path")))
    keys = ["trace", "path"]
    first = layout.settle(band.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_m"), F.regr_slope("f", "d").alias("_a"), F.regr_intercept("f", "d").alias("_b"),
        F.min_by(F.struct("_r", F.abs(F.col("f") - F.col("force")).alias("gap")), F.struct(
            F.abs(F.col("f") - F.col("force")), F.col("_r"))).alias("_near")))
    band = layout.salted(band, first, keys, salt="i")
    pick = band.groupBy(*keys).agg(F.min_by("_r", F.struct(
        F.abs(F.col("_a") * F.col("d") + F.col("_b") - F.col("force")), F.col("_r"))).alias("_c"))
    half, few = nfit // 2, navg // 2
    band = layout.salted(band, pick, keys, salt="i")
    near_fit = F.abs(F.col("_r") - F.col("_c")) <= half
    near_avg = F.abs(F.col("_r") - F.col("_near._r")) <= few
    x, y = F.when(near_fit, F.col("d")), F.when(near_fit, F.col("f"))
    out = band.groupBy(*keys, "k", "force", "_m").agg(
        F.regr_slope(y, x).alias("_a2"), F.regr_intercept(y, x).alias("_b2"), F.min(x).alias("_lo"), F.max(x).alias("_hi"),
        F.avg(F.when(near_avg, F.col("d"))).alias("_dm"), F.max("_near.gap").alias("_gap"))
    ok_fit, ok_avg = F.col("_m") > nfit, (F.col("_m") > navg) & (F.col("_gap") < avg_range)
    slope = F.when(F.col("_a2") != 0, F.col("_a2"))
    return out.select(*keys, F.when(ok_fit, (F.col("force") - F.col("_b2")) / slope).alias("x_fit"),
                      F.when(ok_fit, F.col("_lo")).alias("x_min"), F.when(ok_fit, F.col("_hi")).alias("x_max"),
                      F.when(ok_avg, F.col("_dm")).alias("x_avg"), F.col("_m").alias("points"))


def path_sizes(rows: DataFrame, paths: DataFrame, lp: float = 50.0, st: float | None = None, nfit: int = 50,
               navg: int = 5, avg_range: float = 0.1, fit_range: float = 0.75, sane: bool = True) -> DataFrame:
    """``force, x1, x2, dext, dlc`` of each path ``trace, path, origin, target`` between transitions.

    A path whose origin comes after its target runs backwards.  If the fitted end point
    lies on the wrong side or outside the points it came from, the average is used (not if ``sane`` is false).
    At a force of zero or less the chain has no extension, so ``dlc`` is missing there.
    """
    start = layout.settle(start_legs(rows, nfit, navg))
    known = paths.join(start.withColumnRenamed("k", "origin"), ["trace", "origin"], "left")
    known = layout.settle(known)
    ends = end_legs(rows, known.where("x1 is not null").select("trace", "path", F.col("target").alias("k"), "force"),
                    nfit, navg, avg_range, fit_range)
    out = known.join(ends, ["trace", "path"], "left")
    sign = F.when(F.col("origin") <= F.col("target"), 1).otherwise(-1)
    wrong = ((F.col("x_fit") - F.col("x1")) * sign < 0) | (F.col("x_fit") > F.col("x_max")) | (F.col("x_fit") < F.col("x_min"))
    x2 = F.when(F.col("x_fit").isNull() | (wrong if sane else F.lit(False)), F.col("x_avg")).otherwise(F.col("x_fit"))
    out = out.withColumn("x2", x2).withColumn("dext", (F.col("x2") - F.col("x1")) * sign)
    eps = wlc.relative_extension(F.col("force"), lp, st)
    return out.select("trace", "path", "origin", "target", "force", "x1", "x2", "dext",
                      F.when(F.col("force") > 0, F.try_divide("dext", eps)).alias("dlc"))


def named(origin, target, kind: str) -> list:
    return [F.expr(origin).alias("origin"), F.expr(target).alias("target"), F.lit(kind).alias("kind")]


def transition_sizes(samples: DataFrame, transitions: DataFrame, d: str = "d", f: str = "f", padding: int = 5,
                     **options) -> tuple[DataFrame, DataFrame]:
    """Sizes between neighbouring transitions, and of the whole transition per trace.

    A whole size that cannot be read forwards is read backwards.  A single missing size is the whole minus the others.
    With several missing, or no whole, each is the shortest detour over a later transition
    (`paths.shortest_detours`), else read backwards.  ``source`` names what was used.
    """
    rows = leg_samples(samples, legs(transitions, padding), d, f)
    top = transitions.groupBy("trace").agg(F.max("k").alias("_last"))
    t = layout.settle(transitions.select("trace", "k").join(top, "trace").where("_last > 0"))
    step, first = t.where("k < _last"), t.where("k = 0")
    asked = [step.select("trace", *named("k", "k + 1", "direct")), step.select("trace", *named("k + 1", "k", "back")), *_ask_whole(first)]
    sized = sizes_of(rows, asked, options)
    pick = lambda kind: sized.where(F.col("kind") == kind)
    whole = _whole(sized)
    steps = pick("direct").select("trace", F.col("origin").alias("k"), "force", "x1", "x2", "dext", "dlc")
    back = pick("back").select("trace", F.col("target").alias("k"), F.col("dlc").alias("_back"))
    gaps = steps.groupBy("trace").agg(F.count_if(F.col("dlc").isNull()).alias("_gaps"), F.sum("dlc").alias("_sum"))
    full = layout.settle(steps.join(back, ["trace", "k"], "left").join(gaps, "trace").join(whole, "trace"))
    single = (F.col("_gaps") == 1) & F.col("total_dlc").isNotNull()
    empty = layout.settle(full.where(F.col("dlc").isNull() & ~single).select(
        "trace", F.col("k").alias("origin"), (F.col("k") + 1).alias("target")))
    detours = _detours(samples, transitions, rows, f, empty, sized, options)
    full = full.join(detours.select("trace", F.col("origin").alias("k"), F.col("dlc").alias("_detour")), ["trace", "k"], "left")
    rest = F.col("total_dlc") - F.coalesce("_sum", F.lit(0.0))
    value = F.coalesce("dlc", F.when(single, rest).otherwise(F.coalesce("_detour", "_back")))
    filled = F.when(F.col("dlc").isNotNull(), "direct").when(value.isNull(), "missing").when(single, "total").when(
        F.col("_detour").isNotNull(), "detour").otherwise("reverse")
    return full.select("trace", "k", "force", "x1", "x2", "dext", value.alias("dlc"), filled.alias("source")), whole


def _ask_whole(first: DataFrame) -> list[DataFrame]:
    return [first.select("trace", *named("0L", "_last", "total")), first.select("trace", *named("_last", "0L", "total_back"))]


def _whole(sized: DataFrame) -> DataFrame:
    pick = lambda kind: sized.where(F.col("kind") == kind)
    return pick("total").select("trace", F.col("dext").alias("total_dext"), F.col("dlc").alias("_d")).join(
        pick("total_back").select("trace", F.col("dlc").alias("_r")), "trace").select(
            "trace", "total_dext", F.coalesce("_d", "_r").alias("total_dlc"))


def whole_sizes(samples: DataFrame, transitions: DataFrame, d: str = "d", f: str = "f", padding: int = 5, **options) -> DataFrame:
    """``trace, total_dext, total_dlc`` of `transition_sizes` alone: only the first and last leg of a trace are read."""
    top = transitions.groupBy("trace").agg(F.max("k").alias("_last"))
    t = layout.settle(transitions.select("trace", "k").join(top, "trace").where("_last > 0"))
    ends = legs(transitions, padding).join(t.where("k = 0 or k = _last").select("trace", "k"), ["trace", "k"], "left_semi")
    return _whole(sizes_of(leg_samples(samples, ends, d, f), _ask_whole(t.where("k = 0")), options))


def sizes_of(rows: DataFrame, asked: list[DataFrame], options: dict) -> DataFrame:
    """Sizes of the paths ``trace, origin, target, kind`` of several tables."""
    every = asked[0]
    for more in asked[1:]:
        every = every.unionByName(more)
    every = every.withColumn("path", F.concat_ws(":", "kind", "origin", "target"))
    return layout.settle(path_sizes(rows, every, **options).withColumn("kind", F.substring_index("path", ":", 1)))


def _detours(samples: DataFrame, transitions: DataFrame, rows: DataFrame, f: str, empty: DataFrame, sized: DataFrame, options: dict) -> DataFrame:
    """Detours around the sizes in ``empty``, over the valid edges of those traces."""
    some = layout.settle(empty.groupBy("trace").agg(F.min("origin").alias("_a")))
    edges = paths.valid_edges(layout.salted(samples, some.select("trace"), ["trace"], "left_semi", "i"),
                              transitions.join(some, "trace", "left_semi"), f, options.get("navg", 5))
    jumps = edges.where("target > origin + 1").join(some, "trace").where("origin > _a").select("trace", *named("origin", "target", "jump"))
    ends = empty.withColumnRenamed("target", "_b").join(edges.select("trace", "target").distinct(), "trace").where("target > _b")
    further = sizes_of(rows, [jumps, ends.select("trace", *named("origin", "target", "far"))], options)
    known = sized.where("kind = 'direct'").unionByName(further)
    return paths.shortest_detours(edges, empty, known.groupBy("trace", "origin", "target").agg(F.max("dlc").alias("dlc")))


def transition_work(samples: DataFrame, d: str, f: str, model: tuple, grid: int = 10000) -> DataFrame:
    """Area under the measured curve minus the area under the model on the same interval.

    The points of a trace's even grid never become rows: each trace has one sum, taken inside an Arrow batch.
    """
    strip = layout.sliding(samples, 1, 0, {"_a": lambda w, fr: (F.col(f) + F.lag(f).over(w)) / 2 * (
        F.col(d) - F.lag(d).over(w))})
    area = strip.groupBy("trace").agg(F.sum("_a").alias("area"), F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    # one row a trace is a small table, but each row is long work
    area = layout.by_group(layout.settle(area), "trace")
    under = area.withColumn("model_area", wlc.area_udf(model, grid)("_lo", "_hi"))
    return under.select("trace", "area", "model_area", (F.col("area") - F.col("model_area")).alias("work"))
