"""Manual edits as data: rows of an edit table applied by joins.

Edit tables are typed in by people, so a trace has few edits; samples and intervals are
still joined with salt.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.operators import modelfit, runs, stepfit, timejoin
from tracespool.plans import layout


def merge_regions(cuts: DataFrame) -> DataFrame:
    """Union of possibly overlapping closed regions ``trace, lo, hi``.

    Counts how many regions are open along the time line; a stretch runs from the first
    opening to the closing that leaves none open.
    """
    marks = cuts.select("trace", F.explode(F.array(
        F.struct(F.col("lo").alias("t"), F.lit(0).alias("side"), F.lit(1).alias("d")),
        F.struct(F.col("hi").alias("t"), F.lit(1).alias("side"), F.lit(-1).alias("d")))).alias("m"))
    # equal marks are merged so that the order is unique
    marks = marks.groupBy("trace", "m.t", "m.side").agg(F.sum("m.d").alias("d"))
    marks = layout.slotted(marks, ["trace"], ["t", "side"])
    opened = layout.running_sum(marks, {"_open": "d"}, block="_slot", order=("t", "side"))
    first = ((F.col("side") == 0) & (F.col("_open") == F.col("d"))).cast("bigint")
    numbered = layout.running_sum(layout.settle(opened.withColumn("_first", first)), {"_g": "_first"},
                                  block="_slot", order=("t", "side"))
    return numbered.groupBy("trace", "_g").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).drop("_g")


def cut_regions(samples: DataFrame, cuts: DataFrame, time: str) -> DataFrame:
    """Remove samples inside the regions and renumber; ``src`` is the old position."""
    gone = timejoin.within_regions(samples, merge_regions(cuts), time).select("trace", "i")
    left = samples.join(gone, ["trace", "i"], "left_anti")
    return layout.reindex(layout.settle(left.select(samples.columns)), keep="src")


def carry_intervals(intervals: DataFrame, samples: DataFrame, kept: DataFrame) -> DataFrame:
    """Intervals in the positions of the cut trace; an interval cut in the middle splits."""
    owned = runs.assign(samples.select("trace", "i", "n", "chunk"), intervals).where("segment is not null")
    moved = kept.select("trace", "i", "n", "chunk", "src").join(
        owned.select("trace", F.col("i").alias("src"), "segment"), ["trace", "src"], "left")
    # a jump of the old position, or another interval, starts a new piece
    cut = layout.sliding(layout.settle(moved), 1, 0, {"_new": lambda w, f: (
        ~F.col("segment").eqNullSafe(F.lag("segment").over(w))
        | F.coalesce(F.col("src") - F.lag("src").over(w) > 1, F.lit(True))).cast("bigint")})
    pieces = layout.running_sum(cut, {"_p": "_new"}).where("segment is not null").groupBy("trace", "_p").agg(
        F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.min("segment").alias("source_k"))
    return runs.renumber(pieces.select("trace", F.expr("cast(_p as bigint)").alias("k"), "start", "stop", "source_k"))


def _hit(dwells: DataFrame, edits: DataFrame) -> DataFrame:
    """Dwells ``trace, k, start, stop, level, t_start, t_stop`` that overlap an edit ``trace, seq, t1, t2``."""
    return layout.salted(dwells, edits.select("trace", "seq", "t1", "t2"), ["trace"], salt="k").where(
        (F.col("t_start") <= F.col("t2")) & (F.col("t_stop") >= F.col("t1")))


ROUNDING = 1e-9  #: pooled means that differ by less are equal levels


def replace_dwells(dwells: DataFrame, samples: DataFrame, value: str, edits: DataFrame) -> DataFrame:
    """Give the dwells that overlap an edit's time window the pooled mean of their raw samples.

    Neighbours whose levels then differ by less than ``ROUNDING`` are joined: sums of decimals miss an equal level by that.
    """
    hit = layout.settle(_hit(dwells, edits).select("trace", "k", "seq", "start", "stop"))
    inside = runs.assign(samples, dwells.select("trace", "k", "start", "stop"))
    sums = inside.where("segment is not null").groupBy("trace", F.col("segment").alias("k")).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_c"))
    pooled = hit.join(sums, ["trace", "k"]).groupBy("trace", "seq").agg((F.sum("_s") / F.sum("_c")).alias("_mean"))
    new = hit.join(pooled, ["trace", "seq"]).groupBy("trace", "k").agg(F.max_by("_mean", "seq").alias("_mean"))
    out = dwells.join(new, ["trace", "k"], "left").withColumn("level", F.coalesce("_mean", "level"))
    return runs.merge_equal(out.select("trace", "k", "start", "stop", "level"), within=ROUNDING)


def merge_dwells(dwells: DataFrame, edits: DataFrame) -> DataFrame:
    """Merge the two dwells an edit overlaps, with the ``earlier`` or ``later`` level (``keep``).

    An edit that overlaps another number of dwells raises.
    """
    hit = _hit(dwells, edits).join(edits.select("trace", "seq", "keep"), ["trace", "seq"])
    two = hit.groupBy("trace", "seq", "keep").agg(
        F.count(F.lit(1)).alias("_m"), F.min("k").alias("_a"), F.max("k").alias("_b"),
        F.min_by("level", "k").alias("_la"), F.max_by("level", "k").alias("_lb"))
    bad = F.raise_error(F.lit("a merge edit must overlap exactly two dwells")).cast("double")
    level = F.when(F.col("_m") != 2, bad).when(F.col("keep") == "earlier", F.col("_la")).otherwise(F.col("_lb"))
    new = two.select("trace", "seq", F.explode(F.array("_a", "_b")).alias("k"), level.alias("_new"))
    new = new.groupBy("trace", "k").agg(F.max_by("_new", "seq").alias("_new"))
    out = dwells.join(new, ["trace", "k"], "left").withColumn("level", F.coalesce("_new", "level"))
    return runs.merge_equal(out.select("trace", "k", "start", "stop", "level"))


def refit_dwells(dwells: DataFrame, samples: DataFrame, value: str, boxes: DataFrame, penalty_factor: float = 1.0) -> DataFrame:
    """Fit steps anew inside each dwell that overlaps a box ``trace, seq, t1, t2``, from the samples of that dwell alone.

    The new dwells take the place of the old one, all others stay as they are; neighbours of equal level are joined and
    ``k`` is counted again.  A dwell without a sample to fit stays.
    """
    chosen = layout.settle(_hit(dwells, boxes).select("trace", "k", "start", "stop").distinct())
    fitted = stepfit.find_steps(samples, value, chosen, penalty_factor)
    kept = dwells.join(fitted.select("trace", F.col("segment").alias("k")).distinct(), ["trace", "k"], "left_anti")
    spliced = kept.select("trace", "start", "stop", "level").unionByName(fitted.select("trace", "start", "stop", "level"))
    ranked = layout.index_samples(spliced, ["start"])
    return runs.merge_equal(ranked.select("trace", F.col("i").alias("k"), "start", "stop", "level"))


def edit_transitions(found: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply ``add``, ``remove``, ``move`` (``at`` to ``to``) and ``reset`` edits in ``seq`` order.

    ``found`` is ``trace, at``.  A reset forgets all earlier edits of the trace; for each
    position the last edit decides.
    """
    reset = edits.groupBy("trace").agg(F.max(F.when(F.col("action") == "reset", F.col("seq"))).alias("_r"))
    live = edits.join(reset, "trace").where("_r is null or seq > _r").where("action <> 'reset'")
    # a move removes one position and adds another
    acts = live.select("trace", "seq", F.explode(F.when(F.col("action") == "move", F.array(
        F.struct(F.col("at").alias("at"), F.lit(False).alias("on")), F.struct(F.col("to").alias("at"), F.lit(True).alias("on"))))
        .otherwise(F.array(F.struct(F.col("at").alias("at"), (F.col("action") == "add").alias("on"))))).alias("e"))
    last = acts.groupBy("trace", "e.at").agg(F.max_by("e.on", F.struct("seq", "e.on")).alias("_on"))
    both = found.select("trace", "at").distinct().withColumn("_had", F.lit(True)).join(last, ["trace", "at"], "full")
    return both.where(F.coalesce("_on", F.col("_had"))).select("trace", "at")


def edit_states(states: DataFrame, edits: DataFrame) -> DataFrame:
    """Set states (``trace, k, value, seq``), then recompute steps and their running total."""
    last = edits.groupBy("trace", "k").agg(F.max_by("value", "seq").alias("_v"))
    new = states.join(last, ["trace", "k"], "left").withColumn("state", F.coalesce("_v", "state")).drop("_v")
    rows = layout.sliding(runs.as_rows(layout.settle(new.select("trace", "k", "state"))), 0, 1, {
        "dlc": lambda w, f: F.coalesce(F.lead("state").over(w) - F.col("state"), F.lit(0.0))})
    first = states.where("k = 0").select("trace").join(new.where("k = 0").select("trace", F.col("state").alias("_s0")), "trace")
    out = layout.salted(rows, first, ["trace"], salt="k")
    return out.select("trace", "k", "state", "dlc", (F.col("state") - F.col("_s0")).alias("dlc_sum"))


def refit_states(samples: DataFrame, transitions: DataFrame, states: DataFrame, requests: DataFrame, model: Sequence, variable: int = 0,
                 guess: float = 0.7, d: str = "d", f: str = "f", invert: bool = True) -> DataFrame:
    """Fit the contour length of chosen states ``trace, k, seq, padding`` anew, then derive steps and totals as `edit_states` does.

    The samples from the transition before (or the start), ``padding`` samples later, up to the state's own transition are
    fitted with the length of component ``variable`` free, from ``guess``.  A state without samples there keeps its value.
    """
    last = requests.groupBy("trace", "k").agg(F.max_by("padding", "seq").alias("padding"))
    before = layout.sliding(runs.as_rows(transitions.select("trace", "k", "at")), 1, 0, {"_prev": lambda w, f: F.coalesce(F.lag("at").over(w), F.lit(0))})
    part = layout.settle(before.join(last, ["trace", "k"]).select("trace", "k", (F.col("_prev") + F.col("padding")).alias("start"), F.col("at").alias("stop")))
    rows = samples.select("trace", "i", "n", "chunk", F.col(d).alias("d"), F.col(f).alias("f"))
    inner = runs.assign(rows, part.where("start < stop")).where("segment is not null").select("trace", F.col("segment").alias("k"), "d", "f")
    ends = layout.with_chunk(part.where("start <= stop").select("trace", "k", F.col("stop").alias("i"))).join(rows.drop("n"), ["trace", "chunk", "i"])
    name = F.concat_ws(":", F.col("trace").cast("string"), F.col("k").cast("string")).alias("_part")
    known = inner.unionByName(ends.select("trace", "k", "d", "f")).select(name, "d", "f")
    guesses = [[v if (c, q) != (variable, 1) else guess for q, v in enumerate(row)] for c, row in enumerate(model)]
    fixed = [[(c, q) != (variable, 1) for q in range(len(row))] for c, row in enumerate(model)]
    fits = modelfit.fit_model(known, guesses, fixed, key="_part", invert=invert)
    new = part.select("trace", "k", name).join(fits.where("points > 0").select("_part", F.col("components")[variable][1].alias("value")), "_part")
    return edit_states(states, new.select("trace", "k", "value", F.lit(0).alias("seq")))


def retrim(samples: DataFrame, force: str, limits: DataFrame, automatic: DataFrame) -> DataFrame:
    """Rupture index per trace: the last sample at or below a manual ``max_force``, else automatic."""
    hit = layout.salted(samples.select("trace", "i", force), limits.select("trace", "max_force"), ["trace"], salt="i")
    manual = hit.where(F.col(force) <= F.col("max_force")).groupBy("trace").agg(F.max("i").alias("_m"))
    return automatic.join(manual, "trace", "left").select("trace", F.coalesce("_m", "rupture_index").alias("rupture_index"))


def remap_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """States of edited transitions: kept where the position stays, NULL for new positions."""
    return new.select("trace", "at").join(old.select("trace", "at", "state"), ["trace", "at"], "left")
