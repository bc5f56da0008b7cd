"""Alignment of traces to a polymer model."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespool.functions import physics, wlc
from tracespool.functions.wlc import extension_at, force_at
from tracespool.plans import layout
from tracespool.plans.layout import whole_groups

Box = tuple[Sequence[float] | None, Sequence[float] | None]

LOCAL_ROWS = 1 << 18  # traces up to this size are aligned inside one task


def align(samples: DataFrame, distance_box: Box, force_box: Box | None = None, model: Sequence = (),
          target_distance: Callable[[Column], Column] | None = None,
          target_force: Callable[[Column], Column] | None = None,
          window: tuple[str, str] | None = None, before: str | None = None, carry: Sequence[str] = (),
          d: str = "d", f: str = "f", d_tol: float = 1e-5, f_tol: float = 1e-3, max_iter: int = 20,
          local_rows: int | None = None) -> DataFrame:
    """Offsets ``trace, n, doff, foff, aligned, rounds, converged`` that move each trace onto the model.

    Each round shifts the distance by the mean model distance minus distance in
    ``distance_box`` (or in the positions named by ``window``), and, with ``force_box``,
    the force likewise; boxes apply to shifted values and, with ``before``, only up to
    that position.  Custom targets may use the ``carry`` columns.  Traces stop when both shifts are small.  Traces of at most ``local_rows``
    samples go through all their rounds inside a task, a batch of traces at a time, if boxes and targets are the plain ones.  All others take part in one
    aggregate per round, and only the small offset table is written between rounds.  An
    empty box leaves a trace where it is (``aligned`` false).  A box may be a function of shifted distance and force
    that gives the condition.  ``converged`` is false where ``max_iter`` rounds were not enough.
    """
    to_distance = target_distance or (lambda force: wlc.extension(force, *model))
    to_force = target_force or (lambda dist: wlc.force_udf(*model)(dist))
    keep = [*(window or ()), *([before] if before else []), *carry]
    rows = samples.select("trace", "i", "n", "chunk", F.col(d).alias("_d"), F.col(f).alias("_f"), *keep)
    allowed = F.col("i") <= F.col(before) if before else F.lit(True)
    off = samples.groupBy("trace").agg(F.max("n").alias("n")).select(
        "trace", "n", F.lit(0.0).alias("doff"), F.lit(0.0).alias("foff"), F.lit(True).alias("active"),
        F.lit(False).alias("aligned"), F.lit(0).alias("rounds"))
    off = layout.settle(off)
    picked = F.col("i").between(F.col(window[0]), F.col(window[1])) if window else None
    done = None
    if not (target_distance or target_force or callable(distance_box) or callable(force_box)):
        limit = local_rows or LOCAL_ROWS
        short = rows.where(F.col("n") <= limit).where(allowed & F.col("_d").isNotNull() & F.col("_f").isNotNull()).select(
            "trace", "i", F.col("_d").cast("double").alias("_d"), F.col("_f").cast("double").alias("_f"),
            (F.lit(True) if picked is None else F.coalesce(picked, F.lit(False))).alias("_in"))
        done = _align_short(short, off.where(F.col("n") <= limit), None if window else distance_box, force_box, model, d_tol, f_tol, max_iter)
        off = off.where(F.col("n") > limit)
        if off.isEmpty():
            return done

    def shift(table: DataFrame, box: Box, target: Callable[[Column, Column], Column],
              picked: Column | None = None) -> DataFrame:
        joined = layout.spread(rows, table.where("active").select("trace", "n", "doff", "foff"))
        x, y = F.col("_d") + F.col("doff"), F.col("_f") + F.col("foff")
        inside = picked if picked is not None else box(x, y) if callable(box) else physics.box(x, y, *box)
        moved = joined.where(inside & allowed).select("trace", x.alias("_x"), y.alias("_y"), *carry)
        return moved.groupBy("trace").agg(F.avg(target(F.col("_x"), F.col("_y"))).alias("_s"))

    for _ in range(max_iter):
        dist = shift(off, distance_box, lambda x, y: to_distance(y) - x, picked)
        step = off.join(dist, "trace", "left").withColumn("_dd", F.coalesce("_s", F.lit(0.0))).withColumn(
            "aligned", F.col("aligned") | F.col("_s").isNotNull()).drop("_s")
        step = step.withColumn("doff", F.col("doff") + F.col("_dd"))
        if force_box is not None:
            step = layout.settle(step)
            force = shift(step, force_box, lambda x, y: to_force(x) - y)
            step = step.join(force, "trace", "left").withColumn("_df", F.coalesce("_s", F.lit(0.0))).drop("_s")
            step = step.withColumn("foff", F.col("foff") + F.col("_df"))
        else:
            step = step.withColumn("_df", F.lit(0.0))
        moving = F.col("active") & ((F.abs("_dd") > d_tol) | (F.abs("_df") > f_tol))
        off = layout.settle(step.withColumn("rounds", F.col("rounds") + F.col("active").cast("int"))
                            .withColumn("active", moving).drop("_dd", "_df"))
        if off.where("active").isEmpty():
            break
    off = off.withColumn("converged", ~F.col("active")).drop("active")
    return off if done is None else done.unionByName(off)


def _align_short(rows: DataFrame, off: DataFrame, distance_box: Box | None, force_box: Box | None, model: Sequence,
                 d_tol: float, f_tol: float, max_iter: int) -> DataFrame:
    """The rounds of `align` for whole traces, many at once over sorted Arrow batches; without a box ``_in`` picks the samples."""
    comps = [tuple(c) for c in model]

    def inside(x, y, box):
        ok = np.ones(x.shape, dtype=bool)
        for v, r in zip((x, y), box):
            if r is not None:
                ok &= (v > float(r[0])) & (v < float(r[1]))
        return ok

    def mean(values, owner, size):
        count = np.bincount(owner, minlength=size)
        return np.bincount(owner, values, size) / np.maximum(count, 1), count > 0

    def solve(batches):
        for table, borders in whole_groups(batches, ("trace",)):
            size = len(borders) - 1
            d, f, given = (table.column(c).to_numpy() for c in ("_d", "_f", "_in"))
            owner = np.repeat(np.arange(size), np.diff(borders))
            doff, foff, rounds = np.zeros(size), np.zeros(size), np.zeros(size, dtype=np.int32)
            active, aligned = np.ones(size, dtype=bool), np.zeros(size, dtype=bool)
            for _ in range(max_iter):
                live = active[owner]
                if not live.all():
                    d, f, given, owner = d[live], f[live], given[live], owner[live]
                x, y = d + doff[owner], f + foff[owner]
                on = given if distance_box is None else inside(x, y, distance_box)
                dd, hit = mean(extension_at(y[on], comps) - x[on], owner[on], size)
                aligned |= hit
                doff += dd
                df = np.zeros(size)
                if force_box is not None:
                    x = d + doff[owner]
                    on = inside(x, y, force_box)
                    to = force_at(x[on], comps)
                    known = np.isfinite(to)
                    df, _ = mean((to - y[on])[known], owner[on][known], size)
                    foff += df
                rounds += active
                active &= ~((np.abs(dd) <= d_tol) & (np.abs(df) <= f_tol))
                if not active.any():
                    break
            trace = table.column("trace").take(pa.array(borders[:-1])).combine_chunks()
            yield pa.RecordBatch.from_arrays([trace, *[pa.array(c) for c in (doff, foff, aligned, rounds, ~active)]],
                                             ["trace", "doff", "foff", "aligned", "rounds", "converged"])

    kind = rows.schema["trace"].dataType.simpleString()
    ordered = layout.by_group(rows, "trace").sortWithinPartitions("trace", "i")
    found = ordered.mapInArrow(solve, f"trace {kind}, doff double, foff double, aligned boolean, rounds int, converged boolean")
    # a trace without a sample to look at stops after one round
    rest = {"doff": 0.0, "foff": 0.0, "aligned": False, "rounds": min(1, max_iter), "converged": max_iter > 0}
    return layout.settle(off.select("trace", "n").join(found, "trace", "left").select(
        "trace", "n", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in rest.items()]))


def realign_traces(samples: DataFrame, boxes: DataFrame, model: Sequence, d: str = "d", f: str = "f", **options) -> tuple[DataFrame, DataFrame]:
    """Align the distance of chosen traces anew, each in its own open box ``trace, d_lo, d_hi, f_lo, f_hi``; all others stay.

    Returns all samples and the offsets ``trace, doff, realigned`` of the chosen traces; one without a sample in its box keeps its
    place (``realigned`` false).  Of several boxes for a trace the one with the greatest ``seq`` counts.
    """
    edges = ["d_lo", "d_hi", "f_lo", "f_hi"]
    last = boxes.groupBy("trace").agg(F.max_by(F.struct(*edges), "seq").alias("_b")).select("trace", "_b.*")
    sizes = layout.settle(layout.salted(samples.select("trace", "i", "n"), last, ["trace"], salt="i").groupBy("trace", *edges).agg(F.max("n").alias("n")))
    chosen = layout.settle(layout.spread(samples.select("trace", "i", "n", "chunk", d, f), sizes))
    inside = lambda x, y: (x > F.col("d_lo")) & (x < F.col("d_hi")) & (y > F.col("f_lo")) & (y < F.col("f_hi"))
    off = layout.settle(align(chosen, inside, None, model, carry=edges, d=d, f=f, **options))
    move = off.select("trace", "n", F.when(F.col("aligned"), F.col("doff")).otherwise(0.0).alias("_m"))
    moved = layout.spread(samples, move, "left").withColumn(d, F.col(d) + F.coalesce("_m", F.lit(0.0))).drop("_m")
    return moved, off.select("trace", "doff", F.col("aligned").alias("realigned"))


def shift_samples(samples: DataFrame, offsets: DataFrame, d: str = "d", f: str = "f") -> DataFrame:
    moved = layout.spread(samples, offsets.select("trace", "n", "doff", "foff"))
    return moved.withColumn(d, F.col(d) + F.col("doff")).withColumn(f, F.col(f) + F.col("foff")).drop("doff", "foff")


def pre_rupture_window(transitions: DataFrame, offsets: Sequence[int] = (200, 12, 3), single: int = 300) -> DataFrame:
    """Positions ``lo``..``hi`` before the final transition used to align an end.

    The window starts at the first of ``offsets`` after the previous transition that does
    not pass the last one, else at the smallest offset; with one transition it starts at
    position ``single``.
    """
    ends = transitions.groupBy("trace").agg(F.max("at").alias("hi"), F.count(F.lit(1)).alias("_m"))
    prev = transitions.join(ends.select("trace", "hi"), "trace").where("at < hi").groupBy("trace").agg(F.max("at").alias("_p"))
    joined = ends.join(prev, "trace", "left")
    tries = [F.when(F.col("_p") + o <= F.col("hi"), F.col("_p") + o) for o in offsets]
    lo = F.when(F.col("_p").isNull(), F.lit(single)).otherwise(
        F.coalesce(*tries, F.col("_p") + offsets[-1]))
    return joined.select("trace", lo.cast("bigint").alias("lo"), "hi")


# Recordings made before and after the first passive recording of a set.
EARLY = ("fecS00", "dct01", "fecS01")
LATE = ("fecS02", "dct02", "spm02", "fecS03")


def _with_retry(samples: DataFrame, distance_box: Box, force_box: Box | None, wider: float = 10.0, **options) -> DataFrame:
    """Align; traces whose distance box is empty try again with the force range up to ``wider``."""
    first = align(samples, distance_box, force_box, **options)
    empty = layout.settle(first.where("not aligned").select("trace"))
    if distance_box[1] is None or empty.isEmpty():
        return first
    again = samples.join(empty, "trace", "left_semi")
    second = align(again, (distance_box[0], (distance_box[1][0], wider)), force_box, **options)
    return layout.settle(first.where("aligned").unionByName(second))


def realign_beginning(samples: DataFrame, states: DataFrame, model: Sequence, distance_box: Box, force_box: Box,
                      variable: int = 0, align_force: bool = True) -> DataFrame:
    """Offsets ``trace, doff, foff, state_offset`` that put sets of recordings on the initial state.

    ``samples`` has ``base`` and ``run``; ``states`` is ``base, run, state, first_transition``
    with each recording's first state.  The first ramp moves the whole set in distance and
    the early recordings in force; the second ramp, on its own shifted state, then moves
    the late recordings in both.
    """
    target = float(model[variable][1])
    one = samples.where("run = 'fecS01'")
    known = states.where("run = 'fecS01'").select("base", "first_transition", (target - F.col("state")).alias("state_offset"))
    one = layout.settle(layout.salted(one, known, ["base"], salt="i"))
    first = _with_retry(one, distance_box, force_box if align_force else None, model=model, before="first_transition")
    owner = samples.groupBy("trace").agg(F.max("base").alias("base"), F.max("run").alias("run"), F.max("n").alias("n"))
    owner = layout.settle(owner)
    per_set = first.join(owner.select("trace", "base"), "trace").select("base", F.col("doff").alias("_d1"), F.col("foff").alias("_f1"))
    per_set = layout.settle(per_set.join(known, "base"))
    early = F.col("run").isin(*EARLY)
    out = layout.salted(owner, per_set, ["base"]).select(
        "trace", "base", "run", "n", F.col("_d1").alias("doff"), "state_offset",
        F.when(early & F.lit(align_force), F.col("_f1")).otherwise(0.0).alias("foff"))
    out = layout.settle(out)
    if not align_force:
        return out.select("trace", "doff", "foff", "state_offset")
    two = samples.where("run = 'fecS02'")
    shifted = layout.spread(two, out.select("trace", "n", F.col("doff").alias("_o"), "state_offset"))
    second_state = states.where("run = 'fecS02'").select("base", "state")
    shifted = layout.salted(shifted.withColumn("d", F.col("d") + F.col("_o")), second_state, ["base"], salt="i")
    shifted = layout.settle(shifted.withColumn("_lc", F.col("state") + F.col("state_offset")).drop("_o", "state", "state_offset"))
    lp, _, *rest = model[variable]
    fixed = [c for k, c in enumerate(model) if k != variable]
    tail = lambda force: wlc.extension(force, *fixed) if fixed else F.lit(0.0)
    invert = wlc.force_udf_variable(tuple(model), variable)
    late = _with_retry(shifted, distance_box, force_box, carry=["_lc"],
                       target_distance=lambda force: F.col("_lc") * wlc.relative_extension(force, lp, rest[0] if rest else None) + tail(force),
                       target_force=lambda dist: invert(dist, F.col("_lc")))
    moved = late.join(owner.select("trace", "base"), "trace").select("base", F.col("doff").alias("_d2"), F.col("foff").alias("_f2"))
    out = layout.salted(out, layout.settle(moved), ["base"], "left")
    is_late = F.col("run").isin(*LATE)
    plus = lambda c, e: F.col(c) + F.when(is_late, F.coalesce(e, F.lit(0.0))).otherwise(0.0)
    return out.select("trace", plus("doff", F.col("_d2")).alias("doff"), plus("foff", F.col("_f2")).alias("foff"), "state_offset")


def realign_end(samples: DataFrame, transitions: DataFrame, model: Sequence, force_box: Box | None,
                representative: str = "fecS03") -> DataFrame:
    """Offsets that put the end of each set's representative on the final state, for all members.

    ``transitions`` is ``trace, at``; the stretch before the rupture sets the distance.
    """
    last = samples.where(F.col("run") == representative)
    spans = pre_rupture_window(transitions.join(last.select("trace").distinct(), "trace", "left_semi"))
    sized = spans.join(last.groupBy("trace").agg(F.max("n").alias("n")), "trace")
    marked = layout.settle(layout.spread(last, layout.settle(sized)))
    off = align(marked, (None, None), force_box, model=model, window=("lo", "hi"))
    owner = layout.settle(samples.groupBy("trace").agg(F.max("base").alias("base")))
    per_set = off.join(owner, "trace").select("base", "doff", "foff", "aligned")
    return layout.salted(owner, layout.settle(per_set), ["base"]).select("trace", "doff", "foff", "aligned")
