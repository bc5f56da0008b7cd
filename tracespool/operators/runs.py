"""Runs, dwells and intervals of level traces.

Intervals are half open, ``[start, stop)``; :func:`inclusive` gives the closed view.
Interval tables carry their own order ``k`` and are chunked by it, so they scale like
the sample tables.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespool.plans import layout


def _flag_changes(df: DataFrame, level: str, rows: int | None, within: float = 0.0) -> DataFrame:
    same = df.select("*")

    def changed(w, f):
        new = ~F.col(level).eqNullSafe(F.lag(level).over(w))
        if within:
            new = new & ~F.coalesce(F.abs(F.col(level) - F.lag(level).over(w)) < within, F.lit(False))
        return (new | (F.col("i") == 0)).cast("bigint")

    return layout.sliding(same, 1, 0, {"_new": changed}, rows)


def number_runs(df: DataFrame, level: str, rows: int | None = None) -> DataFrame:
    """Add ``k``, the 0-based number of the run of equal ``level`` a sample lies in."""
    flagged = _flag_changes(df, level, rows)
    return layout.running_sum(flagged, {"_k": "_new"}).withColumn(
        "k", F.expr("cast(_k - 1 as bigint)")).drop("_k", "_new")


def dwells(df: DataFrame, level: str, rows: int | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """``trace, n, k, start, stop, level`` for each run; ``extra`` adds aggregates."""
    runs = number_runs(df, level, rows)
    more = [c.alias(k) for k, c in (extra or {}).items()]
    return layout.settle(runs.groupBy("trace", "n", "k").agg(
        F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.min(level).alias("level"), *more))


def as_rows(intervals: DataFrame, rows: int | None = None) -> DataFrame:
    """View an interval table as rows with position ``i = k``, ready for the layout helpers."""
    kept = intervals.withColumnRenamed("n", "_len") if "n" in intervals.columns else intervals
    return layout.with_chunk(kept.withColumn("i", F.col("k")), rows)


def _from_rows(df: DataFrame) -> DataFrame:
    out = df.drop("i", "chunk")
    return out.withColumnRenamed("_len", "n") if "_len" in out.columns else out


def merge_equal(intervals: DataFrame, rows: int | None = None, extra: dict[str, Column] | None = None, within: float = 0.0) -> DataFrame:
    """Join adjacent intervals of equal level and renumber them; ``within`` also joins levels that differ by less."""
    numbered = layout.running_sum(_flag_changes(as_rows(intervals, rows), "level", rows, within), {"_k": "_new"})
    more = [c.alias(k) for k, c in (extra or {}).items()]
    keys = ["trace", "_len"] if "_len" in numbered.columns else ["trace"]
    out = numbered.groupBy(*keys, F.expr("cast(_k - 1 as bigint)").alias("k")).agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("level").alias("level"), *more)
    return layout.settle(out.withColumnRenamed("_len", "n") if "_len" in out.columns else out)


def steps(intervals: DataFrame, rows: int | None = None) -> DataFrame:
    """Add ``duration`` and ``step``, the change of level to the next dwell."""
    out = layout.sliding(as_rows(intervals, rows), 0, 1,
                         {"step": lambda w, f: F.lead("level").over(w) - F.col("level")}, rows)
    return _from_rows(out).withColumn("duration", F.col("stop") - F.col("start"))


def inclusive(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("stop", F.col("stop") - 1)


def labelled(df: DataFrame, flag: Column, rows: int | None = None) -> DataFrame:
    """Intervals where a boolean holds, numbered from 0."""
    runs = dwells(df.withColumn("_on", flag), "_on", rows).where("level")
    return renumber(runs.drop("level"), rows)


def renumber(intervals: DataFrame, rows: int | None = None) -> DataFrame:
    """Close gaps of ``k`` after a filter."""
    ranked = layout.running_sum(as_rows(intervals, rows), {"_r": F.lit(1)})
    return layout.settle(_from_rows(ranked).withColumn("k", F.expr("cast(_r - 1 as bigint)")).drop("_r"))


def complement(intervals: DataFrame, lengths: DataFrame, rows: int | None = None) -> DataFrame:
    """Gaps between intervals, and before the first and after the last one.

    ``lengths`` is ``trace, n``; a trace without intervals is one gap.
    """
    ends = lengths.select("trace", F.col("n").alias("start"), F.col("n").alias("stop"),
                          F.lit(None).cast("bigint").alias("k"))
    last = intervals.groupBy("trace").agg((F.max("k") + 1).alias("_m"))
    tail = ends.join(last, "trace", "left").select(
        "trace", "start", "stop", F.coalesce("_m", F.lit(0)).cast("bigint").alias("k"))
    rowset = as_rows(intervals.select("trace", "start", "stop", "k").unionByName(tail), rows)
    gaps = layout.sliding(rowset, 1, 0, {
        "_from": lambda w, f: F.coalesce(F.lag("stop").over(w), F.lit(0))}, rows)
    out = gaps.where("_from < start").select(
        "trace", "k", F.col("_from").cast("bigint").alias("start"), F.col("start").alias("stop"))
    return renumber(out, rows)


def assign(samples: DataFrame, intervals: DataFrame, value: str = "k") -> DataFrame:
    """Give each sample the ``value`` of the interval that covers it, NULL outside.

    Interval starts and stops become markers on the samples, filled forward: an
    equi-join on position instead of a range join.
    """
    marks = intervals.select("trace", F.explode(F.array(
        F.struct(F.col("start").alias("i"), F.struct(F.lit(1).alias("on"), F.col(value).alias("v")).alias("m")),
        F.struct(F.col("stop").alias("i"), F.struct(F.lit(0).alias("on"), F.lit(None).cast(
            intervals.schema[value].dataType).alias("v")).alias("m")))).alias("e"))
    marks = marks.groupBy("trace", F.col("e.i").alias("i")).agg(F.max("e.m").alias("_mark"))
    marked = samples.join(marks, ["trace", "i"], "left")
    name = "segment" if value == "k" else value
    return layout.fill(marked, {"_last": "_mark"}).withColumn(name, F.col("_last.v")).drop("_mark", "_last")


def absorb_short(intervals: DataFrame, min_len: int, lead_takes_next: bool = False,
                 rows: int | None = None) -> DataFrame:
    """Merge dwells shorter than ``min_len`` into the one before.

    The first dwell is exempt; with ``lead_takes_next`` (class labels) a short first run
    takes the label of the second run instead.  Repeated merging is one forward fill.
    """
    base = as_rows(intervals, rows)
    long = F.col("stop") - F.col("start") >= min_len
    if lead_takes_next:
        base = layout.sliding(base, 0, 1, {"_second": lambda w, f: F.lead("level").over(w)}, rows)
        own = F.when(long, F.col("level")).when(
            F.col("i") == 0, F.coalesce("_second", "level"))
    else:
        own = F.when(long | (F.col("i") == 0), F.col("level"))
    filled = layout.fill(base.withColumn("_own", own), {"_lvl": "_own"})
    out = _from_rows(filled.withColumn("level", F.col("_lvl"))).select(
        *[c for c in intervals.columns])
    return merge_equal(out, rows)


def absorb_small(intervals: DataFrame, tol: float, rows: int | None = None) -> DataFrame:
    """Merge each step smaller than ``tol`` into the last kept level.

    A step of at least ``2 tol`` between neighbours is kept whatever came before, since
    the kept level is within ``tol`` of the previous one.  It starts an independent
    stretch, so stretches are distributed; inside one the kept level is carried along.
    """
    base = layout.sliding(as_rows(intervals, rows), 1, 0, {
        "_cut": lambda w, f: F.coalesce(
            (F.abs(F.col("level") - F.lag("level").over(w)) >= 2 * tol).cast("bigint"), F.lit(1))}, rows)
    cut = layout.running_sum(base, {"_part": "_cut"}).drop("i", "chunk")

    def carry(batches):
        kept = 0.0
        for batch in batches:  # only the two columns in use leave Arrow
            column = batch.column("level")
            levels = column.to_numpy(zero_copy_only=False).astype(float)
            for r, (level, new) in enumerate(zip(levels.tolist(), batch.column("_cut").to_pylist())):
                if new or abs(level - kept) >= tol:
                    kept = level
                else:
                    levels[r] = kept
            done = pa.array(levels, from_pandas=True).cast(column.type)
            yield batch.set_column(batch.schema.get_field_index("level"), "level", done)

    done = (layout.by_group(cut, "trace", "_part").sortWithinPartitions("trace", "_part", "k")
            .mapInArrow(carry, cut.schema)).drop("_cut", "_part")
    out = done.withColumnRenamed("_len", "n") if "_len" in done.columns else done
    return merge_equal(out.select(*intervals.columns), rows)


def absorb_large(intervals: DataFrame, max_step: float, rows: int | None = None) -> DataFrame:
    """Merge dwells that a step above ``max_step`` leads to into their nearer neighbour, from the first to the last.

    The step is taken from the last level kept.  A dwell too far from it joins what was kept before if that is not farther
    than the next dwell or there is none; otherwise it takes the level of the next dwell and shares its fate.  Either way the kept
    level stays, so it is all that a chunk of dwells needs to know of those before: chunks are worked
    through in order, one chunk of every trace in a round, and only the kept level of each trace is handed on.
    A step from or to a missing level is not large.
    """
    size = rows or layout.CHUNK_ROWS
    base = layout.settle(layout.sliding(as_rows(intervals, size), 0, 1, {
        "_next": lambda w, f: F.lead("level").over(w).cast("double"), "_last": lambda w, f: F.lead("k").over(w).isNull()}, size))
    carried = base.withColumns({"_kept": F.lit(None).cast("double"), "_own": F.lit(None).cast("double")})

    def walk(batches):
        key, kept = None, None
        for pdf in batches:
            own, after = [], []
            for trace, k, level, nxt, last, given in zip(pdf["trace"], pdf["k"], pdf["level"].astype(float), pdf["_next"], pdf["_last"], pdf["_kept"]):
                if trace != key:
                    key, kept = trace, level if k == 0 else given
                if not abs(level - kept) > max_step:
                    kept = level
                    own.append(level)
                else:
                    back = last or not abs(level - kept) > abs(level - nxt)
                    own.append(kept if back else None)
                after.append(kept)
            yield pdf.assign(_own=own, _kept=after).astype({"_own": float, "_kept": float})

    done, state = None, base.select("trace", F.lit(None).cast("double").alias("_kept")).limit(0)
    for at in range((base.agg(F.max("chunk")).first()[0] or 0) + 1):
        part = carried.where(F.col("chunk") == at).drop("_kept").join(state, "trace", "left").select(carried.columns)
        part = layout.settle(layout.by_group(part, "trace").sortWithinPartitions("trace", "k").mapInPandas(walk, carried.schema))
        state = layout.settle(part.groupBy("trace").agg(F.max_by("_kept", "k").alias("_kept")))
        done = part if done is None else done.unionByName(part)
    # a forwarded dwell takes the level of the next one that is not
    marked = done.withColumn("_mark", F.when(F.col("_own").isNotNull() | F.col("level").isNull(), F.struct("_own")))
    filled = layout.fill(marked, {"_set": "_mark"}, backward=True)
    return merge_equal(_from_rows(filled.withColumn("level", F.col("_set._own"))).select(*intervals.columns), rows)


def monotonic(samples: DataFrame, level: str, segments: DataFrame, sign: int = 1,
              rows: int | None = None) -> DataFrame:
    """Split segments where the level moves against ``sign``; flat pieces are dropped."""
    if sign not in (1, -1):
        raise ValueError("sign must be 1 or -1")
    inside = assign(samples, segments)
    wrong = lambda w: (F.col(level) - F.lag(level).over(w)) * sign < 0
    cut = layout.sliding(inside, 1, 0, {"_cut": lambda w, f: (
        ~F.col("segment").eqNullSafe(F.lag("segment").over(w)) | F.coalesce(wrong(w), F.lit(True))
    ).cast("bigint")}, rows)
    pieces = layout.running_sum(cut, {"_p": "_cut"}).where("segment is not null")
    found = pieces.groupBy("trace", F.expr("cast(_p as bigint)").alias("k")).agg(
        F.min("i").alias("start"), (F.max("i") + 1).alias("stop"),
        F.min(level).alias("_lo"), F.max(level).alias("_hi"))
    return renumber(found.where("_lo <> _hi").drop("_lo", "_hi"), rows)


def modes(samples: DataFrame, time: str, position: str, threshold: float = 0.001,
          min_run: int = 5, min_velocity: float = 9.0, rows: int | None = None) -> DataFrame:
    """Stretch, relax and pause stretches of a trap trajectory.

    Differences are classed by ``threshold`` (um), short runs absorbed, and each run's
    speed (nm/s, least squares) decides its mode.  Neighbours share their border sample:
    ``start``..``last`` is closed.
    """
    moved = layout.sliding(samples, 0, 1, {
        "_dx": lambda w, f: F.lead(position).over(w) - F.col(position)}, rows)
    label = F.when(F.col("_dx") > threshold, 1).when(F.col("_dx") < -threshold, -1).otherwise(0)
    runs = dwells(moved.where("i < n - 1").withColumn("_cls", label), "_cls", rows)
    clean = absorb_short(runs, min_run, lead_takes_next=True, rows=rows)
    tagged = assign(samples, clean.withColumn("_s", F.struct("k", "start")), "_s")
    # the last sample closes the last run, a run's first sample also closes the run before
    tagged = layout.fill(tagged, {"_run": "_s"})
    member = F.array(F.col("_run.k"), F.when((F.col("i") == F.col("_run.start")) & (F.col("_run.k") > 0),
                                             F.col("_run.k") - 1))
    shared = tagged.select("trace", "i", time, position, F.explode(
        F.filter(member, lambda m: m.isNotNull())).alias("k"))
    fit = shared.groupBy("trace", "k").agg(
        F.min("i").alias("start"), F.max("i").alias("last"),
        F.min(time).alias("t_start"), F.max(time).alias("t_stop"),
        F.regr_slope(F.col(position) * 1000, F.col(time)).alias("velocity"))
    return fit.withColumn("mode", F.when(F.col("velocity") > min_velocity, "stretch")
                          .when(F.col("velocity") < -min_velocity, "relax").otherwise("pause"))


def segments_from_pauses(pauses: DataFrame, lengths: DataFrame, whole: Column | None = None,
                         rows: int | None = None) -> DataFrame:
    """Passive pause segments plus active segments in between, covering each trace.

    ``whole`` marks traces (a condition on ``lengths``) that are one passive segment.
    """
    whole = F.lit(False) if whole is None else whole
    single = lengths.where(whole)
    rest = lengths.where(~whole)
    mine = pauses.join(rest.select("trace"), "trace", "left_semi")
    active = complement(renumber(mine.select("trace", "k", "start", "stop"), rows), rest, rows)
    parts = (mine.select("trace", "start", "stop", F.lit("passive").alias("mode"))
             .unionByName(active.select("trace", "start", "stop", F.lit("active").alias("mode")))
             .unionByName(single.select("trace", F.lit(0).cast("bigint").alias("start"),
                                        F.col("n").alias("stop"), F.lit("passive").alias("mode"))))
    # order by start: chunk by position, which bounds each chunk by the chunk length
    size = rows or layout.CHUNK_ROWS
    ranked = layout.running_sum(parts.withColumn("chunk", F.expr(f"start div {size}L")),
                                {"_r": F.lit(1)}, order=["start"])
    return ranked.withColumn("k", F.expr("cast(_r - 1 as bigint)")).drop("_r", "chunk")
