"""Step finding, pause levels and the ideal trace.

Steps are change points of a Gaussian signal with a penalty per step.  A piece's best
split depends on the piece alone, so every round evaluates the best split of all open
pieces of all traces in one pass over prefix sums.  The order in which splits are
accepted only needs the table of splits, which is small.
"""
from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.operators import runs
from tracespool.plans import layout


def _raises_likelihood(gain: float, chi2: float, size: int, penalty: float) -> bool:
    if chi2 <= 0:
        return False
    if 1 + gain / chi2 <= 0:
        return True  # the cut leaves no error at all
    return penalty - size / 2 * math.log(1 + gain / chi2) > 0


def _accept(pdf: pd.DataFrame, penalty_factor: float) -> pd.DataFrame:
    """Walk the known splits of one segment from the most to the least useful.

    A split is accepted while it raises the penalised likelihood; its children enter the
    walk when it is accepted.  Unknown children are left out, which can only delay
    acceptances, so a later round with more splits never takes one back.
    """
    size, chi2 = int(pdf["m"].iloc[0]), float(pdf["chi2"].iloc[0])
    penalty = -0.5 * math.log(size) * penalty_factor
    node = {(int(a), int(b)): (float(g), int(x)) for a, b, g, x in zip(
        pdf["start"], pdf["stop"], pdf["gain"], pdf["cut"])}
    root = (int(pdf["seg_start"].iloc[0]), int(pdf["seg_stop"].iloc[0]))
    heap, taken = [(node[root][0], root)] if root in node else [], set()
    while heap:
        gain, piece = heapq.heappop(heap)
        if not _raises_likelihood(gain, chi2, size, penalty):
            break
        taken.add(piece)
        chi2 += gain
        for child in ((piece[0], node[piece][1]), (node[piece][1], piece[1])):
            if child in node:
                heapq.heappush(heap, (node[child][0], child))
    return pdf.assign(taken=[(int(a), int(b)) in taken for a, b in zip(pdf["start"], pdf["stop"])])


LOCAL_ROWS = 1 << 20  # segments up to this size are fitted inside one task


def find_steps(samples: DataFrame, value: str, segments: DataFrame, penalty_factor: float = 1.0,
               max_rounds: int = 200, local_rows: int | None = None) -> DataFrame:
    """Dwells ``trace, segment, start, stop, level`` of each segment ``trace, k, start, stop``.

    Pieces of up to two samples are not split further.  Segments of at most
    ``local_rows`` samples are fitted in one task each; longer ones in rounds that
    evaluate the best split of all open pieces over distributed prefix sums.  Either way
    a missing sample (NULL or NaN) holds the value before it in its segment, or the first
    value after it; a segment without values gives no dwells.
    """
    limit = local_rows or LOCAL_ROWS
    inside = runs.assign(samples.select("trace", "i", "n", "chunk", F.col(value).cast("double").alias("_y")), segments)
    inside = _held(layout.settle(inside.where("segment is not null")))
    long = layout.settle(segments.where(f"stop - start > {limit}").select("trace", F.col("k").alias("segment")))
    short = inside.join(long, ["trace", "segment"], "left_anti").select("trace", "segment", "i", "_y")
    kind = {c: inside.schema[c].dataType.simpleString() for c in ("trace", "segment")}
    ordered = layout.by_group(short, "trace", "segment").sortWithinPartitions("trace", "segment", "i")
    fitted = ordered.mapInPandas(lambda batches: _fit_sorted(batches, penalty_factor),
                                 f"trace {kind['trace']}, segment {kind['segment']}, start bigint, stop bigint, level double")
    if long.isEmpty():
        return layout.settle(fitted)
    rest = inside.join(long, ["trace", "segment"], "left_semi")
    return layout.settle(fitted.unionByName(_fit_in_rounds(rest, penalty_factor, max_rounds)))


def _held(inside: DataFrame) -> DataFrame:
    """Settled samples with missing values replaced by their neighbours in the segment."""
    known = inside.withColumn("_y", F.nanvl("_y", F.lit(None)))
    if known.where("_y is null").isEmpty():
        return inside
    ids = ["trace", "segment"]
    ahead = layout.fill(known, {"_a": "_y"}, keys=ids)
    both = layout.settle(layout.fill(ahead, {"_b": "_y"}, keys=ids, backward=True))
    return layout.settle(both.withColumn("_y", F.coalesce("_a", "_b")).drop("_a", "_b").where("_y is not null"))


def _best_cut(cum: np.ndarray, a: int, b: int) -> tuple[float, int]:
    """Change of the squared error by the best cut of ``[a, b)``, and that cut."""
    size, base = b - a, cum[a]
    left = np.arange(1, size)
    sl, s = cum[a + 1:b] - base, cum[b] - base
    gain = s * s / size - sl * sl / left - (s - sl) ** 2 / (size - left)
    at = int(np.argmin(gain))
    return float(gain[at]), a + at + 1


def _fit_sorted(batches, penalty_factor: float):
    """Segments of rows sorted by trace, segment and position; one frame comes and goes per batch, not per segment."""
    held = None  # the last segment of a batch may go on in the next
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if held.empty:
            continue
        first = _firsts(held)
        if len(first) > 1:
            yield _fit_frame(held, first, penalty_factor)
            held = held.iloc[first[-1]:].reset_index(drop=True)
    if held is not None and len(held):
        yield _fit_frame(held, np.array([0, len(held)]), penalty_factor)


def _firsts(pdf: pd.DataFrame) -> np.ndarray:
    """Row at which each segment begins."""
    trace, segment = pdf["trace"].to_numpy(), pdf["segment"].to_numpy()
    return np.r_[0, np.flatnonzero((trace[1:] != trace[:-1]) | (segment[1:] != segment[:-1])) + 1]


def _fit_frame(pdf: pd.DataFrame, borders: np.ndarray, penalty_factor: float) -> pd.DataFrame:
    """Dwells of the segments between neighbouring ``borders``."""
    at, values = pdf["i"].to_numpy(), pdf["_y"].to_numpy(dtype=float)
    owner, start, stop, level = [], [], [], []
    for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist()):
        cuts, means = _fit_segment(values[lo:hi], penalty_factor)
        base = int(at[lo])
        owner += [lo] * len(means)
        start += [base + c for c in cuts[:-1]]
        stop += [base + c for c in cuts[1:]]
        level += means
    return pd.DataFrame({"trace": pdf["trace"].to_numpy()[owner], "segment": pdf["segment"].to_numpy()[owner],
                         "start": start, "stop": stop, "level": level})


def _fit_segment(y: np.ndarray, penalty_factor: float) -> tuple[list[int], list[float]]:
    """Best-first splitting of one segment: borders of its dwells, and their levels."""
    size = len(y)
    if size == 1:
        return [0, 1], [float(y[0])]
    mean = y.mean()
    cum = np.concatenate([[0.0], np.cumsum(y - mean)])
    chi2 = float(((y - mean) ** 2).sum())
    penalty = -0.5 * math.log(size) * penalty_factor
    heap = [(*_best_cut(cum, 0, size), 0, size)]
    cuts = [0]
    while heap:
        gain, cut, a, b = heapq.heappop(heap)
        if not _raises_likelihood(gain, chi2, size, penalty):
            break
        chi2 += gain
        cuts.append(cut)
        for c, d in ((a, cut), (cut, b)):
            if d - c > 2:
                heapq.heappush(heap, (*_best_cut(cum, c, d), c, d))
    cuts = sorted(cuts) + [size]
    return cuts, [float(mean + (cum[b] - cum[a]) / (b - a)) for a, b in zip(cuts[:-1], cuts[1:])]


def _fit_in_rounds(inside: DataFrame, penalty_factor: float, max_rounds: int) -> DataFrame:
    """The same fit with every piece spread over its chunks.

    The loop ends when no accepted split has unseen pieces; the rounds needed follow the
    depth of the split tree.
    """
    total = inside.groupBy("trace", "segment").agg(
        F.count(F.lit(1)).alias("m"), F.avg("_y").alias("_mean"), F.min("i").alias("seg_start"),
        (F.max("i") + 1).alias("seg_stop"), F.var_pop("_y").alias("_var"), F.max("chunk").alias("_last"),
        F.min("chunk").alias("_first"))
    total = layout.settle(total.withColumn("chi2", F.col("_var") * F.col("m")))
    # centred prefix sums, once for all rounds
    wide = total.withColumn("chunk", F.explode(F.sequence("_first", "_last"))).select(
        "trace", "segment", "chunk", "_mean")
    centred = inside.join(wide, ["trace", "segment", "chunk"]).withColumn("_y", F.col("_y") - F.col("_mean"))
    cum = layout.settle(layout.running_sum(centred.select("trace", "i", "n", "chunk", "segment", "_y"), {"_cum": "_y"}))
    ids = ["trace", "segment"]
    open_ = total.where("m >= 2").select(*ids, F.col("seg_start").alias("start"), F.col("seg_stop").alias("stop"))
    nodes = None
    schema = None
    for _ in range(max_rounds):
        open_ = layout.settle(open_)
        if open_.isEmpty():
            break
        found = _best_splits(cum, open_)
        fresh = found.join(total.select(*ids, "m", "chi2", "seg_start", "seg_stop"), ids).withColumn(
            "taken", F.lit(False))
        schema = schema or fresh.schema
        known = fresh if nodes is None else nodes.unionByName(fresh)
        nodes = layout.settle(known.groupBy(*ids).applyInPandas(
            lambda pdf: _accept(pdf, penalty_factor), known.schema))
        halves = nodes.where("taken").select(*ids, F.explode(F.array(
            F.struct("start", F.col("cut").alias("stop")), F.struct(F.col("cut").alias("start"), "stop"))).alias("p"))
        halves = halves.select(*ids, "p.*").where("stop - start > 2")
        open_ = halves.join(nodes.select(*ids, "start", "stop"), [*ids, "start", "stop"], "left_anti")
    else:
        raise RuntimeError("step finding did not settle; raise max_rounds")
    cuts = total.select(*ids, F.col("seg_start").alias("at"))
    if nodes is not None:
        cuts = cuts.unionByName(nodes.where("taken").select(*ids, F.col("cut").alias("at")))
    marks = cuts.groupBy("trace", F.col("at").alias("i")).agg(F.lit(1).alias("_mark"))
    tagged = cum.join(marks, ["trace", "i"], "left")
    numbered = layout.running_sum(tagged, {"_p": F.coalesce("_mark", F.lit(0))})
    level = numbered.groupBy(*ids, "_p").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"),
                                             F.avg("_y").alias("_l"))
    return level.join(total.select(*ids, "_mean"), ids).select(
        *ids, "start", "stop", (F.col("_l") + F.col("_mean")).alias("level"))


def _best_splits(cum: DataFrame, pieces: DataFrame) -> DataFrame:
    """Best cut of each piece and the drop of its squared error (negative)."""
    tagged = pieces.withColumn("piece", F.struct("segment", "start", "stop"))
    rows = runs.assign(cum.drop("segment"), tagged, "piece").where("piece is not null")
    ends = rows.groupBy("trace", "piece").agg(
        F.max("chunk").alias("_last"), F.min("chunk").alias("_first"),
        F.min_by(F.col("_cum") - F.col("_y"), "i").alias("_base"), F.max_by("_cum", "i").alias("_end"))
    wide = ends.withColumn("chunk", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    rows = rows.join(wide, ["trace", "piece", "chunk"])
    size, left = F.col("piece.stop") - F.col("piece.start"), F.col("i") + 1 - F.col("piece.start")
    s, sl = F.col("_end") - F.col("_base"), F.col("_cum") - F.col("_base")
    gain = s * s / size - sl * sl / left - (s - sl) * (s - sl) / (size - left)
    cand = rows.where(F.col("i") + 1 < F.col("piece.stop")).select("trace", "piece", F.struct(
        gain.alias("gain"), (F.col("i") + 1).alias("cut")).alias("c"))
    best = cand.groupBy("trace", "piece").agg(F.min("c").alias("c"))
    return best.select("trace", "piece.segment", "piece.start", "piece.stop", "c.gain", "c.cut")


def clean_dwells(dwells: DataFrame, min_samples: int, min_step: float) -> DataFrame:
    """Absorb short dwells, then small steps, within each segment; ``level`` may repeat across segments.

    A segment too short for two dwells becomes one dwell at its mean.
    """
    length = (F.col("stop") - F.col("start"))
    seg = dwells.groupBy("trace", "segment").agg(
        F.sum(length).alias("_m"), (F.sum(F.col("level") * length) / F.sum(length)).alias("_mean"),
        F.min("start").alias("start"), F.max("stop").alias("stop"))
    seg = layout.settle(seg)
    short = seg.where(f"_m < {2 * min_samples}").select("trace", "segment", "start", "stop", F.col("_mean").alias("level"))
    rest = dwells.join(seg.where(f"_m >= {2 * min_samples}").select("trace", "segment"), ["trace", "segment"], "left_semi")
    # segments act as traces of their own while dwells are merged
    keyed = rest.select(F.struct("trace", "segment").alias("trace"), "start", "stop", "level")
    size = layout.CHUNK_ROWS
    ranked = layout.running_sum(keyed.withColumn("chunk", F.expr(f"start div {size}L")), {"_r": F.lit(1)}, order=["start"])
    base = layout.settle(ranked.select("trace", F.expr("cast(_r - 1 as bigint)").alias("k"), "start", "stop", "level"))
    done = runs.absorb_small(runs.absorb_short(base, min_samples), min_step)
    return done.select("trace.trace", "trace.segment", "start", "stop", "level").unionByName(short)


def ideal_trace(pauses: DataFrame, dwells: DataFrame, tolerance: float) -> DataFrame:
    """Dwells of the whole trace from pause levels and fitted steps in between.

    ``pauses`` is ``trace, start, stop, level``; ``dwells`` has ``segment`` too.  Where a
    pause and the neighbouring step dwell differ by less than ``tolerance`` the dwell
    takes the pause level; borders are visited from left to right, so a dwell between two
    pauses may be moved twice.
    """
    edge = dwells.groupBy("trace", "segment").agg(F.min("start").alias("_a"), F.max("stop").alias("_b"))
    tagged = dwells.join(edge, ["trace", "segment"])
    parts = (pauses.select("trace", "start", "stop", "level", F.lit(True).alias("is_pause"),
                           F.lit(False).alias("head"), F.lit(False).alias("tail"))
             .unionByName(tagged.select("trace", "start", "stop", "level", F.lit(False).alias("is_pause"),
                                        (F.col("start") == F.col("_a")).alias("head"),
                                        (F.col("stop") == F.col("_b")).alias("tail"))))
    size = layout.CHUNK_ROWS
    ranked = layout.running_sum(parts.withColumn("chunk", F.expr(f"start div {size}L")), {"_r": F.lit(1)}, order=["start"])
    base = layout.settle(layout.with_chunk(ranked.withColumn("i", F.expr("cast(_r - 1 as bigint)")).drop("_r")))

    def moved(w, f):
        prev_pause = F.lag("is_pause").over(w)
        prev, nxt = F.lag("level").over(w), F.lead("level").over(w)
        first = F.when(prev_pause & (F.abs(prev - F.col("level")) < tolerance), prev).otherwise(F.col("level"))
        second = F.when(F.lead("is_pause").over(w) & (F.abs(first - nxt) < tolerance), nxt).otherwise(first)
        at_head = F.when(F.col("head") & ~F.col("tail"), first)
        at_tail = F.when(F.col("tail") & ~F.col("head"), F.when(
            F.lead("is_pause").over(w) & (F.abs(F.col("level") - nxt) < tolerance), nxt).otherwise(F.col("level")))
        return F.when(F.col("is_pause"), F.col("level")).when(F.col("head") & F.col("tail"), second).otherwise(
            F.coalesce(at_head, at_tail, F.col("level")))

    out = layout.sliding(base, 1, 1, {"_new": moved})
    return out.select("trace", F.col("i").alias("k"), "start", "stop", F.col("_new").alias("level"), "is_pause")


def interval_means(samples: DataFrame, intervals: DataFrame, value: str) -> DataFrame:
    """Level of each interval: the mean of its samples."""
    inside = runs.assign(samples, intervals).where("segment is not null")
    return inside.groupBy("trace", F.col("segment").alias("k")).agg(
        F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.avg(value).alias("level"))
