"""Paths between transitions: valid edges, all simple paths by length, shortest detours around missing sizes.

A transition is a row ``trace, k, at``.  An edge says that the leg that ends in its target comes back to the force of
its origin, so that a distance can be read there.  Edges and paths are rows; paths grow by joins, one edge a round, and
what a round has made is written before the next one reads it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.operators import runs
from tracespool.plans import layout

CELLS = 64  #: cells of the force range of a trace, in which legs and transitions are paired


def _between(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Samples ``trace, k, i, f`` from each transition to the next (both included), from the least force on."""
    rows = layout.sliding(runs.as_rows(points.select("trace", "k", "at")), 1, 0, {"start": lambda w, f: F.lag("at").over(w)})
    legs = layout.settle(rows.where("start is not null").select("trace", "k", "start", F.col("at").alias("stop")))
    inner = runs.assign(samples, legs).where("segment is not null").select("trace", F.col("segment").alias("k"), "i", "f")
    ends = points.join(legs.select("trace", "k"), ["trace", "k"], "left_semi").select("trace", "k", F.col("at").alias("i"), "f")
    known = layout.settle(inner.unionByName(ends).where("f is not null and not isnan(f)"))
    low = known.groupBy("trace", "k").agg(F.min_by("i", F.struct("f", "i")).alias("_from"))
    return layout.settle(layout.salted(known, low, ["trace", "k"], salt="i").where("i >= _from").drop("_from"))


def valid_edges(samples: DataFrame, transitions: DataFrame, f: str = "f", minpoints: int = 5, reverse: bool = False,
                band: float = 1.0) -> DataFrame:
    """Edges ``trace, origin, target`` (numbers of transitions).

    A later transition is a target if more than ``minpoints`` samples between the one before it and itself, from the
    least force on, lie closer than ``band`` to the force at the origin; with ``reverse`` an earlier one is, too, by
    the samples between itself and the one after it.  Missing forces count nowhere.

    Only legs whose range of forces meets the band are paired with an origin.  Their samples are counted by running
    totals over sorted forces, with both ends of each band as markers in the same order.
    """
    rows = samples.select("trace", "i", "n", "chunk", F.col(f).cast("double").alias("f"))
    at = layout.with_chunk(transitions.select("trace", "k", F.col("at").alias("i")))
    points = layout.settle(at.join(rows.drop("n"), ["trace", "chunk", "i"]).select("trace", "k", F.col("i").alias("at"), "f"))
    legs = _between(rows, points)
    span = layout.settle(legs.groupBy("trace", "k").agg(F.min("f").alias("lo"), F.max("f").alias("hi")))
    width = span.groupBy("trace").agg(F.greatest(F.lit(2.0 * band), (F.max("hi") - F.min("lo")) / CELLS).alias("w"))
    cells = F.sequence(F.floor((F.col("lo") - band) / F.col("w")), F.floor((F.col("hi") + band) / F.col("w")))
    cut = span.join(width, "trace").select("trace", "k", "lo", "hi", F.explode(cells).alias("cell"))
    origin = points.where("f is not null and not isnan(f)").join(width, "trace").select(
        "trace", F.col("k").alias("origin"), F.col("f").alias("at_f"), F.floor(F.col("f") / F.col("w")).alias("cell"))
    meets = (F.col("at_f") > F.col("lo") - band) & (F.col("at_f") < F.col("hi") + band)
    pairs = origin.join(cut, ["trace", "cell"]).where(meets if reverse else meets & (F.col("k") > F.col("origin")))
    # strictly inside: the upper end comes before samples of its value, the lower end after them
    marks = pairs.select("trace", "k", "origin", F.explode(F.array(
        F.struct((F.col("at_f") - band).alias("f"), F.lit(1).alias("side")),
        F.struct((F.col("at_f") + band).alias("f"), F.lit(-1).alias("side")))).alias("m")).select(
            "trace", "k", "origin", "m.f", "m.side", F.lit(0).alias("w"))
    both = marks.unionByName(legs.select("trace", "k", F.lit(None).cast("bigint").alias("origin"), "f", F.lit(0).alias("side"), F.lit(1).alias("w")))
    cut = layout.slotted(both, ["trace", "k"], ["f", "side"])
    counted = layout.running_sum(cut, {"_c": "w"}, keys=("trace", "k"), block="_slot", order=("f", "side")).where("side <> 0")
    inside = counted.groupBy("trace", "origin", "k").agg(F.sum(F.col("_c") * -F.col("side")).alias("_m")).where(f"_m > {minpoints}")
    return layout.settle(inside.select("trace", "origin", F.when(F.col("k") > F.col("origin"), F.col("k")).otherwise(
        F.col("k") - 1).alias("target")))


def reachable(edges: DataFrame, seeds: DataFrame, backward: bool = False) -> DataFrame:
    """``trace, seed, node`` for every node that a path joins with ``trace, seed`` (itself included)."""
    a, b = ("target", "origin") if backward else ("origin", "target")
    hops = edges.select("trace", F.col(a).alias("node"), F.col(b).alias("_to"))
    found = fresh = layout.settle(seeds.select("trace", "seed", F.col("seed").alias("node")).distinct())
    while not fresh.isEmpty():
        step = fresh.join(hops, ["trace", "node"]).select("trace", "seed", F.col("_to").alias("node")).distinct()
        fresh = layout.settle(step.join(found, ["trace", "seed", "node"], "left_anti"))
        found = found.unionByName(fresh)
    return layout.settle(found)


def simple_paths(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """All paths without a repeated transition from ``origin`` to ``target`` of each row of ``ends``.

    ``trace, origin, target, rank, size, path``: ``rank`` counts from 0 by number of transitions; equal ones follow the
    order in which a depth-first walk meets them, later transitions ascending, then earlier ones descending.  Edges
    from which the target cannot be reached are dropped first, so no dead end without a loop is followed.  A path from a
    transition to itself is none.
    """
    ends = layout.settle(ends.select("trace", "origin", "target").where("origin <> target").distinct())
    live = reachable(edges, ends.select("trace", F.col("target").alias("seed")), backward=True)
    hops = layout.settle(edges.select("trace", F.col("origin").alias("_node"), F.col("target").alias("_to")).join(
        live.select("trace", F.col("seed").alias("target"), F.col("node").alias("_to")), ["trace", "_to"]))
    turn = F.when(F.col("_to") > F.col("_node"), F.col("_to")).otherwise((1 << 40) - F.col("_to"))
    keys = ["trace", "origin", "target"]
    open_ = ends.select(*keys, F.array("origin").alias("path"), F.array(F.lit(0).cast("bigint")).alias("turns"), F.col("origin").alias("_node"))
    done = None
    while done is None or not open_.isEmpty():
        longer = layout.salted(open_, hops, ["trace", "target", "_node"]).where(~F.array_contains("path", F.col("_to")))
        longer = layout.settle(longer.select(*keys, F.array_append("path", F.col("_to")).alias("path"),
                                             F.array_append("turns", turn).alias("turns"), F.col("_to").alias("_node")))
        ended = longer.where("_node = target")
        done = ended if done is None else done.unionByName(ended)
        open_ = longer.where("_node <> target")
    order = ["size", "turns"]
    cut = layout.slotted(done.select(*keys, "path", "turns", F.size("path").alias("size")), keys, order)
    ranked = layout.running_sum(cut, {"_r": F.lit(1)}, keys=keys, block="_slot", order=order)
    return layout.settle(ranked.select(*keys, F.expr("cast(_r - 1 as bigint)").alias("rank"), "size", "path"))


def shortest_detours(edges: DataFrame, gaps: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fill each gap ``trace, origin, target`` with a detour over a later transition c: origin to c minus target to c.

    ``sizes`` is ``trace, origin, target, dlc``.  The path from the target to c runs over edges of known size; c can be
    reached from the origin, and the size from there is known.  Of such paths the one with the fewest transitions is
    taken, then the nearest c, then the first in order.  ``trace, origin, target, path, dlc``; gaps without one are left out.

    Each round keeps one path per gap and end, the first of the shortest ones: what can follow an end does not depend on how
    it was reached, so no other path to it can win.
    """
    known = layout.settle(sizes.where("dlc is not null").select("trace", "origin", "target", "dlc"))
    gaps = layout.settle(gaps.select("trace", "origin", "target"))
    from_a = reachable(edges, gaps.select("trace", F.col("origin").alias("seed")))
    ends = layout.settle(from_a.select("trace", F.col("seed").alias("origin"), F.col("node").alias("_node")).join(
        known.select("trace", "origin", F.col("target").alias("_node"), F.col("dlc").alias("_whole")), ["trace", "origin", "_node"]))
    hops = layout.settle(edges.join(known, ["trace", "origin", "target"]).where("target > origin").select(
        "trace", F.col("origin").alias("_node"), F.col("target").alias("_to"), F.col("dlc").alias("_step")))
    keys = ["trace", "origin", "target"]
    open_ = gaps.select(*keys, F.col("target").alias("_node"), F.array("target").alias("path"), F.lit(0.0).alias("_sum"))
    seen = open_.select(*keys, "_node")
    done = None
    while done is None or not open_.isEmpty():
        longer = open_.join(hops, ["trace", "_node"]).select(
            *keys, F.col("_to").alias("_node"), F.array_append("path", F.col("_to")).alias("path"), (F.col("_sum") + F.col("_step")).alias("_sum"))
        best = longer.groupBy(*keys, "_node").agg(F.min_by(F.struct("path", "_sum"), "path").alias("_b"))
        best = layout.settle(best.join(seen, [*keys, "_node"], "left_anti").select(*keys, "_node", "_b.*"))
        seen = seen.unionByName(best.select(*keys, "_node"))
        hit = best.join(ends, ["trace", "origin", "_node"]).groupBy(*keys).agg(
            F.min_by(F.struct("path", (F.col("_whole") - F.col("_sum")).alias("dlc")), "_node").alias("_b"))
        hit = layout.settle(hit.select(*keys, "_b.*"))
        done = hit if done is None else done.unionByName(hit)
        open_ = layout.settle(best.join(hit, keys, "left_anti"))
    return layout.settle(done)
