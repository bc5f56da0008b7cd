"""Sizes between runs of one molecule: from the first transition of an earlier run to the first one of the last run."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.operators import legs, paths
from tracespool.plans import layout


def chained(samples: DataFrame, transitions: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each earlier run followed by the last one, as traces of their own: samples, and transitions numbered through.

    ``pairs`` is ``into, trace, after, n, m, n_after`` (new id, the two traces, samples and transitions of the first, samples
    of the second).  The last run is copied once for each earlier one, chunk by chunk.
    """
    rows = samples.drop("n")
    head = pairs.select("trace", "n", "into", F.lit(0).cast("bigint").alias("_shift"), (F.col("n") + F.col("n_after")).alias("_n"))
    tail = pairs.select(F.col("after").alias("trace"), F.col("n_after").alias("n"), "into", F.col("n").alias("_shift"), (F.col("n") + F.col("n_after")).alias("_n"))
    both = layout.spread(rows, head.unionByName(tail))
    both = both.withColumn("i", F.col("i") + F.col("_shift")).withColumn("trace", F.col("into")).withColumnRenamed("_n", "n")
    t = transitions.select("trace", "k", "at")
    first = t.join(pairs, "trace").select(F.col("into").alias("trace"), "k", "at")
    after = t.join(pairs.drop("trace").withColumnRenamed("after", "trace"), "trace").select(
        F.col("into").alias("trace"), (F.col("k") + F.col("m")).alias("k"), (F.col("at") + F.col("n")).alias("at"))
    return layout.settle(layout.with_chunk(both.drop("into", "_shift"))), layout.settle(first.unionByName(after))


def cross_sizes(samples: DataFrame, transitions: DataFrame, states: DataFrame, d: str = "d", f: str = "f", padding: int = 3,
                earlier: Sequence[str] = ("fecS00", "fecS01", "fecS02"), last: str = "fecS03", **options) -> DataFrame:
    """``base, run, force, dext, dlc, source, state`` for each earlier run of each set.

    ``samples`` has ``base, run, trace, i, n, chunk``, ``transitions`` has ``trace, k, at`` and ``states`` gives the first
    state of the last run per base.  The size is read from the first transition of the earlier run to the first one of the
    last run (`direct`, without the check of the end point).  Where it cannot be, the first path over valid edges from there
    to a transition that the earlier run reaches, too, helps out (`detour`): the size up to its end, minus the sizes of the
    last run from its first step through the one that begins at that end, as the established procedure
    adds them (the last transition begins a step of size zero).  Otherwise, also without a last run or without transitions, it is `missing`.
    """
    runs = layout.settle(samples.where(F.col("run").isin(*earlier, last)).groupBy("base", "run", "trace").agg(F.max("n").alias("n")))
    count = transitions.groupBy("trace").agg(F.count(F.lit(1)).alias("m"))
    seen = runs.join(count, "trace")
    end = seen.where(F.col("run") == last).select("base", F.col("trace").alias("after"), F.col("n").alias("n_after"))
    asked = runs.where(F.col("run") != last).select("base", "run", F.concat_ws("_", "base", "run").alias("into"))
    pairs = layout.settle(seen.where(F.col("run") != last).join(end, "base").select(
        "base", F.concat_ws("_", "base", "run").alias("into"), "trace", "after", "n", "m", "n_after"))
    chain, marks = chained(samples.select("trace", "i", "n", "chunk", d, f), transitions, pairs.drop("base"))
    rows = legs.leg_samples(chain, legs.legs(marks, padding), d, f)
    way = pairs.select(F.col("into").alias("trace"), F.lit(0).cast("bigint").alias("origin"), F.col("m").alias("target"))
    direct = legs.sizes_of(rows, [way.select("*", F.lit("direct").alias("kind"))], {**options, "sane": False})
    gaps = layout.settle(direct.where("dlc is null").select("trace", "origin", "target"))
    some = gaps.select("trace")
    edges = paths.valid_edges(layout.salted(chain, some, ["trace"], "left_semi", "i"), marks.join(some, "trace", "left_semi"),
                              f, options.get("navg", 5))
    later = gaps.join(marks.select("trace", "k"), "trace").where("k > target").select("trace", "origin", F.col("k").alias("target"))
    any_size = edges.unionByName(later).distinct().withColumn("dlc", F.lit(0.0))
    found = layout.settle(paths.shortest_detours(edges, gaps, any_size).select(
        "trace", "origin", F.col("target").alias("_b"), F.element_at("path", -1).alias("target")))
    far = legs.sizes_of(rows, [found.select("trace", "origin", "target", F.lit("far").alias("kind"))], {**options, "sane": False})
    inside, _ = legs.transition_sizes(*_of(samples, transitions, end.withColumnRenamed("after", "trace"), d, f), d, f, padding, **options)
    steps = pairs.select("into", F.col("after").alias("trace"), "m").join(inside.select("trace", "k", "dlc"), "trace").select(
        F.col("into").alias("trace"), (F.col("k") + F.col("m")).alias("k"), "dlc")
    taken = found.join(steps, "trace", "left").where("k is null or k <= target").groupBy("trace").agg(
        F.when(F.count_if(F.col("k").isNotNull() & F.col("dlc").isNull()) == 0, F.coalesce(F.sum("dlc"), F.lit(0.0))).alias("_taken"))
    over = far.join(taken, "trace").select("trace", (F.col("dlc") - F.col("_taken")).alias("_over"))
    out = asked.withColumnRenamed("into", "trace").join(direct.select("trace", "force", "dext", "dlc"), "trace", "left").join(over, "trace", "left")
    source = F.when(F.col("dlc").isNotNull(), "direct").when(F.col("_over").isNotNull(), "detour").otherwise("missing")
    out = out.withColumn("source", source).withColumn("dlc", F.coalesce("dlc", "_over"))
    return out.join(states.select("base", F.col("state").alias("_s")), "base", "left").select(
        "base", "run", "force", "dext", "dlc", "source", (F.col("_s") - F.col("dlc")).alias("state"))


def _of(samples: DataFrame, transitions: DataFrame, traces: DataFrame, d: str, f: str) -> tuple[DataFrame, DataFrame]:
    own = layout.salted(samples.select("trace", "i", "n", "chunk", d, f), traces.select("trace"), ["trace"], "left_semi", "i")
    return layout.settle(own), layout.settle(transitions.join(traces.select("trace"), "trace", "left_semi"))
