"""Long pauses of a contour-length trace, from how long it stays where."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.operators import filters, runs, stats
from tracespool.operators.quantiles import exact_quantiles
from tracespool.plans import layout
from tracespool.plans.layout import whole_groups

LOCAL_ROWS = 1 << 20  # traces up to this size merge their candidates inside one task


def _known(value: str):
    """The value as a number, NULL for NaN."""
    return F.nanvl(F.col(value).cast("double"), F.lit(None))


def candidates(samples: DataFrame, value: str, tolerance: float, mad_factor: float = 5.0) -> DataFrame:
    """Runs of samples in bins visited longer than median + factor x MAD of all bins.

    A missing sample (NULL or NaN) is in no bin and ends a run.
    """
    rows = samples.select("trace", "i", "n", "chunk", _known(value).alias("_y"))
    tau = layout.settle(stats.residence_time(rows, "_y", tolerance))
    binned = layout.with_chunk(tau.select("trace", F.col("bin").alias("i"), "bin", "tau"))
    lim = stats.mad(binned, ["trace"], "tau", layout.spread)
    hot = layout.salted(tau, lim.select("trace", (F.col("median") + mad_factor * F.col("mad")).alias("_lim")), ["trace"], salt="bin")
    hot = layout.settle(hot.where("tau > _lim").select("trace", "bin"))
    ends = rows.groupBy("trace").agg(F.max("chunk").alias("_last"), F.min("_y").alias("_lo"))
    bins = tau.groupBy("trace").agg(F.max("bin").alias("_top"))
    rows = layout.spread(rows, layout.settle(ends.join(bins, "trace")))
    at = F.least(stats.bin_index(F.col("_y"), F.col("_lo"), F.lit(float(tolerance))), F.col("_top"))
    # the join key (trace, bin) may be hot: a pause is where a trace stays
    tagged = layout.salted(rows.withColumn("bin", at), hot.withColumn("_hot", F.lit(True)), ["trace", "bin"], "left", salt="i")
    return runs.labelled(tagged.select("trace", "i", "n", "chunk", "_hot"), F.coalesce("_hot", F.lit(False)))


def _middle(values: np.ndarray) -> float:
    """Median of a few values, without the checks that take longer than the sort."""
    s = np.sort(values)
    return float((s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2)


def merge_fragments(samples: DataFrame, value: str, found: DataFrame, tolerance: float,
                    local_rows: int | None = None) -> DataFrame:
    """Join neighbouring candidates, left to right, while their medians stay within tolerance.

    The median of a growing pause covers every sample from its first to its last that is
    not missing (NULL or NaN), whatever the size of the trace.
    """
    limit = local_rows or LOCAL_ROWS
    sizes = samples.groupBy("trace").agg(F.max("n").alias("n"))
    small = sizes.where(f"n <= {limit}").select("trace")
    tagged = runs.assign(samples.select("trace", "i", "n", "chunk", _known(value).alias("_y")), found)
    tagged = layout.settle(tagged.where("_y is not null").select("trace", "i", "n", "chunk", "_y", "segment"))
    kind = samples.schema["trace"].dataType.simpleString()

    def merge(batches):
        for table, borders in whole_groups(batches, ("trace",)):
            at, y = table.column("i").to_numpy(), table.column("_y").to_numpy()
            seg = table.column("segment").fill_null(-1).to_numpy()
            owner, start, stop, number = [], [], [], []
            # runs of one segment, which end with the trace
            new = np.r_[True, seg[1:] != seg[:-1]]
            new[borders[:-1]] = True
            edges = np.r_[np.flatnonzero(new), len(seg)]
            first = np.searchsorted(edges, borders)
            for trace, lo, hi in zip(borders[:-1].tolist(), first[:-1].tolist(), first[1:].tolist()):
                out = []
                for a, b in zip(edges[lo:hi].tolist(), edges[lo + 1:hi + 1].tolist()):
                    if seg[a] < 0:
                        continue
                    level = _middle(y[a:b])
                    if out and abs(level - out[-1][2]) <= tolerance:
                        a = out.pop()[0]
                        level = _middle(y[a:b])
                    out.append((a, b, level))
                owner += [trace] * len(out)
                number += range(len(out))
                start += [int(at[a]) for a, _, _ in out]
                stop += [int(at[b - 1]) + 1 for _, b, _ in out]
            yield pa.RecordBatch.from_arrays([
                table.column("trace").take(pa.array(owner, pa.int64())).combine_chunks(),
                *[pa.array(c, pa.int64()) for c in (number, start, stop)]], ["trace", "k", "start", "stop"])

    local = tagged.select("trace", "i", "_y", "segment").join(small, "trace", "left_semi")
    ordered = layout.by_group(local, "trace").sortWithinPartitions("trace", "i")
    done = ordered.mapInArrow(merge, f"trace {kind}, k bigint, start bigint, stop bigint")
    big = layout.settle(sizes.where(f"n > {limit}").select("trace"))
    if not big.isEmpty():
        done = done.unionByName(_merge_rounds(tagged.join(big, "trace", "left_semi"), found.join(big, "trace", "left_semi"), tolerance))
    return layout.settle(done)


def _merge_rounds(tagged: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """The same walk for traces too long for one task: one candidate of each trace per round."""
    rows = layout.settle(tagged.select("trace", "i", "n", "chunk", "_y", "segment"))
    med = exact_quantiles(rows.where("segment is not null").drop("chunk"), ["trace", "segment"], "_y", [0.5],
                          lambda r, t: layout.salted(r, t, ["trace", "segment"], salt="i"))
    steps = found.select("trace", F.col("k").alias("segment"), "start", "stop").join(
        med.select("trace", "segment", F.col("q")[0].alias("_med")), ["trace", "segment"])
    steps = layout.settle(steps)
    groups = layout.settle(steps.where("segment = 0").select("trace", F.lit(0).cast("bigint").alias("k"), "start", "stop", "_med"))
    closed, j = [], 1
    while True:
        nxt = layout.settle(steps.where(F.col("segment") == j))
        if nxt.isEmpty():
            break
        pair = groups.join(nxt.select("trace", F.col("start").alias("_a"), F.col("stop").alias("_b"), F.col("_med").alias("_m2")), "trace", "left")
        pair = layout.settle(pair.withColumn("_joins", F.coalesce(F.abs(F.col("_m2") - F.col("_med")) <= tolerance, F.lit(False))))
        closed.append(layout.settle(pair.where("_a is null or not _joins").select("trace", "k", "start", "stop")))
        grown = pair.where("_joins").select("trace", "k", "start", F.col("_b").alias("stop"))
        inside = runs.assign(rows.drop("segment"), grown.select("trace", "k", "start", "stop")).where("segment is not null")
        q = exact_quantiles(inside.drop("segment"), ["trace"], "_y", [0.5], layout.spread)
        grown = grown.join(q.select("trace", F.col("q")[0].alias("_med")), "trace")
        fresh = pair.where("_a is not null and not _joins").select(
            "trace", (F.col("k") + 1).alias("k"), F.col("_a").alias("start"), F.col("_b").alias("stop"), F.col("_m2").alias("_med"))
        groups = layout.settle(grown.unionByName(fresh))
        j += 1
    out = groups.select("trace", "k", "start", "stop")
    for part in closed:
        out = out.unionByName(part)
    return out


def split_jumps(samples: DataFrame, value: str, found: DataFrame, tolerance: float, window: int) -> DataFrame:
    """Cut pauses where the medians of the windows before and after a sample differ."""
    spans = found.withColumn("pause", F.struct("k", "start", "stop"))
    inside = runs.assign(samples.select("trace", "i", "n", "chunk", F.col(value).alias("_y")), spans, "pause")
    inside = layout.settle(inside.where("pause is not null").select("trace", "i", "n", "chunk", "_y", "pause"))
    both = layout.sliding(inside, window, window, {
        "_left": lambda w, f: F.collect_list("_y").over(w.rowsBetween(-window, -1)),
        "_right": lambda w, f: F.collect_list("_y").over(w.rowsBetween(0, window - 1))})
    core = (F.col("i") >= F.col("pause.start") + window) & (F.col("i") < F.col("pause.stop") - window)
    jump = F.abs(filters._median(F.col("_right")) - filters._median(F.col("_left"))) > tolerance
    kept = layout.settle(both.withColumn("_on", ~F.coalesce(F.when(core, jump), F.lit(False))).select(
        "trace", "i", "n", "chunk", "_on", F.col("pause.k").alias("_k")))
    # neighbouring pauses that touch stay one stretch, as labels do
    cut = layout.sliding(kept.where("_on"), 1, 0, {"_new": lambda w, f: F.coalesce(
        (F.col("i") - F.lag("i").over(w) > 1).cast("bigint"), F.lit(1))})
    parts = layout.running_sum(cut, {"_p": "_new"}).groupBy("trace", F.expr("cast(_p - 1 as bigint)").alias("k")).agg(
        F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))
    return layout.settle(parts)


def putative_pauses(samples: DataFrame, value: str, tolerance: float, mad_factor: float = 5.0, window: int = 313,
                    min_samples: int = 1250, local_rows: int | None = None) -> DataFrame:
    """Pauses ``trace, k, start, stop, level`` of a smoothed contour-length trace.

    Candidate runs are merged, split at jumps, and kept from ``min_samples`` on.
    """
    found = candidates(samples, value, tolerance, mad_factor)
    merged = merge_fragments(samples, value, found, tolerance, local_rows)
    parts = split_jumps(samples, value, merged, tolerance, window)
    long = runs.renumber(parts.where(f"stop - start >= {min_samples}"))
    inside = runs.assign(samples, long).where("segment is not null")
    return layout.settle(inside.groupBy("trace", F.col("segment").alias("k")).agg(
        F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.avg(value).alias("level")))
