"""Exact quantiles of groups of any size.

`percentile` keeps every distinct value of a group in one task, which fails for a group
that holds a large share of the data.  Here a mergeable sketch (`percentile_approx`)
brackets each wanted rank first; only the rows inside the brackets are then ranked.
Results are exact: the sketch's rank error is bounded by ``1/accuracy``, the brackets
are two errors wide, and a rank that falls outside its bracket raises.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 2000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    attach: Callable[[DataFrame, DataFrame], DataFrame], out: str = "q",
                    accuracy: int = ACCURACY) -> DataFrame:
    """``keys, n, <out>`` with linearly interpolated quantiles as an array.

    Chunked input also gives ``_last``, the highest chunk, for `layout.spread`.
    ``attach(rows, table)`` joins a per-group table (keys, n, ...) back to the rows.
    NULL and NaN values are ignored.
    """
    pad = 2.0 / accuracy
    edges = [max(0.0, p - pad) for p in probs] + [min(1.0, p + pad) for p in probs]
    m = len(probs)
    rows = df.where(f"{value} is not null and not isnan({value})").withColumn(
        "_v", F.col(value).cast("double"))
    tail = [F.max("chunk").alias("_last")] if "chunk" in df.columns else []
    sketch = rows.groupBy(*keys).agg(
        *tail,
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", edges, accuracy).alias("_e"))
    # small groups, and brackets that reach an end, keep every row up to the extreme
    los = [F.when(F.col("n") <= accuracy, F.col("_min")).otherwise(
        F.col("_min") if edges[k] == 0.0 else F.col("_e")[k]) for k in range(m)]
    his = [F.when(F.col("n") <= accuracy, F.col("_max")).otherwise(
        F.col("_max") if edges[m + k] == 1.0 else F.col("_e")[m + k]) for k in range(m)]
    extra = ["_last"] if tail else []
    brackets = sketch.select(*keys, *extra, "n", F.col("n").alias("_n"), *[F.col(c).alias(f"_keep{c}") for c in extra], F.array(*los).alias("_lo"),
                             F.array(*his).alias("_hi"))
    near = attach(rows.drop("n"), brackets)
    inside = " or ".join(f"(_v between _lo[{k}] and _hi[{k}])" for k in range(m))
    # rows between brackets are only counted, keyed by the bracket they precede
    slot = " + ".join(f"cast(_v >= _lo[{k}] as int) + cast(_v > _hi[{k}] as int)" for k in range(m))
    tally = (near.withColumn("_in", F.expr(inside)).withColumn("_slot", F.expr(slot))
             .withColumn("_w", F.when(F.col("_in"), F.col("_v")))
             .groupBy(*keys, "_n", *[f"_keep{c}" for c in extra], "_slot", "_w", "_in").agg(F.count(F.lit(1)).alias("_c")))
    per_slot = tally.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = per_slot.select(*keys, "_slot", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    inner = (Window.partitionBy(*keys, "_slot").orderBy("_w")
             .rowsBetween(Window.unboundedPreceding, 0))
    ranked = (tally.where("_in").join(base, [*keys, "_slot"])
              .withColumn("_hiR", F.col("_b") + F.sum("_c").over(inner))
              .withColumn("_loR", F.col("_hiR") - F.col("_c")))
    picks = []
    for k, p in enumerate(probs):
        pos = f"({p!r}D * (_n - 1))"
        for tag, rank in (("f", f"floor({pos})"), ("c", f"ceil({pos})")):
            picks.append(F.max(F.expr(f"case when _loR <= {rank} and {rank} < _hiR then _w end"))
                         .alias(f"_{tag}{k}"))
    chosen = ranked.groupBy(*keys).agg(F.max("_n").alias("n"), *[F.max(f"_keep{c}").alias(c) for c in extra], *picks)
    parts = []
    for k, p in enumerate(probs):
        pos = f"({p!r}D * (n - 1))"
        parts.append(F.expr(
            f"case when _f{k} is null or _c{k} is null then "
            f"cast(raise_error('quantile rank outside its bracket') as double) "
            f"else _f{k} + (_c{k} - _f{k}) * ({pos} - floor({pos})) end"))
    return chosen.select(*keys, "n", *extra, F.array(*parts).alias(out))
