"""Long rows <-> array records.

A record holds one chunk of one trace, so its arrays have a bounded length whatever
the length of the trace.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.plans import layout


def to_records(samples: DataFrame, cols: Sequence[str]) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("i", *cols)))
    return (samples.groupBy("trace", "n", "chunk").agg(packed.alias("_r"))
            .select("trace", "n", "chunk", F.col("_r.i").alias("i"),
                    *[F.col(f"_r.{c}").alias(c) for c in cols]))


def to_rows(records: DataFrame, cols: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Explode array columns side by side; scalar columns repeat on each row."""
    keep = [c for c in records.columns if c not in cols]
    rows = records.select(*keep, F.explode(F.arrays_zip(*cols)).alias("_r"))
    rename = rename or {}
    return rows.select(*keep, *[F.col(f"_r.{c}").alias(rename.get(c, c)) for c in cols])


def annotation_rows(transitions: DataFrame, per_trace: DataFrame, position: str) -> DataFrame:
    """Number transitions per trace and repeat the per-trace annotation on each.

    Relax curves (``curve_type`` R) list their transitions backwards.  If ``per_trace``
    has ``expected``, a different number of transitions raises.
    """
    ranked = layout.index_samples(transitions, [position])
    rows = layout.salted(ranked, per_trace, ["trace"], salt=position)
    if "expected" in per_trace.columns:
        rows = rows.withColumn("n", F.when(F.col("n") == F.col("expected"), F.col("n")).otherwise(
            F.raise_error(F.lit("annotation length differs from the number of transitions")).cast("bigint")))
    k = F.when(F.col("curve_type") == "R", F.col("n") - 1 - F.col("i")).otherwise(F.col("i"))
    return rows.withColumn("k", k).drop("i", "chunk")
