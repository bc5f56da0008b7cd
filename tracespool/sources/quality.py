"""Checks of sample and annotation tables; each returns the violations."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace_violations(samples: DataFrame, constant: Sequence[str] = (), source: str | None = None) -> DataFrame:
    """``trace, rule`` for missing ids, varying constants, mixed sources and broken positions.

    Only algebraic aggregates are used, so a huge trace needs no special care.
    """
    present = {c: F.count(c) for c in constant}
    aggs = [F.count(F.lit(1)).alias("_n")]
    rules = [F.when(F.col("trace").isNull(), "null_id")]
    for c in constant:
        aggs += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"), present[c].alias(f"_p_{c}")]
        rules.append(F.when((F.col(f"_lo_{c}") != F.col(f"_hi_{c}"))
                            | F.col(f"_p_{c}").between(1, F.col("_n") - 1), f"varying_{c}"))
    if source:
        aggs += [F.min(source).alias("_slo"), F.max(source).alias("_shi")]
        rules.append(F.when(F.col("_slo") != F.col("_shi"), "many_sources"))
    if "i" in samples.columns:
        # 0..n-1 without gaps or repeats
        aggs += [F.min("i").alias("_ilo"), F.max("i").alias("_ihi"), F.countDistinct("i").alias("_d")]
        rules.append(F.when((F.col("_ilo") != 0) | (F.col("_ihi") != F.col("_n") - 1)
                            | (F.col("_d") != F.col("_n")), "broken_positions"))
    found = samples.groupBy("trace").agg(*aggs)
    return found.select("trace", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"))


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys of ``left`` without a partner in ``right``."""
    return (left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")
            .withColumn("rule", F.lit(rule)))
