"""Power spectra."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.plans import layout


def welch(samples: DataFrame, value: str, rate: float, segment: int = 4096) -> DataFrame:
    """One-sided density ``trace, bin, frequency, power, power_db`` averaged over segments.

    Segments overlap by half, lose their mean and carry a Hann window.  Each (trace,
    segment) group has ``segment`` samples, however long the trace.  Traces shorter than
    a segment use one segment of their own length.
    """
    if segment % 2:
        raise ValueError("the segment length must be even")
    half = segment // 2
    size = F.least(F.col("n"), F.lit(segment))
    last = F.expr(f"case when n < {segment} then 0L else (n - {segment}) div {half}L end")
    own = F.expr(f"i div {half}L")
    rows = samples.select("trace", "n", "i", F.col(value).cast("double").alias("y"), last.alias("_last"), F.explode(
        F.when(F.col("n") < segment, F.array(F.lit(0).cast("bigint"))).otherwise(F.array(own - 1, own))).alias("seg"))
    rows = rows.where((F.col("seg") >= 0) & (F.col("seg") <= F.col("_last"))).withColumn("size", size)
    kind = samples.schema["trace"].dataType.simpleString()

    def periodogram(pdf):
        pdf = pdf.sort_values("i")
        y, m = pdf["y"].to_numpy(), int(pdf["size"].iloc[0])
        win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
        p = np.abs(np.fft.rfft((y - y.mean()) * win)) ** 2 / (rate * (win ** 2).sum())
        p[1:-1 if m % 2 == 0 else None] *= 2
        return pd.DataFrame({"trace": pdf["trace"].iloc[0], "size": m, "bin": np.arange(len(p)), "p": p})

    parts = layout.by_group(rows, "trace", "seg").groupBy("trace", "seg").applyInPandas(
        periodogram, f"trace {kind}, size bigint, bin bigint, p double")
    out = parts.groupBy("trace", "size", "bin").agg(F.avg("p").alias("power"))
    return out.select("trace", "bin", (F.col("bin") * float(rate) / F.col("size")).alias("frequency"), "power",
                      (10 * F.log10(F.when(F.col("power") > 0, F.col("power")))).alias("power_db"))
