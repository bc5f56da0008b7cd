"""Molecule sets, calibration lookups, decisions and offsets."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespool.functions import physics
from tracespool.plans import layout


def calibration_range(ramps: DataFrame, baselines: DataFrame, position: str) -> DataFrame:
    """Range per baseline: envelope of its ramps, cut to the baseline's own range.

    ``ramps`` has ``baseline``; a baseline without recording keeps the envelope.
    """
    env = ramps.groupBy("baseline").agg(F.min(position).alias("lo"), F.max(position).alias("hi"))
    own = baselines.groupBy("baseline").agg(F.min(position).alias("_lo"), F.max(position).alias("_hi"))
    out = env.join(own, "baseline", "left")
    return out.select("baseline", F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi"))


def stiffness_pivot(calpars: DataFrame) -> DataFrame:
    """One row per baseline with ``k1`` and ``k2`` from rows per trap."""
    return calpars.groupBy("baseline").agg(
        F.max(F.when(F.col("trap") == "trap1", F.col("kappa"))).alias("k1"),
        F.max(F.when(F.col("trap") == "trap2", F.col("kappa"))).alias("k2"))


def with_baseline(samples: DataFrame, per_baseline: DataFrame, salt: str = "i") -> DataFrame:
    """Left join of per-baseline results; ``error_code`` 1 marks a missing baseline."""
    table = per_baseline.withColumn("_hit", F.lit(True))
    joined = layout.salted(samples, table, ["baseline"], "left", salt=salt)
    return joined.withColumn("error_code", F.when(F.col("_hit").isNull(), 1).otherwise(0)).drop("_hit")


def from_representative(traces: DataFrame, base: str, run: str, representative: str,
                        cols: Sequence[str]) -> DataFrame:
    """Give every member of a set the values of its representative run."""
    rep = traces.groupBy(base).agg(*[
        F.max(F.when(F.col(run) == representative, F.col(c))).alias(f"set_{c}") for c in cols])
    return layout.salted(traces, rep, [base])


def apply_offsets(samples: DataFrame, offsets: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Add summed offsets per trace to sample columns; traces without offsets stay.

    ``targets`` maps sample column -> offset column.  Offsets accumulate over rows.
    """
    total = offsets.groupBy("trace").agg(*[F.sum(o).alias(f"_o{k}") for k, o in enumerate(targets.values())])
    joined = layout.salted(samples, total, ["trace"], "left", salt="i")
    moved = {c: F.col(c) + F.coalesce(F.col(f"_o{k}"), F.lit(0.0)) for k, c in enumerate(targets)}
    return joined.withColumns(moved).drop(*[f"_o{k}" for k in range(len(targets))])


def latest_decision(automatic: DataFrame, decisions: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Manual decisions override automatic values; the highest ``seq`` wins per trace."""
    last = decisions.groupBy("trace").agg(F.max_by(F.struct(*cols), "seq").alias("_d"))
    joined = automatic.join(last, "trace", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_d.{c}"), F.col(c)) for c in cols}).drop("_d")


def concatenate(first: DataFrame, second: DataFrame, rows: int | None = None) -> DataFrame:
    """Append the second part of each trace after the first; ``part`` tells them apart."""
    size = first.groupBy("trace").agg(F.max("n").alias("_n1"))
    other = second.groupBy("trace").agg(F.max("n").alias("_n2"))
    sizes = layout.settle(size.join(other, "trace", "full").select(
        "trace", F.coalesce("_n1", F.lit(0)).alias("_n1"), F.coalesce("_n2", F.lit(0)).alias("_n2")))
    both = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))
    wide = layout.spread(both.drop("n"), sizes.withColumn("n", F.greatest("_n1", "_n2")), rows=rows)
    out = wide.withColumn("i", F.when(F.col("part") == 1, F.col("i") + F.col("_n1")).otherwise(F.col("i")))
    return layout.with_chunk(out.withColumn("n", F.col("_n1") + F.col("_n2")).drop("_n1", "_n2"), rows)


def at_rupture(samples: DataFrame, curve: str = "curve_type", index: str = "rupture_index") -> DataFrame:
    """Keep a stretch curve up to its rupture and a relax curve from it on."""
    keep = F.when(F.col(curve) == "R", F.col("i") >= F.col(index)).otherwise(F.col("i") <= F.col(index))
    return layout.reindex(samples.where(keep), keep="src")


def flip(samples: DataFrame, when: Column) -> DataFrame:
    """Reverse the order of the traces where ``when`` holds."""
    return layout.with_chunk(samples.withColumn(
        "i", F.when(when, F.col("n") - 1 - F.col("i")).otherwise(F.col("i"))))


def zero_initial(samples: DataFrame, time: str, cols: Sequence[str], window: float = 0.25) -> DataFrame:
    """Subtract the mean over the first ``window`` seconds."""
    early = F.col(time) <= window
    off = samples.groupBy("trace").agg(F.max("n").alias("n"), *[
        F.avg(F.when(early, F.col(c))).alias(f"_o{k}") for k, c in enumerate(cols)])
    out = layout.spread(samples, off)
    return out.withColumns({c: F.col(c) - F.col(f"_o{k}") for k, c in enumerate(cols)}).drop(
        *[f"_o{k}" for k in range(len(cols))])


def zero_final(samples: DataFrame, time: str, cols: Sequence[str], window: float = 0.25,
               max_offset: float = 3.0) -> DataFrame:
    """Subtract the mean over the last ``window`` seconds if all channels stay small."""
    ends = samples.groupBy("trace").agg(F.max("n").alias("n"), F.max_by(time, "i").alias("_end"))
    late = layout.spread(samples, ends).where(F.col(time) >= F.col("_end") - window)
    off = late.groupBy("trace").agg(F.max("n").alias("n"), *[
        F.avg(c).alias(f"_o{k}") for k, c in enumerate(cols)])
    small = F.lit(True)
    for k in range(len(cols)):
        small = small & (F.abs(F.col(f"_o{k}")) < max_offset)
    out = layout.spread(samples, layout.settle(off.withColumn("_ok", small)))
    return out.withColumns({c: F.when(F.col("_ok"), F.col(c) - F.col(f"_o{k}")).otherwise(F.col(c))
                            for k, c in enumerate(cols)}).drop("_ok", *[f"_o{k}" for k in range(len(cols))])


def subsample(samples: DataFrame, max_points: int) -> DataFrame:
    """Every k-th sample so that at most ``max_points`` remain per trace."""
    stride = F.greatest(F.lit(1), F.ceil(F.col("n") / max_points))
    return samples.where(F.col("i") % stride == 0)


def subtract_baseline(samples: DataFrame, force: str, position: str, coeffs: str) -> DataFrame:
    return samples.withColumn(force, F.col(force) - physics.polyval(F.col(position), F.col(coeffs)))


def closest(samples: DataFrame, keys: Sequence[str], value: str, target: float, cols: Sequence[str],
            mask: Column | None = None) -> DataFrame:
    """Row whose value is closest to a target; the earliest row on ties."""
    rows = samples.where(mask) if mask is not None else samples
    return rows.groupBy(*keys).agg(F.min_by(
        F.struct(*cols), F.struct(F.abs(F.col(value) - target), F.col("i"))).alias("_r")).select(*keys, "_r.*")


def arg_extreme(samples: DataFrame, value: str, mask: Column, largest: bool = True) -> DataFrame:
    """Position of the extreme value inside a mask; the first one on ties."""
    key = F.struct(-F.col(value) if largest else F.col(value), F.col("i"))
    return samples.where(mask).groupBy("trace").agg(
        F.min_by("i", key).alias("at"), (F.max(value) if largest else F.min(value)).alias("extreme"))


def bounds(samples: DataFrame, d: str, f: str) -> DataFrame:
    return samples.groupBy("trace").agg(F.min(d).alias("d_min"), F.max(d).alias("d_max"),
                                        F.min(f).alias("f_min"), F.max(f).alias("f_max"))
