"""Incremental runs: which traces are new, reusable or stale, by presence, rate and signature."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespool.plans import layout


def rate_plan(wanted: DataFrame, saved_rates: DataFrame, target: float, discarded: DataFrame | None = None,
              recalculate: bool = False, rel: float = 1e-6, abs_: float = 1e-6) -> DataFrame:
    """``trace, action``: ``new``, ``reuse`` or ``recompute``; discarded traces are left out.

    A saved trace is reusable only if its ``rate`` is the target rate.
    """
    todo = wanted.select("trace").distinct()
    if discarded is not None:
        todo = todo.join(discarded.select("trace").distinct(), "trace", "left_anti")
    same = F.abs(F.col("rate") - target) <= abs_ + rel * abs(target)
    if recalculate:
        same = F.lit(False)
    joined = todo.join(saved_rates.select("trace", "rate"), "trace", "left")
    return joined.select("trace", F.when(F.col("rate").isNull(), "new").when(same, "reuse")
                         .otherwise("recompute").alias("action"))


def signature(parameters: Column) -> Column:
    """SHA-256 of a parameter struct's JSON."""
    return F.sha2(F.to_json(parameters), 256)


def stale(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Traces whose ``signature`` is missing or different in the stored output."""
    return wanted.select("trace", "signature").distinct().join(
        stored.select("trace", "signature").distinct(), ["trace", "signature"], "left_anti")


def parameter_record(parameters: DataFrame, stage: str) -> DataFrame:
    """One row per run: stage name, parameters as JSON and their signature."""
    packed = F.struct(*parameters.columns)
    return parameters.select(F.lit(stage).alias("stage"), F.to_json(packed).alias("parameters"),
                             signature(packed).alias("signature"))


# Stored form of a polymer model: components in series, NULL marks an unknown or absent value.
MODEL_SCHEMA = "array<struct<Lp: double, Lc: double, St: double>>"


def stored_model(records: DataFrame, field: str = "model") -> DataFrame:
    """Read a polymer model back from parameter records."""
    return records.select("stage", F.from_json(F.get_json_object("parameters", f"$.{field}"), MODEL_SCHEMA).alias("model"))


def stale_stages(wanted: DataFrame, stored: DataFrame, needs: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """``trace, stage, reason`` of all stages to clear and run again.

    ``wanted`` and ``stored`` give a ``signature`` per trace and stage; ``needs`` has a row ``stage, needs`` for each stage
    that another one reads.  A stage is `forced` if ``forced`` (``trace, stage``) names it, `new` without a stored
    signature, `changed` with a different one, and `follows` if a stage that it reads, directly or over others,
    is any of these.  Marks are handed on until none is added, so loops in ``needs`` do no harm.  Shuffles start from
    many partitions, so the memory of a task does not follow the table (`layout.bounded_tasks`).
    """
    layout.unpacked_sizes(wanted.sparkSession)
    layout.bounded_tasks(wanted.sparkSession)
    both = wanted.select("trace", "stage", "signature").join(
        stored.select("trace", "stage", F.col("signature").alias("_old")), ["trace", "stage"], "left")
    own = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("signature"), "changed")
    if forced is not None:
        both = both.join(forced.select("trace", "stage", F.lit(True).alias("_f")).distinct(), ["trace", "stage"], "left")
        own = F.when(F.col("_f"), "forced").otherwise(own)
    here = both.select("trace", "stage").distinct()
    links = needs.select(F.col("needs").alias("stage"), F.col("stage").alias("_to")).distinct()
    marks = fresh = layout.settle(both.select("trace", "stage", own.alias("reason")).where("reason is not null"))
    while not fresh.isEmpty():
        step = fresh.join(links, "stage").select("trace", F.col("_to").alias("stage")).distinct()
        fresh = layout.settle(step.join(here, ["trace", "stage"], "left_semi").join(marks, ["trace", "stage"], "left_anti").select(
            "trace", "stage", F.lit("follows").alias("reason")))
        marks = marks.unionByName(fresh)
    return layout.settle(marks)


def clear_stages(records: DataFrame, marks: DataFrame) -> DataFrame:
    """``records`` (``trace, stage`` and any values) without those of stale stages."""
    return records.join(marks.select("trace", "stage"), ["trace", "stage"], "left_anti")
