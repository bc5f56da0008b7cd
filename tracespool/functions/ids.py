"""Identifier expressions.

Ramp ids read ``date_set_mol_fec[S|R]nn``, baselines ``date_set_fecnn`` and motor
recordings ``..._dctnn`` or ``..._spmnn``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(name: Column) -> Column:
    """Strip folder, acquisition prefix and file suffix from a recording name."""
    name = F.regexp_replace(name, r"^.*?FD Curve ", "")
    return F.replace(F.replace(name, F.lit(".h5"), F.lit("")), F.lit("rawdat/"), F.lit(""))


def _part(name: Column, k: int) -> Column:
    return F.get(F.split(name, "_"), F.lit(k))


def parse_ramp(name: Column) -> Column:
    """Struct of the fields of a ramp id: the letter after ``fec`` is the curve type."""
    trace = clean(name)
    last = _part(trace, 3)
    return F.struct(
        trace.alias("trace"), F.concat(F.lit("20"), _part(trace, 0)).alias("date"),
        _part(trace, 1).cast("int").alias("bead_set"), _part(trace, 2).alias("mol_id"),
        F.substring(last, 4, 1).alias("curve_type"),
        F.regexp_extract(trace, r"^[^_]*_[^_]*_[^_]*_.{4}(.*)$", 1).alias("curve_number"))


def parse_motor(name: Column) -> Column:
    """Struct of the fields of a motor id: a token of 6 (5) letters has a type of 4 (3)."""
    trace = clean(name)
    token = F.substring_index(trace, "_", -1)
    width = F.when(F.length(token) == 6, 4).when(F.length(token) == 5, 3)
    return F.struct(
        trace.alias("trace"), F.concat(F.lit("20"), _part(trace, 0)).alias("date"),
        _part(trace, 1).cast("int").alias("bead_set"), _part(trace, 2).alias("mol_id"),
        F.when(width.isNotNull(), token.substr(F.lit(1), width)).alias("curve_type"),
        F.when(width.isNotNull(), token.substr(width + 1, F.lit(2))).alias("curve_number"))


def _baseline(trace: Column, number: Column) -> Column:
    return F.concat(_part(trace, 0), F.lit("_"), _part(trace, 1), F.lit("_fec"), number)


def ramp_baseline(trace: Column) -> Column:
    return _baseline(trace, F.lit("00"))


def motor_baseline(trace: Column) -> Column:
    """00 and 01 use baseline 01, 02 and 03 use baseline 02, anything else NULL."""
    number = F.substring(trace, -2, 2)
    pick = F.when(number.isin("00", "01"), "01").when(number.isin("02", "03"), "02")
    return _baseline(trace, pick)


def drift_baseline(trace: Column) -> Column:
    """Baseline of a passive recording, by its own number."""
    number = F.regexp_extract(trace, r"(?:spm|dct)(01|02)$", 1)
    return _baseline(trace, F.when(number != "", number))


def set_baselines(trace: Column) -> Column:
    numbers = F.array(*[F.lit(k) for k in ("01", "02", "03")])
    return F.transform(numbers, lambda k: _baseline(trace, k))


def trace_base(trace: Column) -> Column:
    """Everything before the last underscore: the molecule set."""
    return F.regexp_extract(trace, r"^(.*)_[^_]*$", 1)


def run_type(trace: Column) -> Column:
    token = F.regexp_extract(trace, r"(fecS\d+|dct\d+|spm\d+)", 1)
    return F.when(token != "", token).otherwise(trace)
