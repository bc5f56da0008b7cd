"""Elementwise physics of dual-trap signals."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def polyval(x: Column, coeffs: Column) -> Column:
    """Value of a polynomial given as an ascending coefficient array (Horner)."""
    return F.aggregate(F.reverse(coeffs), F.lit(0.0), lambda acc, c: acc * x + c)


def bead_signals(f1: Column, f2: Column, k1: Column, k2: Column,
                 signs: tuple[int, int] = (-1, 1)) -> Column:
    """Struct keq, bead displacements (nm), their difference and the differential force."""
    keq = F.try_divide(k1 * k2, k1 + k2)
    x1, x2 = F.try_divide(f1, k1), F.try_divide(f2, k2)
    dx = signs[1] * x2 + signs[0] * x1
    return F.struct(keq.alias("keq"), x1.alias("x1"), x2.alias("x2"), dx.alias("dx"),
                    (keq * dx).alias("diff_f"))


def molecular_extension(position: Column, dx_nm: Column, coeffs: Column | None = None) -> Column:
    separation = position if coeffs is None else polyval(position, coeffs)
    return separation - dx_nm / 1000


def channel_extensions(position: Column, f1: Column, f2: Column, k1: Column, k2: Column) -> Column:
    """Extension from each trap alone: both beads are taken to feel that trap's force."""
    soft = F.try_divide(F.lit(1.0), k1) + F.try_divide(F.lit(1.0), k2)
    return F.struct((position + f1 * soft / 1000).alias("d1"),
                    (position - f2 * soft / 1000).alias("d2"))


def um_to_bp(x: Column) -> Column:
    return x * 1000 / 0.34


def thermal_energy(kelvin: Column) -> Column:
    return 0.01380649 * kelvin


def chord(arc: Column, radius: float = 4.76) -> Column:
    return 2 * radius * F.sin(arc / (2 * radius))


def peeling_rate(units: str = "nm") -> float:
    """Angle of the spool per unit of unwrapped length."""
    turn = (1.65 * 2 * 3.141592653589793) / 145
    if units == "nm":
        return turn / (2 * 0.34)
    if units == "bp":
        return turn / 2
    raise ValueError("units must be nm or bp")


def peeling_term(x: Column, radius: float, units: str = "nm") -> Column:
    """Rigid-body contribution of unwrapped DNA around a spool of ``radius``."""
    return 2 * radius * F.cos(peeling_rate(units) * x)


def rms_end_to_end(contour: Column, lp: float) -> Column:
    return F.sqrt(2 * lp * contour * (1 - F.try_divide(F.lit(float(lp)), contour) * (1 - F.exp(-contour / lp))))


def fine_index(i: Column, factor: int) -> Column:
    """Position in the input of a decimated sample."""
    return i * factor + factor


def coarse_index(i: Column, factor: int) -> Column:
    return (F.floor(i / factor) - factor).cast("bigint")


def decimation_factor(rate: float, target: float, exact: bool = False) -> int:
    """Integer decimation factor; truncated, or checked to hit the rate when ``exact``."""
    if not exact:
        return int(rate / target)
    factor = round(rate / target)
    if factor < 1 or abs(rate / factor - target) > 1e-6 * target:
        raise ValueError(f"{rate} Hz is not an integer multiple of {target} Hz")
    return factor


def power_gain(p_in: Column, p_out: Column, in_db: bool = False) -> Column:
    return p_out - p_in if in_db else 10 * F.log10(F.try_divide(p_out, p_in))


def outside(value: Column, lo: float, hi: float) -> Column:
    return ~((value > lo) & (value < hi))


def box(d: Column, f: Column, d_range: Sequence[float] | None,
        f_range: Sequence[float] | None) -> Column:
    """Open rectangle in the distance-force plane; a missing range is unbounded."""
    cond = F.lit(True)
    for c, r in ((d, d_range), (f, f_range)):
        if r is not None:
            cond = cond & (c > float(r[0])) & (c < float(r[1]))
    return cond
