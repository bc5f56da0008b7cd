"""Worm-like-chain expressions (Marko-Siggia and Odijk), as Spark columns.

A component is ``(Lp, Lc)`` or ``(Lp, Lc, St)``; a model is a series of components
whose extensions add.  Units: pN, um (Lc, extension), nm (Lp), pN (St).
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KT = 4.11  # pN nm, fixed in the polymer model

Component = Sequence[float | None]


def relative_extension(force: Column, lp: float, st: float | None = None,
                       approx: str = "marko") -> Column:
    """Extension per unit contour length at ``force``.

    With u = 1/(1-l) the interpolation formula is the depressed cubic
    u^3 - 3 a u - 4 = 0, a = (4 f - 3) / 3, whose only root above 1 is taken.
    """
    f = force * F.lit(lp / KT)
    if approx == "odijk":
        if st is None:
            raise ValueError("the Odijk form needs a stretch modulus")
        return 1 - F.try_divide(F.lit(0.5), F.sqrt(f)) + force / F.lit(st)
    if approx != "marko":
        raise ValueError(f"unknown approximation {approx!r}")
    a = (4 * f - 3) / 3
    a3 = a * a * a
    w = F.cbrt(2 + F.sqrt(F.greatest(4 - a3, F.lit(0.0))))
    low = w + a / w
    root = F.sqrt(F.greatest(a, F.lit(0.0)))
    high = 2 * root * F.cos(F.acos(2 / F.greatest(a3, F.lit(4.0)) ** 0.5) / 3)
    u = F.when(a3 < 4, low).otherwise(high)
    ext = 1 - F.try_divide(F.lit(1.0), u)
    return ext if st is None else ext + force / F.lit(st)


def _parts(component: Component) -> tuple[float, float | None, float | None]:
    if len(component) not in (2, 3):
        raise ValueError("a component is (Lp, Lc) or (Lp, Lc, St)")
    lp, lc = component[0], component[1]
    return lp, lc, component[2] if len(component) == 3 else None


def extension(force: Column, *model: Component, approx: str = "marko") -> Column:
    """Distance of the whole model at ``force``."""
    total = None
    for component in model:
        lp, lc, st = _parts(component)
        kind = approx if st is not None else "marko"
        term = F.lit(float(lc)) * relative_extension(force, lp, st, kind)
        total = term if total is None else total + term
    if total is None:
        raise ValueError("empty model")
    return total


def contour_length(distance: Column, force: Column, *model: Component) -> Column:
    """Contour length of the one component whose Lc is None, at each sample."""
    unknown = [c for c in model if c[1] is None]
    if len(unknown) != 1:
        raise ValueError("exactly one component must have Lc=None")
    known = [c for c in model if c[1] is not None]
    lp, _, st = _parts(unknown[0])
    rest = distance - extension(force, *known) if known else distance
    return F.try_divide(rest, relative_extension(force, lp, st))  # NULL at zero force


# --- inverse model -----------------------------------------------------------------

def _eps(force: np.ndarray, lp: float, st: float | None) -> tuple[np.ndarray, np.ndarray]:
    f = force * lp / KT
    a = (4 * f - 3) / 3
    a3 = a ** 3
    w = np.cbrt(2 + np.sqrt(np.maximum(4 - a3, 0)))
    u = np.where(a3 < 4, w + a / w,
                 2 * np.sqrt(np.maximum(a, 0)) * np.cos(np.arccos(2 / np.sqrt(np.maximum(a3, 4))) / 3))
    value, slope = 1 - 1 / u, (lp / KT) / (0.5 * u ** 3 + 1)
    return (value, slope) if st is None else (value + force / st, slope + 1 / st)


def extension_at(force: np.ndarray, model: Sequence[Component]) -> np.ndarray:
    """Distance of the whole model at ``force`` (vectorised helper)."""
    total = np.zeros(force.shape)
    for component in model:
        lp, lc, st = _parts(component)
        total = total + float(lc) * _eps(force, lp, st)[0]
    return total


def force_at(distance: np.ndarray, model: Sequence[Component], f_min: float = 0.0,
             tol: float = 1e-8, max_doublings: int = 40, max_iter: int = 50) -> np.ndarray:
    """Force at which the model has the given extension (vectorised helper).

    Doubles an upper bracket, then takes Newton steps that fall back to bisection.
    Distances below the model at ``f_min`` give ``f_min``; unreachable ones give NaN.
    """
    x = np.asarray(distance, float)

    def curve(force):
        value = np.zeros_like(force)
        slope = np.zeros_like(force)
        for component in model:
            lp, lc, st = _parts(component)
            e, de = _eps(force, lp, st)
            value, slope = value + lc * e, slope + lc * de
        return value, slope

    lo = np.full(x.shape, f_min)
    hi = np.full(x.shape, max(f_min, 0.0) + 1.0)
    finite = np.isfinite(x)
    for _ in range(max_doublings):
        short = finite & (curve(hi)[0] < x)
        if not short.any():
            break
        hi = np.where(short, hi * 2, hi)
    reached = finite & (curve(hi)[0] >= x)
    below = finite & (x <= curve(lo)[0])
    guess = 0.5 * (lo + hi)
    for _ in range(max_iter):
        value, slope = curve(guess)
        error = value - x
        lo = np.where(error < 0, guess, lo)
        hi = np.where(error >= 0, guess, hi)
        step = guess - error / slope
        after = np.where((step > lo) & (step < hi), step, 0.5 * (lo + hi))
        change = np.nanmax(np.abs(after - guess), initial=0.0, where=reached & ~below)
        guess = after
        if change <= tol * 1e-2:
            break
    return np.where(below, f_min, np.where(reached, guess, np.nan))


def force_udf(*model: Component):
    """Arrow-batched UDF distance -> force for a fixed model."""
    comps = [tuple(c) for c in model]

    @F.pandas_udf("double")
    def invert(distance: pd.Series) -> pd.Series:
        out = force_at(distance.to_numpy(dtype=float, na_value=np.nan), comps)
        return pd.Series(out).where(np.isfinite(out), None)

    return invert


def force_udf_variable(model: Sequence[Component], variable: int = 0):
    """UDF (distance, contour length of one component) -> force."""
    comps = [tuple(c) for c in model]

    @F.pandas_udf("double")
    def invert(distance: pd.Series, contour: pd.Series) -> pd.Series:
        mine = list(comps)
        lp, _, *rest = comps[variable]
        mine[variable] = (lp, contour.to_numpy(dtype=float, na_value=np.nan), *rest)
        out = force_at(distance.to_numpy(dtype=float, na_value=np.nan), mine)
        return pd.Series(out).where(np.isfinite(out), None)

    return invert


def area_udf(model: Sequence[Component], grid: int):
    """UDF (lo, hi) -> area under the model by the trapezoid rule on ``grid`` even points; unreachable ones count nothing."""
    comps = [tuple(c) for c in model]
    lp, lc, *rest = comps[0]
    closed = len(comps) == 1 and not any(rest)
    part = np.arange(grid)
    weight = np.where((part == 0) | (part == grid - 1), 0.5, 1.0)  # end points count half

    def force(x: np.ndarray) -> np.ndarray:
        if not closed:
            return force_at(x, comps)
        ell = x / lc
        with np.errstate(divide="ignore", invalid="ignore"):
            value = (KT / lp) * (0.25 / ((1 - ell) * (1 - ell)) - 0.25 + ell)
        return np.where(ell <= 0, 0.0, np.where(ell < 1, value, np.nan))

    @F.pandas_udf("double")
    def under(lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(lo.to_numpy(dtype=float, na_value=np.nan), hi.to_numpy(dtype=float, na_value=np.nan)):
            h = (b - a) / (grid - 1)
            y = force(a + part * h)
            ok = np.isfinite(y)
            out.append(float((y[ok] * weight[ok] * h).sum()) if ok.any() else None)
        return pd.Series(out, dtype="object")

    return under


def force_single(distance: Column, lp: float, lc: float) -> Column:
    """Closed form of the inverse for one inextensible component."""
    ell = distance / F.lit(lc)
    value = F.lit(KT / lp) * (F.try_divide(F.lit(0.25), (1 - ell) * (1 - ell)) - 0.25 + ell)
    return F.when(ell <= 0, F.lit(0.0)).when(ell < 1, value)
