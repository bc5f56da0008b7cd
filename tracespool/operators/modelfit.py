"""Least-squares fits of polymer models, per trace or shared by many traces.

Every round Spark sums the normal equations of all fits in one pass; damped steps are
solved on the small table of sums.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.functions import physics, wlc
from tracespool.plans import layout

Bounds = Sequence[Sequence[tuple[float, float]]]


def _check(guesses, fixed, bounds) -> None:
    if len(fixed) != len(guesses) or any(len(a) != len(b) for a, b in zip(fixed, guesses)):
        raise ValueError("the fixed mask must have the shape of the guesses")
    if bounds is None:
        return
    if len(bounds) != len(guesses):
        raise ValueError("bounds must have one entry per component")
    for c, (g, b) in enumerate(zip(guesses, bounds)):
        if len(g) != len(b):
            raise ValueError(f"component {c}: bounds and guesses differ in length")
        for value, (lo, hi) in zip(g, b):
            if not 0 < lo < hi:
                raise ValueError(f"component {c}: need 0 < lower < upper, got ({lo}, {hi})")
            if not lo <= value <= hi:
                raise ValueError(f"component {c}: guess {value} is outside ({lo}, {hi})")


def fit_model(samples: DataFrame, guesses: Sequence[Sequence[float]], fixed: Sequence[Sequence[bool]] | None = None,
              bounds: Bounds | None = None, box: tuple | None = None, key: str = "trace", distance_offset: bool = False,
              force_offset: bool = False, offset_bounds: tuple[float, float] = (-np.inf, np.inf), invert: bool = True,
              d: str = "d", f: str = "f", max_rounds: int = 60, tol: float = 1e-9) -> DataFrame:
    """``<key>, components, distance_offset, force_offset, rmse, points`` per value of ``key``.

    ``invert`` fits force against distance, otherwise distance against force.  With another
    ``key`` than the trace, all traces of a key share the parameters.  Bounds clip steps.
    """
    fixed = fixed or [[False] * len(g) for g in guesses]
    _check(guesses, fixed, bounds)
    shape = [len(g) for g in guesses]
    free = [not b for row in fixed for b in row] + [distance_offset, force_offset]
    start = np.array([v for g in guesses for v in g] + [0.0, 0.0], float)
    lo, hi = np.full(len(start), 1e-9), np.full(len(start), np.inf)
    lo[-2:], hi[-2:] = offset_bounds
    if bounds is not None:
        flat = [b for row in bounds for b in row]
        lo[:-2], hi[:-2] = [b[0] for b in flat], [b[1] for b in flat]
    pos = np.flatnonzero(free)
    p = len(pos)
    if p == 0:
        raise ValueError("no free parameter")
    rows = samples.where(physics.box(F.col(d), F.col(f), *box)) if box else samples
    rows = layout.settle(rows.select(F.col(key).alias("key"), F.col(d).alias("d"), F.col(f).alias("f")).where(
        F.col("d").isNotNull() & F.col("f").isNotNull()))
    kind = samples.schema[key].dataType.simpleString()

    def residual(theta, dist, force):
        model, at = [], 0
        for size in shape:
            model.append(tuple(theta[at:at + size]))
            at += size
        doff, foff = theta[-2:]
        if invert:
            return force - (wlc.force_at(dist - doff, model) + foff)
        shifted = force - foff
        value = sum(lc * wlc._eps(shifted, lp, rest[0] if rest else None)[0] for lp, lc, *rest in model)
        return dist - (value + doff)

    def partial(batches):
        """Sums per key, over all keys of a batch at once: each row brings the parameters of its key."""
        for pdf in batches:
            code, keys = pd.factorize(pdf["key"])
            code, size = code[code >= 0], len(keys)
            pdf = pdf[pdf["key"].notna()]
            theta = np.repeat(start[:, None], len(pdf), axis=1)
            for c, q in enumerate(pos):
                theta[q] = pdf[f"p{c}"].to_numpy(dtype=float)
            dist, force = pdf["d"].to_numpy(dtype=float), pdf["f"].to_numpy(dtype=float)
            r = residual(theta, dist, force)
            jac = np.empty((p, len(r)))
            for c, q in enumerate(pos):
                step = 1e-6 * np.maximum(np.abs(theta[q]), 1e-3)
                up, down = theta.copy(), theta.copy()
                up[q] += step
                down[q] -= step
                jac[c] = (residual(up, dist, force) - residual(down, dist, force)) / (2 * step)
            ok = np.isfinite(r) & np.isfinite(jac).all(axis=0)
            code, r, jac = code[ok], r[ok], jac[:, ok]

            def total(values):
                return np.bincount(code, values, size)

            g = np.array([total(jac[a] * jac[b]) for a in range(p) for b in range(p)]).T
            yield pd.DataFrame({"key": keys, "sse": total(r * r), "m": np.bincount(code, minlength=size), "g": g.tolist(),
                                "b": np.array([total(jac[a] * r) for a in range(p)]).T.tolist()})

    def advance(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                try_, best = np.asarray(r["theta"], float), np.asarray(r["best"], float)
                lam, done = r["lam"], False
                # rows the model cannot reach are left out; a step that loses rows is not an improvement
                if r["m"] >= r["best_m"] and r["sse"] < r["best_sse"] or r["best_m"] == 0:
                    gain = r["best_sse"] - r["sse"]
                    done = r["best_m"] > 0 and gain <= tol * max(r["sse"], 1e-300)
                    best, r["best_sse"], r["best_m"] = try_, r["sse"], r["m"]
                    r["best_g"], r["best_b"] = list(r["g"]), list(r["b"])
                    lam = max(lam / 10, 1e-12)
                else:
                    lam *= 10
                g, b = np.reshape(r["best_g"], (p, p)), np.asarray(r["best_b"], float)
                move = np.linalg.lstsq(g + lam * np.diag(np.maximum(np.diag(g), 1e-30)), -b, rcond=None)[0]
                nxt = best.copy()
                nxt[pos] = np.clip(nxt[pos] + move, lo[pos], hi[pos])
                done = done or lam > 1e10 or np.allclose(nxt, best, rtol=1e-8, atol=1e-12)
                out.append((r["key"], nxt.tolist(), best.tolist(), float(r["best_sse"]), int(r["best_m"]),
                            list(r["best_g"]), list(r["best_b"]), float(lam), not done))
            yield pd.DataFrame(out, columns=["key", "theta", "best", "best_sse", "best_m", "best_g", "best_b", "lam", "on"])

    schema = (f"key {kind}, theta array<double>, best array<double>, best_sse double, best_m bigint, "
              "best_g array<double>, best_b array<double>, lam double, on boolean")
    theta0 = F.array(*[F.lit(float(v)) for v in start])
    none = F.array().cast("array<double>")
    state = layout.settle(rows.select("key").distinct().select(
        "key", theta0.alias("theta"), theta0.alias("best"), F.lit(float("inf")).alias("best_sse"), F.lit(0).cast("bigint").alias("best_m"),
        none.alias("best_g"), none.alias("best_b"), F.lit(1e-3).alias("lam"), F.lit(True).alias("on")))
    for _ in range(max_rounds):
        live = state.where("on")
        # only free parameters travel with the rows, as plain numbers
        joined = layout.salted(rows, live.select("key", *[F.col("theta")[int(q)].alias(f"p{c}") for c, q in enumerate(pos)]), ["key"])
        sums = joined.mapInPandas(partial, f"key {kind}, sse double, m bigint, g array<double>, b array<double>")
        total = sums.groupBy("key").agg(
            F.sum("sse").alias("sse"), F.sum("m").alias("m"),
            F.array(*[F.sum(F.col("g")[k]) for k in range(p * p)]).alias("g"), F.array(*[F.sum(F.col("b")[k]) for k in range(p)]).alias("b"))
        moved = live.join(total, "key").mapInPandas(advance, schema)
        state = layout.settle(state.where("not on").unionByName(moved))
        if state.where("on").isEmpty():
            break
    sizes = np.cumsum([0, *shape])
    comps = F.array(*[F.slice("best", int(a) + 1, int(b - a)) for a, b in zip(sizes[:-1], sizes[1:])])
    return state.select(F.col("key").alias(key), comps.alias("components"), F.element_at("best", -2).alias("distance_offset"),
                        F.element_at("best", -1).alias("force_offset"), F.sqrt(F.try_divide("best_sse", "best_m")).alias("rmse"),
                        F.col("best_m").alias("points"))


def fitted_contour_length(samples: DataFrame, model: Sequence[Sequence[float]], variable: int = 0,
                          lc_bounds: tuple[float, float] = (0.001, 2.0), d: str = "d", f: str = "f", **options) -> DataFrame:
    """Per-point contour length after a fit of one contour length and a force offset per trace."""
    fixed = [[True] * len(c) for c in model]
    fixed[variable][1] = False
    wide = [[(min(v / 2, v * 0.999), v * 2) for v in c] for c in model]
    wide[variable][1] = lc_bounds
    fits = fit_model(samples, model, fixed, wide, force_offset=True, d=d, f=f, **options)
    sizes = samples.groupBy("trace").agg(F.max("n").alias("n"))
    rows = layout.spread(samples, layout.settle(fits.select("trace", "force_offset").join(sizes, "trace")))
    open_ = [(c[0], None, *c[2:]) if k == variable else tuple(c) for k, c in enumerate(model)]
    return rows.withColumn("lc", wlc.contour_length(F.col(d), F.col(f) - F.col("force_offset"), *open_))
