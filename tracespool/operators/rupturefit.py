"""Maximum-likelihood kinetics from rupture forces.

With handles in series, 1 / loading rate = (1/keq + 1/k_handles(F)) / v, so the hazard
integral of a trace splits into two integrals that do not depend on the trace.  They are
tabulated per candidate parameter set and linear between the points of the grid, so their sum over
all rows needs only a few sums per cell of the grid, which Spark takes once.  Rates of the Bell model are
sums over rows as well; those of the other model take one pass over the forces per block of
candidates.  The block then zooms in on the best.
"""
from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.functions import wlc
from tracespool.functions.kinetics import KB
from tracespool.plans import layout


def _rate(force, theta, kind, kelvin, nu=0.5):
    kt = KB * kelvin
    k0, xd = math.exp(theta[0]), theta[1]
    if kind == "bell":
        return k0 * np.exp(force * xd / kt)
    z = np.maximum(1 - nu * force * xd / (theta[2] * kt), 1e-12)
    return k0 * z ** (2 - 1 / nu) * np.exp(theta[2] * (1 - z ** (1 / nu)))


def fit_rupture_forces(rows: DataFrame, speed: float, model: tuple, kind: str = "bell", kelvin: float = 298.15,
                       grid_points: int = 10000, per_axis: int = 9, tol: float = 1e-7, max_rounds: int = 60) -> DataFrame:
    """``condition, k0, x_dagger[, dg], se_*, log_likelihood, events`` per condition.

    ``rows`` is ``condition, force, keq``.  Standard errors come from the curvature of the
    log likelihood in (ln k0, x_dagger, dg).
    """
    spark = rows.sparkSession
    data = layout.settle(rows.select("condition", "force", "keq").where("force > 0 and keq > 0"))
    # conditions are experimental settings: a short list
    stats = data.groupBy("condition").agg(F.avg("force"), F.stddev_pop("force"), F.max("force"), F.avg("keq"),
                                          F.count(F.lit(1))).collect()
    top = max(s[3] for s in stats)
    grid = np.linspace(0.0, top * 1.0001, grid_points)
    safe = np.maximum(grid, 1e-6)
    slope = sum(lc * wlc._eps(safe, lp, rest[0] if rest else None)[1] for lp, lc, *rest in model)  # um / pN
    compliance = slope  # 1 / k_handles in the unit of the extension
    kt = KB * kelvin
    centre, width = {}, {}
    for cond, mean, sd, high, keq, _ in stats:
        xd = math.pi / math.sqrt(6) * kt / max(sd, 1e-3)
        load = speed / (1 / keq + np.interp(mean, grid, compliance))
        theta = [math.log(max(load * xd / kt, 1e-300)) - mean * xd / kt, xd]
        span = [4.0, 0.8 * xd]
        if kind == "CHS":
            theta.append(2 * 0.5 * high * xd / kt)
            span.append(0.45 * theta[2])
        centre[cond], width[cond] = np.array(theta), np.array(span)

    step = float(grid[1])
    kind_of = data.schema["condition"].dataType.simpleString()

    def weigh(batches):
        """Sums of the rows in each cell of the grid; integrals are linear between its points."""
        total: dict = {}
        for pdf in batches:
            for cond, part in pdf.groupby("condition"):
                f, soft = part["force"].to_numpy(dtype=float), 1 / part["keq"].to_numpy(dtype=float)
                cell = np.clip((f / step).astype(np.int64), 0, grid_points - 2)
                share = f / step - cell
                load = np.log((soft + np.interp(f, grid, compliance)) / speed)
                sums = [np.bincount(cell, w, grid_points) for w in (np.ones(len(f)), share, soft, soft * share, load, f)]
                total[cond] = total.get(cond, 0) + np.array(sums)
        for cond, sums in total.items():
            at = np.flatnonzero(sums[0])
            yield pd.DataFrame({"condition": cond, "cell": at, **{f"w{k}": w[at] for k, w in enumerate(sums)}})

    fields = ", ".join(f"w{k} double" for k in range(6))
    cells = data.mapInPandas(weigh, f"condition {kind_of}, cell bigint, {fields}").groupBy("condition", "cell").agg(
        *[F.sum(f"w{k}").alias(f"w{k}") for k in range(6)]).orderBy("condition", "cell").toPandas()
    weights = {cond: part.drop(columns="condition").to_numpy(dtype=float).T for cond, part in cells.groupby("condition")}

    def log_rates(shapes: dict) -> dict:
        """Sum of ln(rate / k0) over the rows of each condition, for every candidate without its k0."""
        if kind == "bell":
            return {(c, t): t[0] / kt * weights[c][6].sum() for c, ts in shapes.items() for t in ts}
        lists = {c: sorted(ts) for c, ts in shapes.items()}

        def partial(batches):
            total: dict = {}
            for pdf in batches:
                for cond, part in pdf.groupby("condition"):
                    f = part["force"].to_numpy(dtype=float)
                    for c, t in enumerate(lists.get(cond, [])):
                        with np.errstate(all="ignore"):
                            ll = np.log(_rate(f, [0.0, *t], kind, kelvin))
                        total[cond, c] = total.get((cond, c), 0.0) + float(np.sum(ll))
            yield pd.DataFrame([(k[0], k[1], v) for k, v in total.items()], columns=["condition", "c", "ll"])

        sums = data.mapInPandas(partial, f"condition {kind_of}, c int, ll double").groupBy("condition", "c").agg(F.sum("ll"))
        return {(r[0], lists[r[0]][r[1]]): r[2] for r in sums.collect()}

    def evaluate(points: dict) -> dict:
        """Log likelihood of every candidate from the sums of the cells."""
        shapes = {c: {tuple(float(v) for v in t[1:]) for t in ts} for c, ts in points.items()}
        rates, out, h = log_rates(shapes), {}, np.diff(grid)
        for cond, thetas in points.items():
            at, (n, share, soft, soft_share, load, _) = weights[cond][0].astype(int), weights[cond][1:]
            area = {}
            for shape in shapes[cond]:
                with np.errstate(all="ignore"):
                    k = _rate(grid, [0.0, *shape], kind, kelvin)
                    a, b = (np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2 * h)]) for y in (k, k * compliance))
                    area[shape] = float(np.sum(a[at] * (soft - soft_share) + a[at + 1] * soft_share + b[at] * (n - share) + b[at + 1] * share))
            for c, theta in enumerate(thetas):
                shape = tuple(float(v) for v in theta[1:])
                with np.errstate(all="ignore"):
                    ll = n.sum() * theta[0] + rates[cond, shape] + load.sum() - math.exp(theta[0]) * area[shape] / speed
                out[cond, c] = float(ll) if ll == ll else -math.inf
        return out

    best = {}
    active = set(centre)
    for _ in range(max_rounds):
        if not active:
            break
        axes = np.linspace(-1, 1, per_axis)
        blocks = {c: [t for t in (centre[c] + width[c] * np.array(p) for p in product(axes, repeat=len(centre[c])))
                      if t[1] > 0 and (kind == "bell" or t[2] > 0)] for c in active}
        values = evaluate(blocks)
        for c in list(active):
            pick = max(range(len(blocks[c])), key=lambda q: values.get((c, q), -math.inf))
            moved = np.abs(blocks[c][pick] - centre[c]) / width[c]
            centre[c], best[c] = blocks[c][pick], values[c, pick]
            width[c] = np.where(moved > 1 - 1e-9, width[c], width[c] * 0.5)  # at the border: move, do not shrink
            if np.all(width[c] < tol * np.maximum(1.0, np.abs(centre[c]))):
                active.discard(c)
    out = []
    for cond, *_, events in stats:
        theta, p = centre[cond], len(centre[cond])
        h = 1e-3 * np.maximum(0.1, np.abs(theta))
        shifts = [np.zeros(p)] + [s for i in range(p) for j in range(i, p) for s in (
            [h[i] * np.eye(p)[i], -h[i] * np.eye(p)[i]] if i == j else
            [a * h[i] * np.eye(p)[i] + b * h[j] * np.eye(p)[j] for a in (1, -1) for b in (1, -1)])]
        val = evaluate({cond: [theta + s for s in shifts]}) if len(stats) == 1 else evaluate(
            {c: [centre[c] + s for s in shifts] if c == cond else [centre[c]] for c in centre})
        ll = [val[cond, q] for q in range(len(shifts))]
        hess, q = np.zeros((p, p)), 1
        for i in range(p):
            for j in range(i, p):
                if i == j:
                    hess[i, i] = (ll[q] - 2 * ll[0] + ll[q + 1]) / h[i] ** 2
                    q += 2
                else:
                    hess[i, j] = hess[j, i] = (ll[q] - ll[q + 1] - ll[q + 2] + ll[q + 3]) / (4 * h[i] * h[j])
                    q += 4
        cov = np.linalg.pinv(-hess)
        se = np.sqrt(np.maximum(np.diag(cov), 0.0))
        row = {"condition": cond, "k0": math.exp(theta[0]), "x_dagger": float(theta[1]),
               "se_ln_k0": float(se[0]), "se_x_dagger": float(se[1]),
               "correlation": float(cov[0, 1] / (se[0] * se[1])) if se[0] * se[1] > 0 else None,
               "log_likelihood": float(best[cond]), "events": int(events)}
        if kind == "CHS":
            row |= {"dg": float(theta[2]), "se_dg": float(se[2])}
        out.append(row)
    return spark.createDataFrame(pd.DataFrame(out))
