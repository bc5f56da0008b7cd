"""Polynomials with Huber loss and a scale fitted with them, by sums per trace."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.plans import layout

FLOOR = 10 * float(np.finfo(float).eps)  #: least scale


class Moments:
    """Sums of a round: powers of x and products with y inside, signs and weighted powers outside (named by `moments`)."""

    def __init__(self, sums: np.ndarray, m: int):
        self.m, self.at = m, 0
        self.sums = np.asarray(sums, float)
        self.inner, self.sign, self.heavy = self._grid(), self._take(m), self._grid()
        self.by, self.heavy_by = self._take(m), self._take(m)
        self.yy, self.out, self.far = self._take(3)

    def _take(self, k: int) -> np.ndarray:
        self.at += k
        return self.sums[self.at - k:self.at]

    def _grid(self) -> np.ndarray:
        return self._take(2 * self.m - 1)[np.add.outer(np.arange(self.m), np.arange(self.m))]

    def inside(self, w: np.ndarray) -> float:
        return max(float(self.yy - 2 * w @ self.by + w @ self.inner @ w), 0.0)


def moments(m: int) -> list:
    """Aggregates in the order in which `Moments` reads them, of columns ``_x, _y, _r`` (residual) and ``_in``."""
    power = [F.lit(1.0)]
    for _ in range(2 * m - 2):
        power.append(power[-1] * F.col("_x"))
    near = lambda e: F.sum(F.when(F.col("_in"), e).otherwise(0.0))
    away = lambda e: F.sum(F.when(~F.col("_in"), e).otherwise(0.0))
    size, y = F.abs("_r"), F.col("_y")
    return ([near(p) for p in power] + [away(F.signum("_r") * p) for p in power[:m]] + [away(p / size) for p in power]
            + [near(p * y) for p in power[:m]] + [away(p * y / size) for p in power[:m]] + [near(y * y), away(F.lit(1.0)), away(size)])


def joint_minimum(s: Moments, n: float, scale: float, epsilon: float, ridge: float) -> tuple[np.ndarray, float]:
    """Coefficients and scale that minimise the loss if the present inner and outer points stay what they are."""
    free = np.diag([0.0, *[ridge] * (s.m - 1)])
    room = n - s.out * epsilon**2
    for _ in range(50):  # only the ridge ties the coefficients to the scale in a nonlinear way
        w = np.linalg.solve(s.inner + scale * free, s.by + scale * epsilon * s.sign)
        new = float(np.sqrt(s.inside(w) / room)) if room > 0 else scale
        if abs(new - scale) <= 1e-14 * max(scale, new):
            break
        scale = new
    return w, scale


def _round(r, m: int, epsilon: float, ridge: float, tol: float) -> tuple:
    """The next state of a trace: (now, scale, back, back_scale, loss, rounds, state)."""
    s, penalty = Moments(r.sums, m), np.diag([0.0, *[ridge] * (m - 1)])
    if r.state == "first":  # least squares, with the scale of its residuals
        if np.linalg.matrix_rank(s.inner) < m:
            return None, None, None, None, None, 0, "none"
        w = np.linalg.solve(s.inner, s.by)
        left = s.inside(w) / r.n
        flat = left <= 1e-24 * max(s.yy / r.n, FLOOR) or r.n <= m
        return list(w), 0.0 if flat else max(float(np.sqrt(left)), FLOOR), None, None, None, 0, "done" if flat else "on"
    w, scale = np.asarray(r.now, float), r.scale
    loss = float(r.n * scale + s.inside(w) / scale + 2 * epsilon * s.far - scale * epsilon**2 * s.out + w @ penalty @ w)
    if r.back is not None and not loss <= r.loss + 1e-13 * abs(r.loss):
        return list(r.back), r.back_scale, None, None, None, r.rounds + 1, "on"  # the bold step failed
    # steps that always lower the loss, in turn: weights 1 / scale inside and epsilon / |residual| outside; then the scale
    if r.rounds % 2:
        back, back_scale = w, max(float(np.sqrt((s.inside(w) + s.out * (epsilon * scale) ** 2) / r.n)), FLOOR)
    else:
        back, back_scale = np.linalg.solve(s.inner + scale * (epsilon * s.heavy + penalty), s.by + scale * epsilon * s.heavy_by), scale
    try:
        new, new_scale = joint_minimum(s, r.n, scale, epsilon, ridge)
    except np.linalg.LinAlgError:
        new, new_scale = back, back_scale
    if not (np.isfinite(new).all() and new_scale > FLOOR):
        new, new_scale = back, back_scale
    move = max(float(np.abs(new - w).max()) / max(1.0, float(np.abs(w).max())), abs(new_scale - scale) / scale)
    return list(new), new_scale, list(back), back_scale, loss, r.rounds + 1, "done" if move < tol else "on"


def huber_polynomial(samples: DataFrame, x: str, y: str, degree: int = 1, epsilon: float = 1.35, ridge: float = 1e-4,
                     max_iter: int = 100, tol: float = 1e-10) -> DataFrame:
    """``trace, coeffs, scale, points, rounds, converged``; ``coeffs`` has the highest power first.

    Minimises the sum of ``s + H(r / s) s`` over coefficients and scale ``s`` (H(z) is z squared up to ``epsilon``, then linear),
    plus ``ridge`` times the squared coefficients without the constant.

    A round is one aggregation per trace: moments of the points inside and outside ``epsilon * s``, and the loss.  Taking
    that split as final gives its minimum at once; where the loss does not fall by it, a reweighted step from the last good
    point is taken instead, which always lowers it.  All traces advance together, and those that are done drop out.

    Points with a NULL or NaN are left out.  Fewer different ``x`` than coefficients give NULL; a curve that meets all points has
    the scale 0.  ``converged`` is false where ``max_iter`` rounds were not enough, or nothing was fitted.
    """
    m = degree + 1
    kind = samples.schema["trace"].dataType.simpleString()
    ok = layout.settle(samples.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))).select(
        "trace", "i", "chunk", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")))
    changing = "now array<double>, scale double, back array<double>, back_scale double, loss double, rounds long, state string"
    schema = f"trace {kind}, n double, _last long, {changing}"

    def advance(batches):
        for pdf in batches:
            rows = [(r.trace, r.n, r.last, *_round(r, m, epsilon, ridge, tol)) for r in pdf.rename(columns={"_last": "last"}).itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    state = layout.settle(ok.groupBy("trace").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("chunk").alias("_last")).select(
        "trace", "n", "_last", F.array(*[F.lit(0.0)] * m).alias("now"), F.lit(1.0).alias("scale"), F.expr("cast(null as array<double>) back"),
        F.expr("cast(null as double) back_scale"), F.expr("cast(null as double) loss"), F.lit(0).cast("bigint").alias("rounds"), F.lit("first").alias("state")))
    done = None
    for _ in range(max_iter + 1):
        rows = layout.spread(ok, state.select("trace", "_last", "now", "scale", (F.col("state") == "first").alias("_all")))
        curve = F.col("now")[degree]
        for k in reversed(range(degree)):
            curve = curve * F.col("_x") + F.col("now")[k]
        rows = rows.withColumn("_r", F.col("_y") - curve).withColumn("_in", F.col("_all") | (F.abs("_r") <= epsilon * F.col("scale")))
        sums = rows.groupBy("trace").agg(F.array(*moments(m)).alias("sums"))
        state = layout.settle(state.join(sums, "trace").mapInPandas(advance, schema))
        ended = state.where("state <> 'on'")
        done = ended if done is None else done.unionByName(ended)
        state = state.where("state = 'on'")
        if state.isEmpty():
            break
    return layout.settle(done.unionByName(state).select(
        "trace", F.reverse("now").alias("coeffs"), "scale", F.col("n").cast("bigint").alias("points"), "rounds", (F.col("state") == "done").alias("converged")))
