"""Smoothing and decimation of traces."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.plans import layout
from tracespool.plans.layout import whole_groups


def too_short(df: DataFrame, least: int) -> DataFrame:
    """``trace, n, least`` of the traces that a filter needing ``least`` samples gives no rows for."""
    return (df.where(f"n < {least}").groupBy("trace").agg(F.max("n").alias("n"))
            .withColumn("least", F.lit(least).cast("long")))


def boxcar_least(factor: int) -> int:
    """Fewest samples that `boxcar_decimate` and `boxcar_smooth` work on."""
    return 3 * factor + 1


def boxcar_decimate(df: DataFrame, cols: Sequence[str], factor: int,
                    rows: int | None = None) -> DataFrame:
    """Forward-backward moving average of width ``factor``, keeping every factor-th sample.

    Averaging twice is one triangular kernel, and a kept sample sits on a multiple of
    ``factor``, so each block of ``factor`` samples contributes to exactly two outputs.
    Two hash aggregates give the result: no window, no sort, no per-trace task.
    ``factor`` samples are dropped at both ends; traces of at most three widths give no
    rows and are listed by ``too_short(df, boxcar_least(factor))``.  ``src`` is the position of the output sample in the input trace.
    """
    n = factor
    block = F.expr(f"i div {n}L")
    phase = F.expr(f"i % {n}")
    near = [F.sum(F.col(c) * (n - phase)).alias(f"_a{k}") for k, c in enumerate(cols)]
    far = [F.sum(F.col(c) * phase).alias(f"_b{k}") for k, c in enumerate(cols)]
    blocks = (df.where(f"n > {3 * n}").groupBy("trace", "n", block.alias("m"))
              .agg(*near, *far))
    own = F.struct(F.col("m").alias("m"), *[F.col(f"_a{k}").alias(f"s{k}") for k in range(len(cols))])
    nxt = F.struct((F.col("m") + 1).alias("m"),
                   *[F.col(f"_b{k}").alias(f"s{k}") for k in range(len(cols))])
    parts = blocks.select("trace", "n", F.explode(F.array(own, nxt)).alias("p")).select("trace", "n", "p.*")
    merged = parts.groupBy("trace", "n", "m").agg(
        *[(F.sum(f"s{k}") / float(n * n)).alias(c) for k, c in enumerate(cols)])
    kept = merged.where(f"m >= 1 and m * {n} < n - {n}")
    return layout.with_chunk(kept.select(
        "trace", (F.col("m") - 1).alias("i"), F.expr(f"(n - 1) div {n}L - 1").alias("n"),
        (F.col("m") * n).alias("src"), *cols), rows)


def mirror_ends(df: DataFrame, cols: Sequence[str], pad: int) -> DataFrame:
    """Extend each trace by ``pad`` samples of its odd reflection at both ends.

    Added rows have ``i`` below 0 or at least ``n``.
    """
    ends = df.where(f"i <= {pad} or i >= n - 1 - {pad}")
    first = [F.max(F.when(F.col("i") == 0, F.col(c))).alias(f"_f{k}") for k, c in enumerate(cols)]
    last = [F.max(F.when(F.col("i") == F.col("n") - 1, F.col(c))).alias(f"_l{k}") for k, c in enumerate(cols)]
    edge = layout.settle(ends.groupBy("trace").agg(F.max("n").alias("n"), *first, *last))
    near = layout.spread(ends.select("trace", "n", "i", "chunk", *cols), edge)

    def side(cond: str, pos: str, tag: str) -> DataFrame:
        return near.where(cond).select("trace", "n", F.expr(pos).alias("i"), "chunk", *[
            (2 * F.col(f"_{tag}{k}") - F.col(c)).alias(c) for k, c in enumerate(cols)])

    left = side(f"i between 1 and {pad}", "-i", "f")
    right = side(f"i between n - 1 - {pad} and n - 2", "2 * (n - 1) - i", "l")
    body = df.select("trace", "n", "i", "chunk", *cols)
    return body.unionByName(left).unionByName(right)


def triangle(df: DataFrame, cols: Sequence[str], width: int, rows: int | None = None) -> DataFrame:
    """Moving average of ``width`` taken twice, as one kernel; NULL where the window leaves the trace."""
    # whole weights, divided at the end: sums of decimals that meet a limit exactly still do
    kernel = F.array(*[F.lit(float(width - abs(k))) for k in range(1 - width, width)])
    out = layout.sliding(df, width - 1, width - 1, {
        f"_s{k}": (lambda w, f, c=c: F.aggregate(F.zip_with(
            F.collect_list(c).over(f), kernel, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / F.lit(float(width ** 2)))
        for k, c in enumerate(cols)}, rows)
    return out.withColumns({c: F.col(f"_s{k}") for k, c in enumerate(cols)}).drop(
        *[f"_s{k}" for k in range(len(cols))])


def boxcar_smooth(df: DataFrame, cols: Sequence[str], width: int, rows: int | None = None) -> DataFrame:
    """Forward-backward moving average at full rate, with odd reflection at the ends."""
    ext = mirror_ends(df.where(f"n > {3 * width}"), cols, width)
    return triangle(ext, cols, width, rows).where("i >= 0 and i < n")


def savgol_kernels(width: int, order: int, deriv: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centre weights, and weights of the first ``width // 2`` outputs on the first window."""
    half = width // 2
    grid = np.vander(np.arange(width) - half, order + 1, increasing=True)
    solve = np.linalg.pinv(grid)  # polynomial coefficients from window values

    def at(pos: float) -> np.ndarray:
        row = [math.prod(range(k - deriv + 1, k + 1)) * pos ** (k - deriv) if k >= deriv else 0.0
               for k in range(order + 1)]
        return np.asarray(row) @ solve

    return at(0.0), np.array([at(j - half) for j in range(half)])


def savgol(df: DataFrame, col: str, width: int, order: int = 1, deriv: int = 0,
           decimate: bool = False, out: str = "smooth", rows: int | None = None) -> DataFrame:
    """Savitzky-Golay smoothing; ends are evaluated from a fit to the end window."""
    if width % 2 == 0 or width <= order:
        raise ValueError("width must be odd and larger than the polynomial order")
    half = width // 2
    centre, edge = savgol_kernels(width, order, deriv)
    kernel = F.array(*[F.lit(float(c)) for c in centre])
    base = df.where(f"n >= {width}")
    mid = layout.sliding(base, half, half, {out: lambda w, f: F.aggregate(F.zip_with(
        F.collect_list(col).over(f), kernel, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)}, rows)
    mid = mid.where(f"i >= {half} and i < n - {half}")
    if decimate:
        kept = mid.where(f"i >= {width} and i < n - {width} and i % {width} = 0")
        return layout.with_chunk(kept.withColumn("src", F.col("i")).withColumn("i", F.expr(f"i div {width}L - 1"))
                                 .withColumn("n", F.expr(f"(n - 1) div {width}L - 1")), rows)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in edge])
    sign = -1.0 if deriv % 2 else 1.0

    def ends(dist: str, target: str, flip: float) -> DataFrame:
        near = base.where(f"{dist} < {width}").withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(half - 1))))
        w = F.get(F.get(table, F.col("_j")), F.expr(f"cast({dist} as int)"))
        return near.groupBy("trace", "n", F.expr(target).alias("i")).agg((F.sum(w * F.col(col)) * flip).alias(out))

    tails = ends("i", "cast(_j as bigint)", 1.0).unionByName(ends("(n - 1 - i)", "n - 1 - _j", sign))
    fixed = layout.with_chunk(tails, rows).join(base.drop("n", "chunk"), ["trace", "i"])
    return mid.unionByName(fixed.select(*mid.columns))


def median_filter(df: DataFrame, col: str, width: int, out: str = "smooth", rows: int | None = None) -> DataFrame:
    """Running median of an odd window, with zeros beyond the ends."""
    half = width // 2

    def middle(w, f):
        seen = F.collect_list(col).over(f)
        full = F.concat(seen, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(seen)))
        return F.get(F.array_sort(full), F.lit(half))

    return layout.sliding(df, half, half, {out: middle}, rows)


def _once(value, use):
    """``use(value)`` with ``value`` computed once: the planner copies plain columns into each place that names them."""
    return F.transform(F.array(value), use)[0]


def _median(values):
    """Median of an array column."""
    def middle(s):
        lo, hi = F.floor((F.size(s) - 1) / 2).cast("int"), F.floor(F.size(s) / 2).cast("int")
        return (F.get(s, lo) + F.get(s, hi)) / 2

    return _once(F.array_sort(values), middle)


def _deviation(values, middle):
    """Median distance of the values of an array column from ``middle``."""
    return _once(middle, lambda m: _median(F.transform(values, lambda v: F.abs(v - m))))


def hampel(df: DataFrame, col: str, width: int, n_sigma: float = 3.0, out: str = "smooth",
           rows: int | None = None) -> DataFrame:
    """Replace outliers of a centred window by its median; the ends stay as they are."""
    half = width // 2
    win = layout.sliding(df, half, half, {"_w": lambda w, f: F.collect_list(col).over(f)}, rows)
    win = win.withColumn("_m", _median(F.col("_w")))
    dev = _deviation(F.col("_w"), F.col("_m"))
    far = F.abs(F.col(col) - F.col("_m")) > n_sigma * 1.4826 * dev
    inner = (F.col("i") >= half) & (F.col("i") < F.col("n") - half)
    return win.withColumn(out, F.when(inner & far, F.col("_m")).otherwise(F.col(col))).drop("_w", "_m")


def running_mad(df: DataFrame, col: str, width: int, out: str = "mad", rows: int | None = None) -> DataFrame:
    """MAD of the window i +- width//2, NULL with fewer than max(10, width//5) finite values."""
    half = width // 2
    ok = F.when(~F.isnan(col) & (F.abs(col) < float("inf")), F.col(col))
    win = layout.sliding(df.withColumn("_x", ok), half, half, {"_w": lambda w, f: F.collect_list("_x").over(f)}, rows)
    dev = _deviation(F.col("_w"), _median(F.col("_w")))
    return win.withColumn(out, F.when(F.size("_w") >= max(10, width // 5), dev)).drop("_w", "_x")


def running_std(df: DataFrame, col: str, width: int, ddof: int = 1, out: str = "std",
                rows: int | None = None) -> DataFrame:
    half = width // 2
    spread_of = F.stddev_samp if ddof == 1 else F.stddev_pop
    ok = F.when(~F.isnan(col) & (F.abs(col) < float("inf")), F.col(col))
    return layout.sliding(df.withColumn("_x", ok), half, half, {out: lambda w, f: F.when(
        F.count("_x").over(f) >= max(10, width // 5), spread_of("_x").over(f))}, rows).drop("_x")


def sliding_rmse(df: DataFrame, measured: str, predicted: str, width: int, out: str = "rmse",
                 rows: int | None = None) -> DataFrame:
    """Local RMSE of an odd window, only where the window is complete."""
    if width < 1 or width % 2 == 0:
        raise ValueError("width must be a positive odd integer")
    h = width // 2
    sq = df.withColumn("_r2", (F.col(measured) - F.col(predicted)) ** 2)
    return layout.sliding(sq, h, h, {out: lambda w, f: F.sqrt(F.avg("_r2").over(f))}, rows).where(
        f"i >= {h} and i < n - {h}").drop("_r2")


def derivative(df: DataFrame, y: str, x: str | None = None, out: str = "slope", rows: int | None = None) -> DataFrame:
    """Second-order gradient on a (possibly uneven) grid, one-sided at the ends."""
    pos = F.col(x) if x else F.col("i").cast("double")

    def slope(w, f):
        if x is None:  # unit steps
            return F.when(F.col("i") == 0, F.lead(y).over(w) - F.col(y)).when(
                F.col("i") == F.col("n") - 1, F.col(y) - F.lag(y).over(w)).otherwise((F.lead(y).over(w) - F.lag(y).over(w)) / 2)
        hd, hs = pos - F.lag(pos).over(w), F.lead(pos).over(w) - pos
        up, dn = F.lead(y).over(w) - F.col(y), F.col(y) - F.lag(y).over(w)
        inner = F.try_divide(hd * hd * up + hs * hs * dn, hs * hd * (hd + hs))
        return F.when(F.col("i") == 0, F.try_divide(up, hs)).when(
            F.col("i") == F.col("n") - 1, F.try_divide(dn, hd)).otherwise(inner)

    return layout.sliding(df, 1, 1, {out: slope}, rows)


def cumulative_area(df: DataFrame, x: str, y: str, out: str = "area", rows: int | None = None) -> DataFrame:
    """Running trapezoid integral, 0 at the first sample."""
    strip = layout.sliding(df, 1, 0, {"_a": lambda w, f: F.coalesce(
        (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w)), F.lit(0.0))}, rows)
    return layout.running_sum(strip, {out: "_a"}).drop("_a")


def uniform_time(df: DataFrame, rate: float, out: str = "t") -> DataFrame:
    return df.withColumn(out, F.col("i") / float(rate))


# --- zero-phase recursive low-pass ---------------------------------------------------

def lowpass_design(kind: str, order: int, wn: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital low-pass; ``wn`` is a fraction of Nyquist.

    Bessel poles are the roots of the reverse Bessel polynomial, scaled so that the
    asymptote equals that of a Butterworth filter; then prewarping and bilinear transform.
    """
    if kind == "bessel":
        coeffs = [math.factorial(2 * order - k) / (2 ** (order - k) * math.factorial(k) * math.factorial(order - k))
                  for k in range(order, -1, -1)]
        poles = np.roots(coeffs) / coeffs[-1] ** (1 / order)
    elif kind == "butter":
        poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    else:
        raise ValueError("kind must be bessel or butter")
    warped = 4 * math.tan(math.pi * wn / 2)
    poles = poles * warped
    z = (4 + poles) / (4 - poles)
    a = np.real(np.poly(z))
    b = np.poly(-np.ones(order))
    return b * (a.sum() / b.sum()), a


def impulse_response(b: np.ndarray, a: np.ndarray, eps: float = 1e-15) -> np.ndarray:
    """Impulse response up to the point where its tail is below ``eps``."""
    radius = max(abs(np.roots(a)))
    size = int(math.log(eps) / math.log(radius)) + len(b) * 4
    h = np.zeros(size)
    for k in range(size):
        h[k] = (b[k] if k < len(b) else 0.0) - sum(a[m] * h[k - m] for m in range(1, min(k, len(a) - 1) + 1))
    return h


BLOCK_VALUES = 1 << 20  #: values of equally long groups that are filtered at once


def _convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """y[k] = sum_m h[m] x[k - m] for k >= len(h) - 1, for each row of ``x``."""
    size = 1 << (x.shape[1] + len(h) - 2).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)
    return full[:, len(h) - 1:x.shape[1]]


def zero_phase_lowpass(df: DataFrame, cols: Sequence[str], factor: int, kind: str = "bessel", order: int = 4,
                       cutoff: float = 0.8, decimate: bool = True, rows: int | None = None) -> DataFrame:
    """Forward-backward Bessel or Butterworth low-pass, optionally decimated by ``factor``.

    ``cutoff`` is relative to the new Nyquist frequency.  Each (trace, chunk) group gets
    a halo as long as the impulse response, so no group holds a whole long trace; first
    and last chunks apply the odd extension and steady-state start of the usual
    forward-backward scheme.  Decimation drops ``factor`` samples at both ends if more
    than two factors are available.
    """
    rows = rows or layout.CHUNK_ROWS
    b, a = lowpass_design(kind, order, cutoff / factor)
    h = impulse_response(b, a)
    reach = len(h) - 1
    sections = (order + 1) // 2
    pad = 3 * (2 * sections + 1 - (order % 2))
    lo = f"greatest(0L, (i - {reach + pad}L) div {rows}L)"
    hi = f"least((n - 1) div {rows}L, (i + {reach + pad}L) div {rows}L)"
    wide = df.select("trace", "n", "i", *cols).withColumn("chunk", F.explode(F.expr(f"sequence({lo}, {hi})")))
    names = list(cols)

    def smooth(x, first, last):
        """Rows of ``x`` are groups of one size; returns them smoothed, and what came before the first sample."""
        lead = 0
        if first:
            edge = 2 * x[:, :1] - x[:, min(pad, x.shape[1] - 1):0:-1]
            x = np.concatenate([np.repeat(edge[:, :1] if edge.shape[1] else x[:, :1], reach, axis=1), edge, x], axis=1)
            lead = reach + edge.shape[1]
        if last:
            edge = 2 * x[:, -1:] - x[:, -2:-2 - pad:-1]
            x = np.concatenate([x, edge], axis=1)
        y = _convolve(x, h)  # y[k] belongs to x[k + reach]
        if last:
            y = np.concatenate([y, np.repeat(y[:, -1:], reach, axis=1)], axis=1)
        return _convolve(y[:, ::-1], h)[:, ::-1], lead - reach  # z[k] belongs to y[k]

    def smooth_sorted(batches):
        for table, borders in whole_groups(batches, ("trace", "chunk")):
            pos, length, chunk = (table.column(c).to_numpy() for c in ("i", "n", "chunk"))
            values = {c: table.column(c).to_numpy().astype(float) for c in names}
            head, size = borders[:-1], np.diff(borders)
            n, start = length[head], chunk[head] * rows
            stop = np.minimum(n, start + rows)
            kinds = np.stack([size, pos[head] == 0, pos[borders[1:] - 1] == n - 1, start - pos[head], stop - start], axis=1)
            # groups of one shape are filtered together
            shapes, member = np.unique(kinds, axis=0, return_inverse=True)
            member = member.reshape(-1)
            for which, (m, first, last, skip, count) in enumerate(shapes.tolist()):
                mine = np.flatnonzero(member == which)
                step = max(1, BLOCK_VALUES // (m + 2 * (reach + pad)))
                for part in (mine[k:k + step] for k in range(0, len(mine), step)):
                    at = head[part][:, None] + np.arange(m)
                    result = {}
                    for c in names:
                        z, offset = smooth(values[c][at], first, last)
                        result[c] = z[:, offset + skip:offset + skip + count]
                    i, own = start[part][:, None] + np.arange(count), n[part][:, None]
                    src, keep = i, np.ones(i.shape, dtype=bool)
                    if decimate:
                        cut = np.where(own > 2 * factor, factor, 0)
                        keep = ((i - cut) % factor == 0) & (i >= cut) & (i < own - cut)
                        i, own = (i - cut) // factor, -(-(own - 2 * cut) // factor)
                    own = np.broadcast_to(own, keep.shape)
                    owner = np.broadcast_to(head[part][:, None], keep.shape)[keep]
                    out = [table.column("trace").take(pa.array(owner)).combine_chunks(), own[keep], i[keep], src[keep]]
                    out += [pa.array(result[c][keep], from_pandas=True) for c in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in out],
                                                     ["trace", "n", "i", "src", *names])

    kind_of = df.schema["trace"].dataType.simpleString()
    schema = f"trace {kind_of}, n bigint, i bigint, src bigint, " + ", ".join(f"{c} double" for c in names)
    enough = layout.by_group(wide.where(f"n > {pad}"), "trace", "chunk").sortWithinPartitions("trace", "chunk", "i")
    return layout.with_chunk(enough.mapInArrow(smooth_sorted, schema), rows)


def downsample_frame(df: DataFrame, numeric: Sequence[str], factor: int, rate: float, method: str = "bessel",
                     time: str | None = None, **options) -> DataFrame:
    """Filter numeric columns, take metadata at the kept samples, rebuild the time axis."""
    if method == "boxcar":
        low = boxcar_decimate(df, numeric, factor)
    else:
        low = zero_phase_lowpass(df, numeric, factor, method, **options)
    meta = [c for c in df.columns if c not in (*numeric, "i", "n", "chunk", time)]
    joined = low.join(df.select("i", *meta).withColumnRenamed("i", "src"), ["trace", "src"])
    if time:
        joined = joined.withColumn(time, F.col("i") * factor / float(rate))
    return joined.select(*[c for c in df.columns])
