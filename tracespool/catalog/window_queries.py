"""Queries on smoothing, running statistics and polynomial fits."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracespool.catalog.filtering import DECIMATED, decimated
from tracespool.catalog.registry import query
from tracespool.catalog.views import PULLS, SIGNALS, pulls, signals, snap, sql_eps, sql_snap
from tracespool.functions import wlc
from tracespool.operators import filters, polyfit

EXT = SIGNALS + """, fl AS (SELECT trace, min_by(x,i) AS f0, max_by(x,i) AS l0 FROM signals GROUP BY 1),
 ext AS (SELECT trace, n, i, x FROM signals UNION ALL SELECT trace, n, -i, 2*f0-x FROM signals JOIN fl USING(trace) WHERE i BETWEEN 1 AND 5
   UNION ALL SELECT trace, n, 2*(n-1)-i, 2*l0-x FROM signals JOIN fl USING(trace) WHERE i BETWEEN n-6 AND n-2)"""


@query("boxcar_smooth", f"""WITH {EXT} SELECT c.trace, c.i, {sql_snap('sum((5-abs(e.i-c.i))*e.x)/25','x')} FROM signals c JOIN ext e
  ON e.trace=c.trace AND e.i BETWEEN c.i-4 AND c.i+4 GROUP BY 1,2""")
def _smooth(spark, sf_dir):
    out = filters.boxcar_smooth(signals(spark, sf_dir, reuse=True), ["x"], 5)
    return out.select("trace", "i", snap("x").alias("x"))


def _savgol_sql():
    centre, edge = filters.savgol_kernels(7, 2)
    # weights by definition: least-squares parabola on the window, evaluated at the sample
    cs = ",".join(repr(float(v)) for v in centre)
    es = ",".join("[" + ",".join(repr(float(v)) for v in r) + "]" for r in edge)
    return f"""WITH {SIGNALS}, m AS (SELECT c.trace, c.i, sum([{cs}][x.i-c.i+4]*x.x) AS v FROM signals c JOIN signals x
      ON x.trace=c.trace AND x.i BETWEEN c.i-3 AND c.i+3 WHERE c.i>=3 AND c.i<c.n-3 GROUP BY 1,2),
     e AS (SELECT c.trace, c.i, sum([{es}][c.i+1][x.i+1]*x.x) AS v FROM signals c JOIN signals x ON x.trace=c.trace AND x.i<7 WHERE c.i<3 GROUP BY 1,2
      UNION ALL SELECT c.trace, c.i, sum([{es}][c.n-c.i][x.n-x.i]*x.x) FROM signals c JOIN signals x ON x.trace=c.trace AND x.i>=x.n-7 WHERE c.i>=c.n-3 GROUP BY 1,2)
     SELECT trace, i, {sql_snap('v','x')} FROM (SELECT * FROM m UNION ALL SELECT * FROM e)"""


@query("savgol_smooth", _savgol_sql())
def _savgol(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    return filters.savgol(s, "x", 7, 2).select("trace", "i", snap("smooth").alias("x"))


@query("savgol_decimate", f"""WITH {SIGNALS} SELECT c.trace, c.i//7-1 AS i, {sql_snap('avg(x.x)','x')} FROM signals c JOIN signals x
  ON x.trace=c.trace AND x.i BETWEEN c.i-3 AND c.i+3 WHERE c.i>=7 AND c.i<c.n-7 AND c.i%7=0 GROUP BY 1,2""")
def _savgol_dec(spark, sf_dir):
    out = filters.savgol(signals(spark, sf_dir), "x", 7, 1, decimate=True)
    return out.select("trace", "i", snap("smooth").alias("x"))


WIN = """w AS (SELECT c.trace, c.i, any_value(c.n) AS n, any_value(c.x) AS x, list(x.x) AS v FROM signals c JOIN signals x
   ON x.trace=c.trace AND x.i BETWEEN c.i-{h} AND c.i+{h} GROUP BY 1,2)"""


@query("median_filter", f"""WITH {SIGNALS}, {WIN.format(h=2)} SELECT trace, i,
  list_sort(list_concat(v, list_transform(range(5-len(v)), lambda k: 0.0::DOUBLE)))[3] AS x FROM w""")
def _median(spark, sf_dir):
    return filters.median_filter(signals(spark, sf_dir), "x", 5).select("trace", "i", F.col("smooth").alias("x"))


@query("hampel_filter", f"""WITH {SIGNALS}, {WIN.format(h=3)}, m AS (SELECT *, list_median(v) AS md FROM w)
  SELECT trace, i, {sql_snap('CASE WHEN i>=3 AND i<n-3 AND abs(x-md)>3*1.4826*list_median(list_transform(v, lambda a: abs(a-md))) THEN md ELSE x END','x')} FROM m""")
def _hampel(spark, sf_dir):
    return filters.hampel(signals(spark, sf_dir), "x", 7).select("trace", "i", snap("smooth").alias("x"))


@query("running_mad", f"""WITH {SIGNALS}, {WIN.format(h=10)}, m AS (SELECT *, list_median(v) AS md FROM w)
  SELECT trace, i, CASE WHEN len(v)>=10 THEN {sql_snap('list_median(list_transform(v, lambda a: abs(a-md)))')} END AS mad FROM m""")
def _running_mad(spark, sf_dir):
    return filters.running_mad(signals(spark, sf_dir), "x", 21).select("trace", "i", snap("mad").alias("mad"))


@query("running_std", f"""WITH {SIGNALS} SELECT c.trace, c.i, CASE WHEN count(*)>=14 THEN {sql_snap('stddev_samp(x.x)')} END AS std FROM signals c JOIN signals x
  ON x.trace=c.trace AND x.i BETWEEN c.i-35 AND c.i+35 GROUP BY 1,2""")
def _running_std(spark, sf_dir):
    return filters.running_std(signals(spark, sf_dir), "x", 71).select("trace", "i", snap("std").alias("std"))


@query("sliding_rmse", f"""WITH {PULLS}, p AS (SELECT *, f-40*d AS r FROM pulls) SELECT c.trace, c.i, {sql_snap('sqrt(avg(x.r*x.r))','rmse')}
  FROM p c JOIN p x ON x.trace=c.trace AND x.i BETWEEN c.i-4 AND c.i+4 WHERE c.i>=4 AND c.i<c.n-4 GROUP BY 1,2""")
def _rmse(spark, sf_dir):
    df = pulls(spark, sf_dir).withColumn("model", 40 * F.col("d"))
    return filters.sliding_rmse(df, "f", "model", 9).select("trace", "i", snap("rmse").alias("rmse"))


@query("gradient", f"""WITH {SIGNALS}, g AS (SELECT trace,i,n,x,t, t-lag(t) OVER w AS hd, lead(t) OVER w-t AS hs, x-lag(x) OVER w AS dn, lead(x) OVER w-x AS up
   FROM signals WINDOW w AS (PARTITION BY trace ORDER BY i))
  SELECT trace, i, {sql_snap('CASE WHEN i=0 THEN up/hs WHEN i=n-1 THEN dn/hd ELSE (hd/(hd+hs))*up/hs + (hs/(hd+hs))*dn/hd END','slope')} FROM g""")
def _gradient(spark, sf_dir):
    return filters.derivative(signals(spark, sf_dir), "x", "t").select("trace", "i", snap("slope").alias("slope"))


@query("cumulative_area", f"""WITH {SIGNALS}, a AS (SELECT trace,i, coalesce((x+lag(x) OVER w)/2*(t-lag(t) OVER w)/1000,0) AS s FROM signals WINDOW w AS (PARTITION BY trace ORDER BY i))
  SELECT trace, i, {sql_snap('sum(s) OVER (PARTITION BY trace ORDER BY i)','area')} FROM a""")
def _area(spark, sf_dir):
    df = signals(spark, sf_dir, reuse=True).withColumn("t", F.col("t") / 1000)
    return filters.cumulative_area(df, "t", "x").select("trace", "i", snap("area").alias("area"))


def _iir_sql(kind, order, wn, pad):
    """Forward and backward recursions as recursive queries, direct form with explicit state."""
    b, a = filters.lowpass_design(kind, order, wn)
    y = " + ".join([f"{float(b[0])!r}*e.x"] + [f"{float(b[k])!r}*w.x{k}" for k in range(1, order + 1)]
                   + [f"({-float(a[k])!r})*w.y{k}" for k in range(1, order + 1)])
    state = ", ".join([f"x{k}" for k in range(1, order + 1)] + [f"y{k}" for k in range(1, order + 1)])
    shift = ", ".join(["e.x"] + [f"w.x{k}" for k in range(1, order)] + [y] + [f"w.y{k}" for k in range(1, order)])
    start = ", ".join(["x"] * (2 * order))

    def run(src, dst):
        return f"""{dst}(trace, m, x, {state}) AS (SELECT trace, -1::BIGINT, x, {start} FROM {src} WHERE m=0
          UNION ALL SELECT w.trace, e.m, e.x, {shift} FROM {dst} w JOIN {src} e ON e.trace=w.trace AND e.m=w.m+1)"""

    return f"""WITH RECURSIVE {SIGNALS}, fl AS (SELECT trace, min_by(x,i) AS f0, max_by(x,i) AS l0 FROM signals GROUP BY 1),
     ext AS (SELECT trace, n, i, x FROM signals UNION ALL SELECT trace, n, -i, 2*f0-x FROM signals JOIN fl USING(trace) WHERE i BETWEEN 1 AND {pad}
       UNION ALL SELECT trace, n, 2*(n-1)-i, 2*l0-x FROM signals JOIN fl USING(trace) WHERE i BETWEEN n-1-{pad} AND n-2),
     fwd AS (SELECT trace, n, i+{pad} AS m, x FROM ext), {run('fwd', 'w1')},
     sz AS (SELECT trace, max(n) AS n FROM signals GROUP BY 1),
     bwd AS (SELECT w1.trace, sz.n+2*{pad}-1-w1.m AS m, w1.y1 AS x FROM w1 JOIN sz USING(trace) WHERE w1.m>=0), {run('bwd', 'w2')},
     res AS (SELECT w2.trace, sz.n+2*{pad}-1-w2.m-{pad} AS src, sz.n, w2.y1 AS y FROM w2 JOIN sz USING(trace) WHERE w2.m>=0)"""


@query("bessel_decimate", _iir_sql("bessel", 4, 0.8 / 4, 15) + f""" SELECT trace, src//4-1 AS i, src, {sql_snap('y','x')} FROM res
   WHERE src>=4 AND src<n-4 AND src%4=0""")
def _bessel(spark, sf_dir):
    out = filters.zero_phase_lowpass(signals(spark, sf_dir), ["x"], 4)
    return out.select("trace", "i", "src", snap("x").alias("x"))


@query("butterworth_smooth", _iir_sql("butter", 4, 0.8 / 4, 15) + f" SELECT trace, src AS i, {sql_snap('y','x')} FROM res WHERE src>=0 AND src<n")
def _butter(spark, sf_dir):
    out = filters.zero_phase_lowpass(signals(spark, sf_dir), ["x"], 4, "butter", decimate=False)
    return out.select("trace", "i", snap("x").alias("x"))


@query("downsample_frame", f"""WITH {SIGNALS} SELECT c.trace, c.i//3-1 AS i, CAST((c.i//3-1)*3 AS DOUBLE)/1000 AS t, any_value(c.lab) AS lab,
  {sql_snap('sum((3-abs(s.i-c.i))*s.x)/9','x')} FROM signals c JOIN signals s ON s.trace=c.trace AND s.i BETWEEN c.i-2 AND c.i+2
  WHERE c.n>9 AND c.i>=3 AND c.i<c.n-3 AND c.i%3=0 GROUP BY c.trace, c.i""")
def _frame(spark, sf_dir):
    out = filters.downsample_frame(signals(spark, sf_dir, reuse=True), ["x"], 3, 1000, "boxcar", "t")
    return out.select("trace", "i", "t", "lab", snap("x").alias("x"))


@query("line_fit", f"""WITH {PULLS} SELECT trace, count(*) AS m, {sql_snap('regr_intercept(f,d)','c0')}, {sql_snap('regr_slope(f,d)','c1')},
  {sql_snap('regr_r2(f,d)','r2')} FROM pulls GROUP BY 1""")
def _line(spark, sf_dir):
    out = polyfit.fit(pulls(spark, sf_dir, reuse=True), "d", "f", 1)
    return out.select("trace", "m", snap(F.col("coeffs")[0]).alias("c0"), snap(F.col("coeffs")[1]).alias("c1"), snap("r2").alias("r2"))


# parabola by orthogonalising d^2 against d, then one more regression
PARABOLA = PULLS + """, l1 AS (SELECT trace, regr_slope(d*d,d) AS s, regr_intercept(d*d,d) AS c, regr_slope(f,d) AS a1, regr_intercept(f,d) AS a0 FROM pulls GROUP BY 1),
  q AS (SELECT p.*, d*d-s*d-c AS q, l1.* EXCLUDE (trace) FROM pulls p JOIN l1 USING(trace)),
  k AS (SELECT trace, sum(q*f)/sum(q*q) AS c2, any_value(a1) AS a1, any_value(a0) AS a0, any_value(s) AS s, any_value(c) AS c FROM q GROUP BY 1)"""


@query("parabola_fit", f"""WITH {PARABOLA} SELECT trace, {sql_snap('a0-c2*c','c0')}, {sql_snap('a1-c2*s','c1')}, {sql_snap('c2','c2')} FROM k""")
def _parabola(spark, sf_dir):
    out = polyfit.fit(pulls(spark, sf_dir, reuse=True), "d", "f", 2)
    return out.select("trace", *[snap(F.col("coeffs")[k]).alias(f"c{k}") for k in range(3)])


@query("polynomial_predictions", f"""WITH {PARABOLA} SELECT p.trace, p.i, {sql_snap('a0-c2*c+(a1-c2*s)*d+c2*d*d','predicted')} FROM pulls p JOIN k USING(trace)""")
def _predict(spark, sf_dir):
    s = pulls(spark, sf_dir, reuse=True)
    return polyfit.predict(s, polyfit.fit(s, "d", "f", 2), "d", 2).select("trace", "i", snap("predicted").alias("predicted"))


@query("studentised_residuals", f"""WITH {PULLS}, l AS (SELECT trace, count(*) AS m, avg(d) AS md, var_pop(d)*count(*) AS sxx, regr_slope(f,d) AS a, regr_intercept(f,d) AS b FROM pulls GROUP BY 1),
  r AS (SELECT p.trace, i, f-a*d-b AS e, 1.0/m+(d-md)*(d-md)/sxx AS h, m FROM pulls p JOIN l USING(trace)),
  s AS (SELECT trace, sum(e*e)/(max(m)-2) AS s2 FROM r GROUP BY 1)
  SELECT r.trace, i, {sql_snap('e/sqrt(s2*(1-h))','studentised')} FROM r JOIN s USING(trace)""")
def _student(spark, sf_dir):
    s = pulls(spark, sf_dir, reuse=True)
    out = polyfit.residuals(s, polyfit.fit(s, "d", "f", 1), "d", "f", 1)
    return out.select("trace", "i", snap("studentised").alias("studentised"))


@query("breusch_pagan", f"""WITH {PULLS}, l AS (SELECT trace, regr_slope(f,d) AS a, regr_intercept(f,d) AS b FROM pulls GROUP BY 1),
  r AS (SELECT p.trace, d, (f-a*d-b)*(f-a*d-b) AS e FROM pulls p JOIN l USING(trace))
  SELECT trace, {sql_snap('count(*)*regr_r2(e,d)','lm')}, CASE WHEN count(*)*regr_r2(e,d)>3.841458820694124 THEN 1 ELSE 0 END AS heteroscedastic FROM r GROUP BY 1""")
def _bp(spark, sf_dir):
    out = polyfit.breusch_pagan(pulls(spark, sf_dir, reuse=True), "d", "f", 1)
    return out.select("trace", snap("lm").alias("lm"), "heteroscedastic")


@query("detrend", f"""WITH {SIGNALS}, l AS (SELECT trace, regr_slope(x,i) AS a, regr_intercept(x,i) AS b FROM signals GROUP BY 1)
  SELECT trace, i, {sql_snap('a*i+b','baseline')}, {sql_snap('x-a*i-b','detrended')} FROM signals JOIN l USING(trace)""")
def _detrend(spark, sf_dir):
    out = polyfit.detrend(signals(spark, sf_dir, reuse=True), "x", 1)
    return out.select("trace", "i", snap("baseline").alias("baseline"), snap("detrended").alias("detrended"))


@query("trap_instability", f"""WITH {PULLS}, l AS (SELECT trace, regr_slope(f2,f) AS a, regr_intercept(f2,f) AS b FROM pulls GROUP BY 1),
  r AS (SELECT p.trace, i, f2, f2-(a*f+b) AS r FROM pulls p JOIN l USING(trace)), k AS (SELECT trace, regr_slope(r,i) AS s, regr_intercept(r,i) AS c FROM r GROUP BY 1)
  SELECT r.trace, i, {sql_snap('f2-(s*i+c)','corrected')} FROM r JOIN k USING(trace)""")
def _instability(spark, sf_dir):
    out = polyfit.remove_instability(pulls(spark, sf_dir, reuse=True), "f2", "f", 1)
    return out.select("trace", "i", snap("corrected").alias("corrected"))


@query("contour_length_of_smoothed", f"""WITH {DECIMATED} SELECT trace, i, {sql_snap('(d-0.05*' + sql_eps('f',0.65) + ')/' + sql_eps('f',50,1200),'lc')} FROM dec""")
def _lc_two(spark, sf_dir):
    lc = wlc.contour_length(F.col("d"), F.col("f"), (50, None, 1200), (0.65, 0.05))
    return decimated(spark, sf_dir).select("trace", "i", snap(lc).alias("lc"))
