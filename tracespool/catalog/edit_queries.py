"""Queries on transition sizes, force grids, noise and manual edits."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracespool.catalog.filtering import DECIMATED, decimated
from tracespool.catalog.join_queries import BEADS, CAL, calibrated, calpars
from tracespool.catalog.registry import query
from tracespool.catalog.run_queries import LEVELS, levels
from tracespool.catalog.views import PULLS, SIGNALS, pulls, signals, snap, sql_eps, sql_snap, table
from tracespool.functions import kinetics
from tracespool.operators import curves, edits, legs, runs, sets, stats
from tracespool.plans import layout

CUTS = SIGNALS + """, cuts AS (SELECT trace, t AS lo, t+30000*(1+i%3) AS hi FROM signals WHERE i%9=4),
  gone AS (SELECT DISTINCT s.trace, s.i FROM signals s JOIN cuts c ON c.trace=s.trace AND s.t>=c.lo AND s.t<=c.hi),
  kept AS (SELECT s.trace, s.i AS src, row_number() OVER (PARTITION BY s.trace ORDER BY s.i)-1 AS i FROM signals s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.trace=s.trace AND g.i=s.i))"""


def cuts(samples):
    return samples.where("i % 9 = 4").select("trace", F.col("t").alias("lo"), (F.col("t") + 30000 * (1 + F.col("i") % 3)).alias("hi"))


@query("cut_regions", f"WITH {CUTS} SELECT trace, i, src FROM kept")
def _cut(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    return edits.cut_regions(s, cuts(s), "t").select("trace", "i", "src")


@query("carry_intervals", f"""WITH {LEVELS}, cuts AS (SELECT trace, t AS lo, t+30000*(1+i%3) AS hi FROM signals WHERE i%9=4),
  gone AS (SELECT DISTINCT s.trace, s.i FROM signals s JOIN cuts c ON c.trace=s.trace AND s.t>=c.lo AND s.t<=c.hi),
  kept AS (SELECT s.trace, s.i AS src, row_number() OVER (PARTITION BY s.trace ORDER BY s.i)-1 AS i, rn.k FROM signals s JOIN rn ON rn.trace=s.trace AND rn.i=s.i
    WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.trace=s.trace AND g.i=s.i)),
  p AS (SELECT *, CASE WHEN lag(k) OVER w=k AND src-lag(src) OVER w=1 THEN 0 ELSE 1 END AS c FROM kept WINDOW w AS (PARTITION BY trace ORDER BY i)),
  q AS (SELECT *, sum(c) OVER (PARTITION BY trace ORDER BY i)-1 AS r FROM p)
  SELECT trace, CAST(r AS BIGINT) AS k, min(i) AS start, max(i)+1 AS stop, CAST(min(k) AS BIGINT) AS source_k FROM q GROUP BY 1,2""")
def _carry(spark, sf_dir):
    s = levels(spark, sf_dir)
    kept = layout.settle(edits.cut_regions(s, cuts(s), "t"))
    out = edits.carry_intervals(runs.dwells(s, "level"), s, kept)
    return out.select("trace", "k", "start", "stop", "source_k")


TIMED = LEVELS + """, td AS (SELECT dw.*, a.t AS t_start, b.t AS t_stop FROM dw JOIN signals a ON a.trace=dw.trace AND a.i=dw.start JOIN signals b ON b.trace=dw.trace AND b.i=dw.stop-1)"""


def timed_dwells(s):
    dw = runs.dwells(s, "level", extra={"t_start": F.min("t"), "t_stop": F.max("t")})
    return dw.drop("n")


@query("replace_dwells", f"""WITH {TIMED}, ed AS (SELECT trace, k AS seq, t_start AS t1, t_stop+1 AS t2 FROM td WHERE k%10=3
    UNION ALL SELECT a.trace, a.k, a.t_start, b.t_stop FROM td a JOIN td b ON b.trace=a.trace AND b.k=a.k+2 WHERE a.k%10=6),
  hit AS (SELECT td.trace, td.k, ed.seq, td.start, td.stop FROM td JOIN ed ON ed.trace=td.trace AND td.t_start<=ed.t2 AND td.t_stop>=ed.t1),
  pool AS (SELECT hit.trace, seq, sum(s.x)/count(*) AS m FROM hit JOIN signals s ON s.trace=hit.trace AND s.i>=hit.start AND s.i<hit.stop GROUP BY 1,2),
  nw AS (SELECT hit.trace, hit.k, max_by(m, seq) AS m FROM hit JOIN pool USING(trace, seq) GROUP BY 1,2),
  lv2 AS (SELECT td.trace, td.k, td.start, td.stop, coalesce(m, level) AS level FROM td LEFT JOIN nw USING(trace,k)),
  fl AS (SELECT *, CASE WHEN abs(lag(level) OVER (PARTITION BY trace ORDER BY k)-level)<1e-9 THEN 0 ELSE 1 END AS c FROM lv2),
  gr2 AS (SELECT *, sum(c) OVER (PARTITION BY trace ORDER BY k)-1 AS r FROM fl)
  SELECT trace, CAST(r AS BIGINT) AS k, min(start) AS start, max(stop) AS stop, {sql_snap('min(level)','level')} FROM gr2 GROUP BY 1,2""")
def _replace(spark, sf_dir):
    s = levels(spark, sf_dir)
    dw = timed_dwells(s)
    one = dw.where("k % 10 = 3").select("trace", F.col("k").alias("seq"), F.col("t_start").alias("t1"), (F.col("t_stop") + 1).alias("t2"))
    third = dw.select("trace", (F.col("k") - 2).alias("seq"), F.col("t_stop").alias("t2"))
    span = dw.where("k % 10 = 6").select("trace", F.col("k").alias("seq"), F.col("t_start").alias("t1")).join(third, ["trace", "seq"])
    out = edits.replace_dwells(dw, s, "x", one.unionByName(span.select("trace", "seq", "t1", "t2")))
    return out.select("trace", "k", "start", "stop", snap("level").alias("level"))


@query("merge_dwells", f"""WITH {TIMED}, ed AS (SELECT trace, k, CASE WHEN k%20=3 THEN k+1 ELSE k END AS src FROM td WHERE k%10=3),
  lv2 AS (SELECT td.trace, td.k, td.start, td.stop, CASE WHEN e1.trace IS NOT NULL OR e2.trace IS NOT NULL THEN (SELECT level FROM td q WHERE q.trace=td.trace AND q.k=coalesce(e1.src,e2.src)) ELSE level END AS level
    FROM td LEFT JOIN (SELECT ed.* FROM ed JOIN td z ON z.trace=ed.trace AND z.k=ed.k+1) e1 ON e1.trace=td.trace AND e1.k=td.k
     LEFT JOIN ed e2 ON e2.trace=td.trace AND e2.k=td.k-1),
  fl AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY trace ORDER BY k)=level THEN 0 ELSE 1 END AS c FROM lv2),
  gr2 AS (SELECT *, sum(c) OVER (PARTITION BY trace ORDER BY k)-1 AS r FROM fl)
  SELECT trace, CAST(r AS BIGINT) AS k, min(start) AS start, max(stop) AS stop, min(level) AS level FROM gr2 GROUP BY 1,2""")
def _merge(spark, sf_dir):
    dw = timed_dwells(levels(spark, sf_dir))
    nxt = dw.select("trace", (F.col("k") - 1).alias("seq"), F.col("t_start").alias("t2"))
    keep = F.when(F.col("seq") % 20 == 3, "later").otherwise("earlier")
    ed = dw.where("k % 10 = 3").select("trace", F.col("k").alias("seq"), F.col("t_stop").alias("t1")).join(nxt, ["trace", "seq"])
    out = edits.merge_dwells(dw, ed.withColumn("keep", keep))
    return out.select("trace", "k", "start", "stop", "level")


@query("edit_transitions", """WITH RECURSIVE f AS (SELECT DISTINCT o_custkey AS trace, o_orderkey%40 AS pos FROM orders),
  e AS (SELECT o_custkey AS trace, o_orderkey AS seq, o_orderkey%37 AS pos, o_orderkey%41 AS dest,
     CASE WHEN o_orderkey%23=0 THEN 'reset' WHEN o_orderstatus='F' THEN 'remove' WHEN o_orderstatus='P' THEN 'move' ELSE 'add' END AS act,
     row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey%2=0),
  w(trace, r, cur) AS (SELECT trace, 0::BIGINT, list(pos) FROM f GROUP BY 1
   UNION ALL SELECT w.trace, e.r, CASE act WHEN 'reset' THEN (SELECT list(f.pos) FROM f WHERE f.trace=w.trace)
     WHEN 'remove' THEN list_filter(cur, lambda p: p<>e.pos) WHEN 'add' THEN list_distinct(list_append(cur, e.pos))
     ELSE list_distinct(list_append(list_filter(cur, lambda p: p<>e.pos), e.dest)) END FROM w JOIN e ON e.trace=w.trace AND e.r=w.r+1)
  SELECT trace, unnest(cur) AS at FROM (SELECT trace, max_by(cur, r) AS cur FROM w GROUP BY 1)""")
def _edit_transitions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    found = o.selectExpr("o_custkey trace", "o_orderkey % 40 at")
    ed = o.where("o_orderkey % 2 = 0").selectExpr(
        "o_custkey trace", "o_orderkey seq", "o_orderkey % 37 at", "o_orderkey % 41 to",
        "case when o_orderkey % 23 = 0 then 'reset' when o_orderstatus = 'F' then 'remove' when o_orderstatus = 'P' then 'move' else 'add' end action")
    return edits.edit_transitions(found, ed).select("trace", "at")


@query("edit_states", f"""WITH {LEVELS}, e AS (SELECT trace, k, level+1 AS v FROM dw WHERE k%4=1),
  s AS (SELECT dw.trace, dw.k, coalesce(e.v, dw.level) AS state FROM dw LEFT JOIN e USING(trace,k))
  SELECT trace, k, state, coalesce(lead(state) OVER w-state,0) AS dlc, state-first_value(state) OVER w AS dlc_sum FROM s WINDOW w AS (PARTITION BY trace ORDER BY k)""")
def _edit_states(spark, sf_dir):
    st = runs.dwells(levels(spark, sf_dir), "level").select("trace", "k", F.col("level").alias("state"))
    ed = st.where("k % 4 = 1").select("trace", "k", F.explode(F.array(F.struct(F.lit(1).alias("seq"), (F.col("state") * 3).alias("value")),
         F.struct(F.lit(2).alias("seq"), (F.col("state") + 1).alias("value")))).alias("e")).select("trace", "k", "e.*")
    return edits.edit_states(st, ed)


@query("retrim_to_force", f"""WITH {PULLS}, m AS (SELECT p.trace, max(i) AS r FROM pulls p WHERE trace%3=0 AND f<=20 GROUP BY 1)
  SELECT p.trace, coalesce(m.r, p.n-1) AS rupture_index FROM pulls p LEFT JOIN m USING(trace) WHERE p.i=0""")
def _retrim(spark, sf_dir):
    s = pulls(spark, sf_dir, reuse=True)
    per = s.groupBy("trace").agg((F.max("n") - 1).alias("rupture_index"))
    lim = per.where("trace % 3 = 0").select("trace", F.lit(20.0).alias("max_force"))
    return edits.retrim(s, "f", lim, per)


@query("remap_states", """SELECT n.trace, n.pos AS at, o.v AS state FROM (SELECT DISTINCT o_custkey AS trace, o_orderkey%29 AS pos FROM orders WHERE o_orderkey%3<>0) n
  LEFT JOIN (SELECT o_custkey AS trace, o_orderkey%29 AS pos, max(o_totalprice) AS v FROM orders WHERE o_orderkey%3<>1 GROUP BY 1,2) o ON o.trace=n.trace AND o.pos=n.pos""")
def _remap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey trace", "o_orderkey % 29 at", "o_totalprice v", "o_orderkey k")
    old = o.where("k % 3 <> 1").groupBy("trace", "at").agg(F.max("v").alias("state"))
    return edits.remap_states(old, o.where("k % 3 <> 0").select("trace", "at").distinct())


GRIDS = CAL + f""", g AS (SELECT trace, 1/(1/k1+1/k2) AS keq, unnest(range(60)) AS i FROM cal), gf AS (SELECT *, 0.5+i*(30-0.5)/59 AS force FROM g),
  gx AS (SELECT *, 0.69*{sql_eps('force',50,1200)} AS x FROM gf),
  gd AS (SELECT *, x-lag(x) OVER w AS hd, lead(x) OVER w-x AS hs, (30-0.5)/59.0::DOUBLE AS h FROM gx WINDOW w AS (PARTITION BY trace ORDER BY i)),
  gk AS (SELECT trace, i, force, 1/(1/keq+1/(CASE WHEN i=0 THEN h/hs WHEN i=59 THEN h/hd ELSE (hd/(hd+hs))*h/hs+(hs/(hd+hs))*h/hd END)) AS k FROM gd)"""


def grids(spark, sf_dir):
    cal = sets.stiffness_pivot(calpars(spark, sf_dir)).select(F.col("baseline").alias("trace"), (1 / (1 / F.col("k1") + 1 / F.col("k2"))).alias("keq"))
    grid = curves.force_grid(cal, 0.5, 30, 60)
    return curves.loading_rate(curves.total_stiffness(grid, "keq", ((50, 0.69, 1200),), 0.5, 30, 60), 0.2)


@query("loading_rate", f"WITH {GRIDS} SELECT trace, i, {sql_snap('force','force')}, {sql_snap('k','k_total')}, {sql_snap('k*0.2','loading_rate')} FROM gk")
def _loading(spark, sf_dir):
    return grids(spark, sf_dir).select("trace", "i", *[snap(c).alias(c) for c in ("force", "k_total", "loading_rate")])


@query("rupture_distribution", f"""WITH {GRIDS}, hz AS (SELECT trace, i, force, 0.01*exp(force*0.9/(0.01380649*298.15))/(k*0.2) AS h FROM gk),
  st AS (SELECT *, coalesce((h+lag(h) OVER w)/2*(force-lag(force) OVER w),0) AS s FROM hz WINDOW w AS (PARTITION BY trace ORDER BY i)),
  ci AS (SELECT *, exp(-sum(s) OVER (PARTITION BY trace ORDER BY i)) AS sv FROM st)
  SELECT trace, i, {sql_snap('h*sv','pdf')}, {sql_snap('1-sv','cdf')}, {sql_snap('sv','survival')} FROM ci""")
def _distribution(spark, sf_dir):
    out = curves.rupture_distribution(grids(spark, sf_dir), kinetics.bell_rate(F.col("force"), 0.01, 0.9))
    return out.select("trace", "i", *[snap(c).alias(c) for c in ("pdf", "cdf", "survival")])


@query("inverse_sample")
def _inverse_sample(spark, sf_dir):
    dist = layout.settle(curves.rupture_distribution(grids(spark, sf_dir), kinetics.bell_rate(F.col("force"), 0.01, 0.9)))
    return curves.inverse_sample(dist, "force", "pdf", 50, 7).select("trace", "draw", snap("value").alias("value"))


@query("unwrapping_length")
def _unwrapping(spark, sf_dir):
    rows = pulls(spark, sf_dir).select("trace", "i", (F.col("d") * 40).alias("dx"), "f", (F.col("f") * 0.9).alias("f2"))
    out = curves.unwrapping_roots(rows, "dx", "f", "f2", 690.0, 50.0, 4.76, 0.0, 90.0)
    return out.select("trace", "i", snap("dlc").alias("dlc"))


@query("noise_against_force", f"""WITH {SIGNALS}, d AS (SELECT trace, i, lead(x) OVER w-x AS dd, 0.5*(t+lead(t) OVER w)/1e5 AS fm FROM signals WINDOW w AS (PARTITION BY trace ORDER BY i)),
  q AS (SELECT trace, quantile_cont(abs(dd),0.9) AS thr FROM d WHERE dd IS NOT NULL GROUP BY 1),
  c AS (SELECT d.trace, i, fm, greatest(least(dd,thr),-thr) AS v FROM d JOIN q USING(trace) WHERE dd IS NOT NULL),
  w AS (SELECT a.trace, a.i, a.fm, list(b.v) AS v FROM c a JOIN c b ON b.trace=a.trace AND b.i BETWEEN a.i-10 AND a.i+10 GROUP BY 1,2,3), m AS (SELECT *, list_median(v) AS md FROM w WHERE len(v)>=10)
  SELECT trace, i, {sql_snap('fm','force_mid')}, {sql_snap('list_median(list_transform(v, lambda a: abs(a-md)))/0.6745/sqrt(2)','sigma')} FROM m""")
def _noise(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True).withColumn("t", F.col("t") / 1e5)
    out = stats.noise_points(s, "x", "t", 21, 0.9)
    return out.select("trace", "i", snap("force_mid").alias("force_mid"), snap("sigma").alias("sigma"))


@query("trace_noise", f"""WITH {SIGNALS}, h AS (SELECT trace, i, x FROM signals WHERE t/1e5>4), d AS (SELECT trace, lead(x) OVER w-x AS dd FROM h WINDOW w AS (PARTITION BY trace ORDER BY i)),
  q AS (SELECT trace, quantile_cont(abs(dd),0.9) AS thr FROM d WHERE dd IS NOT NULL GROUP BY 1), c AS (SELECT trace, greatest(least(dd,thr),-thr) AS v FROM d JOIN q USING(trace) WHERE dd IS NOT NULL),
  m AS (SELECT trace, quantile_cont(v,0.5) AS md FROM c GROUP BY 1) SELECT trace, {sql_snap('quantile_cont(abs(v-md),0.5)/0.6745/sqrt(2)','sigma')} FROM c JOIN m USING(trace) GROUP BY 1""")
def _trace_noise(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True).withColumn("t", F.col("t") / 1e5)
    return stats.trace_noise(s, "x", "t", 4.0, 0.9).select("trace", snap("sigma").alias("sigma"))


@query("stiffness_error", f"""WITH {BEADS} SELECT trace, {sql_snap('regr_slope(f1, d*1.1-d)/1000/max(k1)','ratio1')}, {sql_snap('regr_slope(f2, d)/1000/max(k2)','ratio2')}
  FROM b WHERE -f1>5 AND f2>5 AND -f1<20 AND f2<20 GROUP BY 1""")
def _stiffness(spark, sf_dir):
    s = calibrated(spark, sf_dir).withColumn("b1", F.col("d") * 1.1)
    out = stats.stiffness_error(s, "k1", "k2", "b1", "d", "f1", "f2", "d")
    return out.select("trace", snap("ratio1").alias("ratio1"), snap("ratio2").alias("ratio2"))


@query("stiffness_change", f"""WITH {CAL} SELECT trace, {sql_snap('CASE WHEN trace%7<>0 THEN k2/k1 END','k1_ratio')} FROM cal""")
def _change(spark, sf_dir):
    cal = sets.stiffness_pivot(calpars(spark, sf_dir)).withColumnRenamed("baseline", "trace")
    after = cal.where("trace % 7 <> 0").select("trace", F.col("k2").alias("k1"))
    return stats.stiffness_change(cal, after, ["k1"]).select("trace", snap("k1_ratio").alias("k1_ratio"))


@query("observed_against_predicted", f"""WITH {DECIMATED}, m AS (SELECT trace, max(d)-min(d) AS o, avg(d) AS p FROM dec GROUP BY 1)
  SELECT trace, {sql_snap('(o-p)/p*100','percent_error')}, {sql_snap('p/o','correction_factor')} FROM m""")
def _observed(spark, sf_dir):
    per = decimated(spark, sf_dir).groupBy("trace").agg((F.max("d") - F.min("d")).alias("dlc_obs"), F.avg("d").alias("dlc_pred"))
    return stats.observed_against_predicted(per).select("trace", *[snap(c).alias(c) for c in ("percent_error", "correction_factor")])


LEGS = SIGNALS + """, tr AS (SELECT trace, i AS pos, row_number() OVER (PARTITION BY trace ORDER BY i)-1 AS k FROM signals WHERE i%20=19),
  lg AS (SELECT trace, k, pos, coalesce(lag(pos) OVER (PARTITION BY trace ORDER BY k),0)+3 AS a FROM tr)"""


@query("start_legs", f"""WITH {LEGS}, sm AS (SELECT lg.trace, lg.k, lg.pos, lg.a, s.i, s.t/1e5 AS d, s.x AS f FROM lg JOIN signals s ON s.trace=lg.trace AND s.i BETWEEN lg.a AND lg.pos),
  g AS (SELECT trace, k, pos+1-a AS m, regr_slope(f,d) FILTER (i>pos-8) AS s, regr_intercept(f,d) FILTER (i>pos-8) AS b, max(d) FILTER (i=pos) AS dl FROM sm GROUP BY trace, k, pos, a)
  SELECT trace, k, {sql_snap('s*dl+b','force')}, {sql_snap('dl','x1')} FROM g WHERE m>8""")
def _start_legs(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True).withColumn("t", F.col("t") / 1e5)
    tr = layout.settle(s.where("i % 20 = 19").select("trace", F.expr("(i - 19) div 20").alias("k"), F.col("i").alias("at")))
    out = legs.start_legs(legs.leg_samples(s, legs.legs(tr, 3), "t", "x"), 8, 3)
    return out.select("trace", "k", snap("force").alias("force"), snap("x1").alias("x1"))


@query("transition_work", f"""WITH {PULLS}, near AS (SELECT trace, i, f, d*0.8 AS d FROM pulls), s AS (SELECT trace, i, (f+lag(f) OVER w)/2*(d-lag(d) OVER w) AS a, d FROM near WINDOW w AS (PARTITION BY trace ORDER BY i)),
  g AS (SELECT trace, sum(a) AS area, min(d) AS lo, max(d) AS hi FROM s GROUP BY 1),
  pt AS (SELECT *, (hi-lo)/9999 AS h, unnest(range(10000)) AS j FROM g), v AS (SELECT trace, area, j, h, lo+j*h AS d FROM pt)
  SELECT trace, {sql_snap('any_value(area)','area')}, {sql_snap('sum((4.11/50)*(0.25/((1-d/1.2)*(1-d/1.2))-0.25+d/1.2)*h*(CASE WHEN j IN (0,9999) THEN 0.5 ELSE 1 END))','model_area')} FROM v GROUP BY 1""")
def _work(spark, sf_dir):
    s = pulls(spark, sf_dir, reuse=True).withColumn("d", F.col("d") * 0.8)
    out = legs.transition_work(s, "d", "f", ((50, 1.2),), 10000)
    return out.select("trace", snap("area").alias("area"), snap("model_area").alias("model_area"))


@query("refit_states", f"""WITH {PULLS}, s AS (SELECT trace, i, d, f2 + 2 AS f, {sql_eps('(f2 + 2)', 50, 1200)} AS e FROM pulls), tr AS (SELECT trace, i // 90 AS k, i AS pos FROM s WHERE i % 90 = 89),
  st AS (SELECT trace, k, 0.5 + 0.1 * k AS state FROM tr), rq AS (SELECT trace, k, k % 3 * 2 AS pad, coalesce(lag(pos) OVER (PARTITION BY trace ORDER BY k), 0) AS prev, pos FROM tr),
  ft AS (SELECT rq.trace, rq.k, sum(d * e) / sum(e * e) AS v FROM rq JOIN s ON s.trace = rq.trace AND s.i BETWEEN prev + pad AND pos WHERE rq.k % 2 = 1 GROUP BY 1, 2),
  nw AS (SELECT st.trace, st.k, coalesce(v, state) AS state FROM st LEFT JOIN ft USING (trace, k))
  SELECT trace, k, {sql_snap('state', 'state')}, {sql_snap('coalesce(lead(state) OVER w - state, 0)', 'dlc')}, {sql_snap('state - first_value(state) OVER w', 'dlc_sum')} FROM nw WINDOW w AS (PARTITION BY trace ORDER BY k)""")
def _refit_states(spark, sf_dir):
    s = pulls(spark, sf_dir, reuse=True).select("trace", "i", "n", "chunk", "d", (F.col("f2") + 2).alias("f"))
    tr = layout.settle(s.where("i % 90 = 89").select("trace", F.expr("i div 90").alias("k"), F.col("i").alias("at")))
    st = tr.select("trace", "k", (0.5 + 0.1 * F.col("k")).alias("state"))
    rq = tr.where("k % 2 = 1").select("trace", "k", F.lit(1).alias("seq"), (F.col("k") % 3 * 2).alias("padding"))
    out = edits.refit_states(s, tr, st, rq, ((50.0, 0.7, 1200.0),), invert=False)
    return out.select("trace", "k", *[snap(c).alias(c) for c in ("state", "dlc", "dlc_sum")])
