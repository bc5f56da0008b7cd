"""Queries on peaks, transitions, rupture, alignment, states and drift."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracespool.catalog.filtering import DECIMATED, decimated
from tracespool.catalog.join_queries import RUPT, with_rupture
from tracespool.catalog.registry import query
from tracespool.catalog.run_queries import LEVELS, levels
from tracespool.catalog.views import PULLS, SIGNALS, pulls, signals, snap, sql_eps, sql_snap, table
from tracespool.operators import align, detect, drift, runs
from tracespool.plans import layout


def peak_sql(src, value, distance, window, threshold):
    """Peaks by islands; thinning decides peaks one by one from the highest down."""
    return f"""pk1 AS (SELECT *, CASE WHEN lag({value}) OVER w={value} THEN 0 ELSE 1 END AS c FROM {src} WINDOW w AS (PARTITION BY trace ORDER BY i)),
     pk2 AS (SELECT *, sum(c) OVER (PARTITION BY trace ORDER BY i) AS r FROM pk1),
     pk3 AS (SELECT trace, r, min(i) AS a, max(i) AS b, min({value}) AS h FROM pk2 GROUP BY 1,2),
     pk4 AS (SELECT *, lag(h) OVER w AS ph, lead(h) OVER w AS nh FROM pk3 WINDOW w AS (PARTITION BY trace ORDER BY r)),
     pk AS (SELECT trace, (a+b)//2 AS pos, h, row_number() OVER (PARTITION BY trace ORDER BY h DESC, (a+b)//2 DESC) AS rk FROM pk4 WHERE ph<h AND nh<h),
     th(trace, rk, kept) AS (SELECT trace, 1::BIGINT, list_value(pk.pos) FROM pk WHERE rk=1 UNION ALL SELECT th.trace, pk.rk,
        CASE WHEN len(list_filter(th.kept, lambda q: abs(q-pk.pos)<{distance}))=0 THEN list_append(th.kept, pk.pos) ELSE th.kept END
        FROM th JOIN pk ON pk.trace=th.trace AND pk.rk=th.rk+1),
     kept AS (SELECT trace, unnest(kept) AS pos FROM (SELECT trace, max_by(kept, rk) AS kept FROM th GROUP BY 1)),
     drops AS (SELECT kept.trace, kept.pos, any_value(pk.h) AS height, any_value(pk.h)-min(s.{value}) AS "drop" FROM kept JOIN pk USING(trace, pos)
       JOIN {src} s ON s.trace=kept.trace AND s.i BETWEEN kept.pos AND kept.pos+{window}-1 GROUP BY 1,2 HAVING any_value(pk.h)-min(s.{value})>{threshold})"""


@query("force_drops", f"""WITH RECURSIVE {SIGNALS}, {peak_sql('signals', 'x', 5, 4, 30)}
  SELECT trace, pos AS at, {sql_snap('height','height')}, {sql_snap('"drop"','size')} FROM drops""")
def _drops(spark, sf_dir):
    out = detect.force_drops(signals(spark, sf_dir, reuse=True), "x", 30, 5, 4)
    return out.select("trace", "at", snap("height").alias("height"), snap("drop").alias("size"))


@query("transitions_by_peaks", f"""WITH RECURSIVE {SIGNALS}, hi AS (SELECT trace, x, i AS src, row_number() OVER (PARTITION BY trace ORDER BY i)-1 AS i FROM signals WHERE x>15),
  {peak_sql('hi', 'x', 5, 5, 20)}, f AS (SELECT d.trace, hi.src AS pos, false AS is_end FROM drops d JOIN hi ON hi.trace=d.trace AND hi.i=d.pos
   UNION ALL SELECT trace, max(n)-1, true FROM signals GROUP BY 1)
  SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY pos)-1 AS k, pos AS at, is_end FROM f""")
def _transitions(spark, sf_dir):
    return detect.transitions(signals(spark, sf_dir, reuse=True), "x", 15, 20, 5, 5)


RUPTURE = RUPT + """, fl AS (SELECT trace, i, n, curve_type, f, CASE curve_type WHEN 'S' THEN n-1-i ELSE i END AS j FROM r),
  e0 AS (SELECT trace, max(n) AS n, min_by(f,j) AS f0, max_by(f,j) AS l0 FROM fl GROUP BY 1),
  ex AS (SELECT trace, j, f FROM fl UNION ALL SELECT trace, -j, 2*f0-f FROM fl JOIN e0 USING(trace) WHERE j BETWEEN 1 AND 3
    UNION ALL SELECT trace, 2*(e0.n-1)-j, 2*l0-f FROM fl JOIN e0 USING(trace) WHERE j BETWEEN e0.n-4 AND e0.n-2),
  sm AS (SELECT c.trace, c.j, c.n, sum((3-abs(x.j-c.j))*x.f)/9 AS s FROM fl c JOIN ex x ON x.trace=c.trace AND x.j BETWEEN c.j-2 AND c.j+2 GROUP BY 1,2,3),
  gr AS (SELECT *, lead(s) OVER w AS nx, CASE WHEN j=0 THEN lead(s) OVER w-s WHEN j=n-1 THEN s-lag(s) OVER w ELSE (lead(s) OVER w-lag(s) OVER w)/2 END AS g
    FROM sm WINDOW w AS (PARTITION BY trace ORDER BY j)),
  li AS (SELECT trace, avg(g)+3*stddev_pop(g) AS lim FROM gr WHERE j BETWEEN 3 AND 60 GROUP BY 1),
  f1 AS (SELECT trace, min(j) AS i0 FROM gr JOIN li USING(trace) WHERE g>lim AND s>20 GROUP BY 1),
  f2 AS (SELECT trace, min(j) AS top FROM gr JOIN f1 USING(trace) WHERE j>=i0 AND coalesce(nx<=s, true) GROUP BY 1),
  f3 AS (SELECT e0.trace, coalesce(top,0) AS j FROM e0 LEFT JOIN f2 USING(trace)),
  f4 AS (SELECT r.trace, CASE r.curve_type WHEN 'S' THEN r.n-1-f3.j ELSE f3.j END AS at FROM r JOIN f3 USING(trace) WHERE r.i=0)"""


@query("tether_rupture", f"""WITH {RUPTURE} SELECT r.trace, min_by(r.i, struct_pack(a:=-r.f, b:=r.i)) AS rupture_index FROM r JOIN f4 USING(trace) WHERE r.i>=f4.at GROUP BY 1""")
def _rupture(spark, sf_dir):
    return detect.tether_rupture(with_rupture(spark, sf_dir), "f", 60, 20.0, 3)


@query("tether_rupture_max_force", f"""WITH {RUPTURE}, g3 AS (SELECT f3.trace, min(gr.j) AS j FROM f3 JOIN gr ON gr.trace=f3.trace AND gr.j>=f3.j AND gr.s<=25 GROUP BY 1)
  SELECT r.trace, CASE r.curve_type WHEN 'S' THEN r.n-1-coalesce(g3.j,r.n-1) ELSE coalesce(g3.j,r.n-1) END AS rupture_index FROM r LEFT JOIN g3 USING(trace) WHERE r.i=0""")
def _rupture_max(spark, sf_dir):
    return detect.tether_rupture(with_rupture(spark, sf_dir), "f", 60, 20.0, 3, max_force=25.0)


@query("cumulative_states", f"""WITH {LEVELS}, s AS (SELECT trace, k, coalesce((lead(level) OVER w-level)/1000,0) AS dlc FROM dw WINDOW w AS (PARTITION BY trace ORDER BY k)),
  c AS (SELECT *, coalesce(sum(dlc) OVER (PARTITION BY trace ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS cum, sum(dlc) OVER (PARTITION BY trace) AS tot FROM s)
  SELECT trace, k, {sql_snap('0.7+cum','from_start')}, {sql_snap('0.9-(tot-cum)','from_end')} FROM c""")
def _states(spark, sf_dir):
    dw = runs.steps(runs.dwells(levels(spark, sf_dir), "level")).select("trace", "k", (F.col("step") / 1000).alias("dlc"))
    dw = layout.settle(dw)
    a = detect.states(dw, F.lit(0.7)).select("trace", "k", snap("state").alias("from_start"))
    b = detect.states(dw, F.lit(0.9), from_end=True).select("trace", "k", snap("state").alias("from_end"))
    return a.join(b, ["trace", "k"])


@query("pauses_of_ideal_trace", f"""WITH {LEVELS}, m AS (SELECT trace, quantile_cont(stop-start,0.5) AS md FROM dw GROUP BY 1),
  t AS (SELECT dw.trace, any_value(md)+2*quantile_cont(abs(stop-start-md),0.5) AS thr FROM dw JOIN m USING(trace) GROUP BY 1)
  SELECT trace, start, stop, level, {sql_snap('thr','threshold')} FROM dw JOIN t USING(trace) WHERE stop-start>thr""")
def _pauses(spark, sf_dir):
    out = detect.ideal_pauses(runs.dwells(levels(spark, sf_dir), "level"), 2.0)
    return out.select("trace", "start", "stop", "level", snap("threshold").alias("threshold"))


@query("align_distance", f"""WITH RECURSIVE {DECIMATED}, tg AS (SELECT *, 0.69*{sql_eps('f',50,1200)} AS x FROM dec),
  w(trace, it, doff, dd) AS (SELECT trace, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM dec GROUP BY 1
   UNION ALL SELECT w.trace, w.it+1, any_value(w.doff)+coalesce(avg(tg.x-tg.d-w.doff) FILTER (tg.d+w.doff>0.3 AND tg.d+w.doff<0.9 AND tg.f>5 AND tg.f<45),0),
     coalesce(avg(tg.x-tg.d-w.doff) FILTER (tg.d+w.doff>0.3 AND tg.d+w.doff<0.9 AND tg.f>5 AND tg.f<45),0) FROM w JOIN tg ON tg.trace=w.trace WHERE w.it<20 AND abs(w.dd)>1e-5 GROUP BY w.trace, w.it)
  SELECT trace, max(it)::INT AS rounds, {sql_snap('max_by(doff,it)','doff')} FROM w GROUP BY 1""")
def _align(spark, sf_dir):
    low = layout.settle(decimated(spark, sf_dir))
    out = align.align(low, ((0.3, 0.9), (5, 45)), model=((50, 0.69, 1200),))
    return out.select("trace", "rounds", snap("doff").alias("doff"))


@query("align_distance_and_force", f"""WITH RECURSIVE {DECIMATED},
  w(trace, it, doff, foff, dd, df) AS (SELECT trace, 0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM dec GROUP BY 1
   UNION ALL SELECT h.trace, h.it+1, any_value(h.doff), any_value(h.foff)+coalesce(avg((4.11/50)*(0.25/((1-(dec.d+h.doff)/1.2)*(1-(dec.d+h.doff)/1.2))-0.25+(dec.d+h.doff)/1.2)-dec.f-h.foff)
       FILTER (dec.d+h.doff>0.3 AND dec.d+h.doff<1.1 AND dec.f+h.foff>0 AND dec.f+h.foff<40),0), any_value(h.dd),
       coalesce(avg((4.11/50)*(0.25/((1-(dec.d+h.doff)/1.2)*(1-(dec.d+h.doff)/1.2))-0.25+(dec.d+h.doff)/1.2)-dec.f-h.foff)
       FILTER (dec.d+h.doff>0.3 AND dec.d+h.doff<1.1 AND dec.f+h.foff>0 AND dec.f+h.foff<40),0)
     FROM (SELECT w.trace, w.it, any_value(w.foff) AS foff, any_value(w.doff)+coalesce(avg(1.2*{sql_eps('(dec.f+w.foff)',50)}-dec.d-w.doff) FILTER (dec.f+w.foff>2 AND dec.f+w.foff<30),0) AS doff,
        coalesce(avg(1.2*{sql_eps('(dec.f+w.foff)',50)}-dec.d-w.doff) FILTER (dec.f+w.foff>2 AND dec.f+w.foff<30),0) AS dd
        FROM w JOIN dec ON dec.trace=w.trace WHERE w.it<20 AND (abs(w.dd)>1e-5 OR abs(w.df)>1e-3) GROUP BY w.trace, w.it) h JOIN dec ON dec.trace=h.trace GROUP BY h.trace, h.it)
  SELECT trace, max(it)::INT AS rounds, {sql_snap('max_by(doff,it)','doff')}, floor(max_by(foff,it)*1e4+0.5)/1e4 AS foff,
    NOT (max_by(abs(dd),it)>1e-5 OR max_by(abs(df),it)>1e-3) AS converged FROM w GROUP BY 1""")
def _align_both(spark, sf_dir):
    low = layout.settle(decimated(spark, sf_dir))
    out = align.align(low, (None, (2, 30)), ((0.3, 1.1), (0, 40)), model=((50, 1.2),))
    return out.select("trace", "rounds", snap("doff").alias("doff"), (F.floor(F.col("foff") * 1e4 + 0.5) / 1e4).alias("foff"), "converged")


@query("velocity_drift", f"""WITH {SIGNALS}, fl AS (SELECT trace, max(n) AS n, min_by(x,i) AS f0, max_by(x,i) AS l0 FROM signals GROUP BY 1),
  ext AS (SELECT trace, i, x FROM signals UNION ALL SELECT trace, -i, 2*f0-x FROM signals JOIN fl USING(trace) WHERE i BETWEEN 1 AND 5
    UNION ALL SELECT trace, 2*(fl.n-1)-i, 2*l0-x FROM signals JOIN fl USING(trace) WHERE i BETWEEN fl.n-6 AND fl.n-2),
  sm AS (SELECT c.trace, c.i, c.n, sum((5-abs(e.i-c.i))*e.x)/25 AS s FROM signals c JOIN ext e ON e.trace=c.trace AND e.i BETWEEN c.i-4 AND c.i+4 GROUP BY 1,2,3),
  v AS (SELECT trace, i, n, (lead(s) OVER (PARTITION BY trace ORDER BY i)-s)*5 AS v FROM sm WHERE i>=5 AND i<n-5),
  m AS (SELECT trace, quantile_cont(v,0.5) AS md FROM v WHERE v IS NOT NULL GROUP BY 1), q AS (SELECT v.trace, any_value(md) AS md, quantile_cont(abs(v-md),0.5) AS mad FROM v JOIN m USING(trace) GROUP BY 1),
  k AS (SELECT v.trace, avg(-v) AS c FROM v JOIN q USING(trace) WHERE v IS NOT NULL AND abs(v-md)<3*mad GROUP BY 1)
  SELECT trace, i, {sql_snap('c*i/5','drift')}, {sql_snap('x+c*i/5','corrected')} FROM signals JOIN k USING(trace)""")
def _velocity(spark, sf_dir):
    out = drift.velocity_drift(signals(spark, sf_dir, reuse=True), "x", 5.0, 1.0, 3.0, 1)
    return out.select("trace", "i", snap("drift").alias("drift"), snap("corrected").alias("corrected"))


@query("passive_drift", f"""WITH {LEVELS}, ps AS (SELECT dw.trace, dw.k, dw.start, dw.stop, a.t AS t_start, b.t AS t_stop FROM dw JOIN signals a ON a.trace=dw.trace AND a.i=dw.start
    JOIN signals b ON b.trace=dw.trace AND b.i=least(dw.stop,dw.n-1) WHERE dw.stop-dw.start>=3),
  mem AS (SELECT s.trace, ps.k, (s.t-z.t)/1e5 AS u, s.x AS y FROM signals s JOIN ps ON ps.trace=s.trace AND s.i>=ps.start AND s.i<ps.stop JOIN signals z ON z.trace=s.trace AND z.i=0
    WHERE s.t>=ps.t_start+10 AND s.t<=ps.t_stop-10),
  dm AS (SELECT *, u-avg(u) OVER (PARTITION BY trace,k) AS du, y-avg(y) OVER (PARTITION BY trace,k) AS dy, count(*) OVER (PARTITION BY trace) AS pts FROM mem),
  g AS (SELECT trace, count(DISTINCT k) AS pauses, count(*) AS points, sum(du*dy)/sum(du*du) AS slope FROM dm GROUP BY 1)
  SELECT trace, pauses, points, {sql_snap('slope','slope')} FROM g WHERE points>1+pauses""")
def _passive(spark, sf_dir):
    s = levels(spark, sf_dir).withColumn("t", F.col("t") / 1e5)
    dw = runs.dwells(s, "level").where("stop - start >= 3")
    ends = s.select("trace", "i", "t")
    modes = (dw.withColumn("last", F.least("stop", F.col("n") - 1))
             .join(ends.select("trace", F.col("i").alias("start"), F.col("t").alias("t_start")), ["trace", "start"])
             .join(ends.select("trace", F.col("i").alias("last"), F.col("t").alias("t_stop")), ["trace", "last"])
             .withColumn("last", F.col("stop")).withColumn("mode", F.lit("pause")))
    fits = drift.passive_drift(s, layout.settle(modes), "t", "x", 1, 1e-4)
    return fits.select("trace", "pauses", "points", snap(F.col("coeffs")[0]).alias("slope"))


@query("set_drift_offsets", f"""WITH o AS (SELECT o_custkey AS base, CASE o_orderkey%4 WHEN 0 THEN 'dct01' WHEN 1 THEN 'spm01' WHEN 2 THEN 'dct02' ELSE 'spm02' END AS run, o_totalprice/1e6 AS v FROM orders),
  t AS (SELECT base, unnest(CASE WHEN run LIKE '%01' THEN ['fecS01','fecS02','fecS03','spm02','dct02'] ELSE ['fecS03'] END) AS run, v FROM o)
  SELECT base, run, {sql_snap('sum(v)','shift')} FROM t GROUP BY 1,2""")
def _set_offsets(spark, sf_dir):
    run = F.expr("case o_orderkey % 4 when 0 then 'dct01' when 1 then 'spm01' when 2 then 'dct02' else 'spm02' end")
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("base"), run.alias("run"), (F.col("o_totalprice") / 1e6).alias("offset"))
    return drift.set_offsets(own).select("base", "run", snap("offset").alias("shift"))


@query("pre_rupture_window", """WITH g AS (SELECT o_custkey AS trace, list_sort(list(o_orderkey)) AS a FROM orders GROUP BY 1)
  SELECT trace, CASE WHEN len(a)=1 THEN 300 WHEN a[-2]+200<=a[-1] THEN a[-2]+200 WHEN a[-2]+12<=a[-1] THEN a[-2]+12 ELSE a[-2]+3 END AS lo, a[-1] AS hi FROM g""")
def _window(spark, sf_dir):
    return align.pre_rupture_window(table(spark, sf_dir, "orders").selectExpr("o_custkey trace", "o_orderkey at"))


@query("realigned_traces", f"""WITH RECURSIVE {DECIMATED}, bx AS (SELECT trace, 0.3 + trace % 4 / 40.0 AS dl, 0.9 AS dh, 5.0 AS fl, 40.0 + trace % 3 AS fh FROM dec WHERE trace % 5 < 2 GROUP BY 1),
  tg AS (SELECT dec.*, 0.69*{sql_eps('f', 50, 1200)} AS x, dl, dh, fl, fh FROM dec JOIN bx USING (trace) WHERE f > 0),
  w(trace, it, doff, dd, hits) AS (SELECT trace, 0, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM bx
   UNION ALL SELECT w.trace, w.it+1, any_value(w.doff)+coalesce(avg(tg.x-tg.d-w.doff) FILTER (tg.d+w.doff>dl AND tg.d+w.doff<dh AND tg.f>fl AND tg.f<fh),0),
     coalesce(avg(tg.x-tg.d-w.doff) FILTER (tg.d+w.doff>dl AND tg.d+w.doff<dh AND tg.f>fl AND tg.f<fh),0), any_value(w.hits)+count(*) FILTER (tg.d+w.doff>dl AND tg.d+w.doff<dh AND tg.f>fl AND tg.f<fh)
   FROM w JOIN tg ON tg.trace=w.trace WHERE w.it<20 AND abs(w.dd)>1e-5 GROUP BY w.trace, w.it),
  o AS (SELECT trace, CASE WHEN max(hits)>0 THEN max_by(doff,it) ELSE 0 END AS doff FROM w GROUP BY 1)
  SELECT dec.trace, dec.i, {sql_snap('dec.d+coalesce(o.doff,0)','d')} FROM dec LEFT JOIN o USING (trace)""")
def _realigned(spark, sf_dir):
    low = layout.settle(decimated(spark, sf_dir))
    boxes = low.where("trace % 5 < 2").select("trace").distinct().select("trace", F.lit(1).alias("seq"), (0.3 + F.col("trace") % 4 / 40).alias("d_lo"),
        F.lit(0.9).alias("d_hi"), F.lit(5.0).alias("f_lo"), (40.0 + F.col("trace") % 3).alias("f_hi"))
    out, _ = align.realign_traces(low, boxes, ((50, 0.69, 1200),))
    return out.select("trace", "i", snap("d").alias("d"))
