"""Queries on calibration, sets, time joins and elementwise physics."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracespool.catalog.registry import query
from tracespool.catalog.views import PULLS, SIGNALS, pulls, signals, snap, sql_eps, sql_snap, table
from tracespool.functions import kinetics, physics, wlc
from tracespool.operators import sets, timejoin
from tracespool.plans import layout
from tracespool.sources import scan

CAL = """cal AS (SELECT s_suppkey AS trace, 0.2+(s_nationkey+1)/100.0::DOUBLE AS k1, 0.25+(s_nationkey+1)/120.0::DOUBLE AS k2 FROM supplier)"""


def calpars(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    traps = F.array(F.struct(F.lit("trap1").alias("trap"), (0.2 + (F.col("s_nationkey") + 1) / 100).alias("kappa")),
                    F.struct(F.lit("trap2").alias("trap"), (0.25 + (F.col("s_nationkey") + 1) / 120).alias("kappa")))
    return s.select(F.col("s_suppkey").alias("baseline"), F.explode(traps).alias("t")).select("baseline", "t.*")


def calibrated(spark, sf_dir):
    cal = sets.stiffness_pivot(calpars(spark, sf_dir)).withColumnRenamed("baseline", "trace")
    return layout.salted(pulls(spark, sf_dir), cal, ["trace"], salt="i")


@query("stiffness_lookup", f"WITH {CAL} SELECT trace AS baseline, {sql_snap('k1','k1')}, {sql_snap('k2','k2')} FROM cal")
def _cal(spark, sf_dir):
    return sets.stiffness_pivot(calpars(spark, sf_dir)).select("baseline", snap("k1").alias("k1"), snap("k2").alias("k2"))


BEADS = PULLS + f", {CAL}, b AS (SELECT *, 1/(1/k1+1/k2) AS keq, f2/k2-f1/k1 AS dx FROM pulls JOIN cal USING(trace))"


@query("bead_signals", f"""WITH {BEADS} SELECT trace, i, {sql_snap('keq','keq')}, {sql_snap('f1/k1','x1')}, {sql_snap('f2/k2','x2')},
  {sql_snap('dx','dx')}, {sql_snap('keq*dx','diff_f')} FROM b""")
def _beads(spark, sf_dir):
    b = calibrated(spark, sf_dir).select("trace", "i", physics.bead_signals(
        *[F.col(c) for c in ("f1", "f2", "k1", "k2")]).alias("b"))
    return b.select("trace", "i", *[snap(f"b.{c}").alias(c) for c in ("keq", "x1", "x2", "dx", "diff_f")])


@query("molecular_extension", f"""WITH {BEADS} SELECT trace, i, {sql_snap('d-dx/1000','ext')}, {sql_snap('0.1+0.9*d-0.02*d*d-dx/1000','cal_ext')},
  {sql_snap('d+f1/k1/1000+f1/k2/1000','d1')}, {sql_snap('d-f2/k1/1000-f2/k2/1000','d2')} FROM b""")
def _ext(spark, sf_dir):
    f1, f2, k1, k2, d = [F.col(c) for c in ("f1", "f2", "k1", "k2", "d")]
    dx = physics.bead_signals(f1, f2, k1, k2)["dx"]
    poly = F.array(F.lit(0.1), F.lit(0.9), F.lit(-0.02))
    ch = physics.channel_extensions(d, f1, f2, k1, k2)
    return calibrated(spark, sf_dir).select(
        "trace", "i", snap(physics.molecular_extension(d, dx)).alias("ext"),
        snap(physics.molecular_extension(d, dx, poly)).alias("cal_ext"), snap(ch["d1"]).alias("d1"), snap(ch["d2"]).alias("d2"))


@query("recalibrated_extension", f"WITH {BEADS} SELECT trace, i, {sql_snap('(1000*d-f2/(k2*1.07)+f1/(k1*1.07))/1000','ext')} FROM b")
def _recal(spark, sf_dir):
    c = 1.07
    dx = physics.bead_signals(F.col("f1"), F.col("f2"), F.col("k1") * c, F.col("k2") * c)["dx"]
    return calibrated(spark, sf_dir).select("trace", "i", snap(physics.molecular_extension(F.col("d"), dx)).alias("ext"))


@query("extension_at_force", f"""WITH {PULLS} SELECT trace, i, {sql_snap('0.69*' + sql_eps('f',50,1200) + '+0.013*' + sql_eps('f',0.65),'x')},
  {sql_snap('0.69*(1-0.5*sqrt(4.11/(f*50))+f/1200)','odijk')}, {sql_snap(sql_eps('f',50),'eps')} FROM pulls""")
def _extension(spark, sf_dir):
    f = F.col("f")
    return pulls(spark, sf_dir).select(
        "trace", "i", snap(wlc.extension(f, (50, 0.69, 1200), (0.65, 0.013))).alias("x"),
        snap(wlc.extension(f, (50, 0.69, 1200), approx="odijk")).alias("odijk"),
        snap(wlc.relative_extension(f, 50)).alias("eps"))


@query("range_trim", f"WITH {PULLS} SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY i)-1 AS i, i AS src, "
       "count(*) OVER (PARTITION BY trace) AS n FROM pulls WHERE d>0.2 AND d<0.8 AND f>3 AND f<40")
def _trim(spark, sf_dir):
    keep = physics.box(F.col("d"), F.col("f"), (0.2, 0.8), (3, 40))
    return layout.reindex(pulls(spark, sf_dir, reuse=True).where(keep), keep="src").select("trace", "i", "src", "n")


@query("baseline_subtract", f"WITH {PULLS} SELECT trace, i, {sql_snap('f-(0.5+0.25*d-0.125*d*d)','f')} FROM pulls")
def _subtract(spark, sf_dir):
    df = pulls(spark, sf_dir).withColumn("c", F.array(F.lit(0.5), F.lit(0.25), F.lit(-0.125)))
    return sets.subtract_baseline(df, "f", "d", "c").select("trace", "i", snap("f").alias("f"))


@query("zero_initial_window", f"""WITH {SIGNALS}, o AS (SELECT trace, avg(CASE WHEN t<=200000 THEN x END) AS off FROM signals GROUP BY 1)
  SELECT trace, i, {sql_snap('x-off','x')} FROM signals JOIN o USING(trace)""")
def _zero_initial(spark, sf_dir):
    out = sets.zero_initial(signals(spark, sf_dir, reuse=True), "t", ["x"], 200000)
    return out.select("trace", "i", snap("x").alias("x"))


@query("zero_final_window", f"""WITH {SIGNALS}, e AS (SELECT trace, max(t) AS te FROM signals GROUP BY 1),
  o AS (SELECT trace, avg(x) AS off FROM signals JOIN e USING(trace) WHERE t>=te-200000 GROUP BY 1)
  SELECT trace, i, {sql_snap('CASE WHEN abs(off)<45 THEN x-off ELSE x END','x')} FROM signals JOIN o USING(trace)""")
def _zero_final(spark, sf_dir):
    out = sets.zero_final(signals(spark, sf_dir, reuse=True), "t", ["x"], 200000, 45)
    return out.select("trace", "i", snap("x").alias("x"))


RUPT = PULLS + """, r AS (SELECT *, CASE WHEN trace%2=0 THEN 'S' ELSE 'R' END AS curve_type, (n*3)//4 AS rupture_index FROM pulls)"""


def with_rupture(spark, sf_dir):
    return pulls(spark, sf_dir, reuse=True).select(
        "*", F.expr("if(trace % 2 = 0, 'S', 'R')").alias("curve_type"), F.expr("(n * 3) div 4").alias("rupture_index"))


@query("trim_at_rupture", f"""WITH {RUPT} SELECT trace, src, row_number() OVER (PARTITION BY trace ORDER BY src)-1 AS i, count(*) OVER (PARTITION BY trace) AS n
  FROM (SELECT trace, i AS src FROM r WHERE CASE curve_type WHEN 'S' THEN i<=rupture_index ELSE i>=rupture_index END)""")
def _at_rupture(spark, sf_dir):
    return sets.at_rupture(with_rupture(spark, sf_dir)).select("trace", "src", "i", "n")


@query("flip_relax", f"WITH {RUPT} SELECT trace, CASE curve_type WHEN 'R' THEN n-1-i ELSE i END AS i, {sql_snap('d','d')} FROM r")
def _flip(spark, sf_dir):
    out = sets.flip(with_rupture(spark, sf_dir), F.col("curve_type") == "R")
    return out.select("trace", "i", snap("d").alias("d"))


@query("accumulated_offsets", f"""WITH {PULLS}, o AS (SELECT o_custkey AS trace, sum(o_totalprice/1e6) AS doff, sum(o_totalprice/1e5) AS foff FROM orders GROUP BY 1)
  SELECT trace, i, {sql_snap('d+coalesce(doff,0)','d')}, {sql_snap('f+coalesce(foff,0)','f')} FROM pulls LEFT JOIN o USING(trace)""")
def _offsets(spark, sf_dir):
    off = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey trace", "o_totalprice / 1e6 doff", "o_totalprice / 1e5 foff")
    out = sets.apply_offsets(pulls(spark, sf_dir), off, {"d": "doff", "f": "foff"})
    return out.select("trace", "i", snap("d").alias("d"), snap("f").alias("f"))


@query("unit_maps", f"""WITH {PULLS} SELECT trace, i, {sql_snap('d*1000/0.34','bp')}, {sql_snap('2*4.76*sin(f/(2*4.76))','chord')},
  {sql_snap('2*4.76*cos(((1.65*2*pi())/145)/(2*0.34)*f)','peel')}, {sql_snap('sqrt(2*50*f*(1-50/f*(1-exp(-f/50))))','rms')},
  {sql_snap('0.01380649*(273.15+f)','kt')}, i*25+25 AS hf, CAST(floor(i/25.0) AS BIGINT)-25 AS lf, {sql_snap('10*log10(f/d)','gain')} FROM pulls""")
def _units(spark, sf_dir):
    d, f, i = F.col("d"), F.col("f"), F.col("i")
    return pulls(spark, sf_dir).select(
        "trace", "i", snap(physics.um_to_bp(d)).alias("bp"), snap(physics.chord(f)).alias("chord"),
        snap(physics.peeling_term(f, 4.76)).alias("peel"), snap(physics.rms_end_to_end(f, 50)).alias("rms"),
        snap(physics.thermal_energy(273.15 + f)).alias("kt"), physics.fine_index(i, 25).alias("hf"),
        physics.coarse_index(i, 25).alias("lf"), snap(physics.power_gain(d, f)).alias("gain"))


@query("stride_subsample", f"WITH {SIGNALS} SELECT trace, i, x FROM signals WHERE i % CAST(ceil(n/20.0) AS BIGINT)=0")
def _subsample(spark, sf_dir):
    return sets.subsample(signals(spark, sf_dir), 20).select("trace", "i", "x")


@query("trace_bounds", f"WITH {PULLS} SELECT trace, min(d) AS d_min, max(d) AS d_max, min(f) AS f_min, max(f) AS f_max FROM pulls GROUP BY 1")
def _bounds(spark, sf_dir):
    return sets.bounds(pulls(spark, sf_dir), "d", "f")


@query("calibration_range", """WITH e AS (SELECT o_custkey%50 AS baseline, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
  b AS (SELECT c_custkey%40 AS baseline, min(c_acctbal*40) AS lo, max(c_acctbal*40) AS hi FROM customer GROUP BY 1)
  SELECT e.baseline, greatest(e.lo, coalesce(b.lo,e.lo)) AS lo, least(e.hi, coalesce(b.hi,e.hi)) AS hi FROM e LEFT JOIN b USING(baseline)""")
def _range(spark, sf_dir):
    ramps = table(spark, sf_dir, "orders").selectExpr("o_custkey % 50 baseline", "o_totalprice pos")
    own = table(spark, sf_dir, "customer").selectExpr("c_custkey % 40 baseline", "c_acctbal * 40 pos")
    return sets.calibration_range(ramps, own, "pos")


@query("baseline_join", f"""WITH {CAL}, {PULLS}, c AS (SELECT * FROM cal WHERE trace%10<>3)
  SELECT trace, i, {sql_snap('c.k1','k1')}, CASE WHEN c.k1 IS NULL THEN 1 ELSE 0 END AS error_code FROM pulls LEFT JOIN c USING(trace)""")
def _baseline(spark, sf_dir):
    cal = sets.stiffness_pivot(calpars(spark, sf_dir)).where("baseline % 10 <> 3")
    out = sets.with_baseline(pulls(spark, sf_dir).withColumn("baseline", F.col("trace")), cal)
    return out.select("trace", "i", snap("k1").alias("k1"), "error_code")


@query("kept_semi_anti", """SELECT 'kept' AS part, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal>0)
  UNION ALL SELECT 'discarded', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal>0)""")
def _semi(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey trace")
    keep = table(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey trace").distinct()
    kept = rows.join(keep, "trace", "left_semi").agg(F.count("*").alias("n")).select(F.lit("kept").alias("part"), "n")
    gone = rows.join(keep, "trace", "left_anti").agg(F.count("*").alias("n")).select(F.lit("discarded").alias("part"), "n")
    return kept.unionAll(gone)


@query("representative_offsets", f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
  rep AS (SELECT o_custkey, o_totalprice/1e6 AS off, o_orderstatus AS st FROM m WHERE r=1)
  SELECT m.o_orderkey AS trace, {sql_snap('rep.off','set_off')}, rep.st AS set_st FROM m LEFT JOIN rep USING(o_custkey)""")
def _representative(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey base", "o_orderkey trace", "o_orderstatus st", "o_totalprice / 1e6 off", "o_orderdate day")
    # the latest recording plays the representative run
    last = o.groupBy("base").agg(F.max_by("trace", F.struct("day", "trace")).alias("rep"))
    runs_ = layout.salted(o, last, ["base"]).withColumn("run", F.when(F.col("trace") == F.col("rep"), "fecS03").otherwise("fecS00"))
    out = sets.from_representative(runs_, "base", "run", "fecS03", ["off", "st"])
    return out.select("trace", snap("set_off").alias("set_off"), "set_st")


@query("latest_decision", """WITH d AS (SELECT o_custkey AS trace, o_orderstatus AS st, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r
    FROM orders WHERE o_orderpriority LIKE '1%')
  SELECT c_custkey AS trace, coalesce(d.st,'auto') AS st, coalesce(d.v,c_acctbal) AS v FROM customer LEFT JOIN d ON d.trace=c_custkey AND d.r=1""")
def _decision(spark, sf_dir):
    auto = table(spark, sf_dir, "customer").selectExpr("c_custkey trace", "'auto' st", "c_acctbal v")
    dec = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").selectExpr(
        "o_custkey trace", "o_orderkey seq", "o_orderstatus st", "o_totalprice v")
    return sets.latest_decision(auto, dec, ["st", "v"])


@query("concatenate_traces", f"""WITH {SIGNALS}, a AS (SELECT trace, i, x, n FROM signals WHERE lab IS NOT NULL),
   s AS (SELECT trace, n FROM signals WHERE i=0)
  SELECT trace, i, 0 AS part, x FROM a UNION ALL SELECT trace, i+n, 1, -x-1 FROM a""")
def _concat(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True).select("trace", "i", "n", "chunk", "x")
    return sets.concatenate(s, s.withColumn("x", -F.col("x") - 1)).select("trace", "i", "part", "x")


@query("closest_row", f"WITH {PULLS} SELECT trace, min_by(i, struct_pack(a:=abs(f-7.3), b:=i)) AS at, "
       "min_by(d, struct_pack(a:=abs(f-7.3), b:=i)) AS d FROM pulls WHERE d>0.3 GROUP BY 1")
def _closest(spark, sf_dir):
    out = sets.closest(pulls(spark, sf_dir), ["trace"], "f", 7.3, ["i", "d"], F.col("d") > 0.3)
    return out.select("trace", F.col("i").alias("at"), "d")


@query("argmax_after_index", f"WITH {PULLS} SELECT trace, min(i) AS at, max(d) AS extreme FROM "
       "(SELECT *, max(d) OVER (PARTITION BY trace) AS m FROM pulls WHERE i>=100) WHERE d=m GROUP BY 1")
def _argmax(spark, sf_dir):
    return sets.arg_extreme(pulls(spark, sf_dir), "d", F.col("i") >= 100)


@query("distinct_baselines", """SELECT DISTINCT o_custkey%97 AS baseline FROM orders UNION SELECT user_id%97 FROM events""")
def _distinct(spark, sf_dir):
    a = table(spark, sf_dir, "orders").selectExpr("o_custkey % 97 baseline")
    b = table(spark, sf_dir, "events").selectExpr("user_id % 97 baseline")
    return scan.union_sources(a, b).distinct()


GRID = SIGNALS + """, sp AS (SELECT trace, min(t) AS lo, max(t) AS hi FROM signals GROUP BY 1),
  gr AS (SELECT trace, j, lo + j*3600.0 AS t FROM (SELECT trace, lo, unnest(range(CAST(floor((hi-lo)/3600.0) AS BIGINT)+1)) AS j FROM sp))"""


def grid(samples):
    span = samples.groupBy("trace").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return span.select("trace", "lo", F.explode(F.expr("sequence(0L, cast(floor((hi - lo) / 3600.0D) as bigint))")).alias("j")).select(
        "trace", "j", (F.col("lo") + F.col("j") * 3600.0).alias("t"))


@query("nearest_in_time", f"""WITH {GRID}, c AS (SELECT gr.trace, gr.j, s.i, row_number() OVER (PARTITION BY gr.trace, gr.j ORDER BY abs(s.t-gr.t), s.t) AS r
    FROM gr JOIN signals s USING(trace)) SELECT trace, j, i FROM c WHERE r=1""")
def _nearest(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    return timejoin.nearest(grid(s), s, "t", ["i"]).select("trace", "j", "i")


@query("exact_time_subset", f"WITH {SIGNALS} SELECT trace, i AS at, x FROM signals WHERE i%3=0")
def _subset(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    kept = s.where("i % 3 = 0").select("trace", (F.col("t") + 1e-9).alias("t"))
    return timejoin.exact_subset(kept, s.withColumn("at", F.col("i")), "t", ["at", "x"], 1.0).where(
        "src_t is not null").select("trace", "at", "x")


@query("retained_regions", f"""WITH {GRID}, sv AS (SELECT *, lag(t) OVER (PARTITION BY trace ORDER BY j) AS pt FROM gr WHERE j%17 NOT IN (4,5,6) ),
   rg AS (SELECT *, sum(CASE WHEN pt IS NULL OR t-pt>1.5*3600 THEN 1 ELSE 0 END) OVER (PARTITION BY trace ORDER BY j) AS k FROM sv),
   sp2 AS (SELECT trace, k, min(t)-1800 AS lo, max(t)+1800 AS hi FROM rg GROUP BY 1,2)
  SELECT s.trace, s.i FROM signals s JOIN sp2 ON s.trace=sp2.trace AND s.t>=sp2.lo AND s.t<=sp2.hi""")
def _regions(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    saved = layout.with_chunk(grid(s).where("j % 17 not in (4, 5, 6)").withColumn("i", F.col("j")))
    spans = timejoin.regions(saved, "t", 3600.0)
    return timejoin.within_regions(s, spans, "t").select("trace", "i")


@query("frame_average", f"""WITH {GRID}, fr AS (SELECT *, lead(t) OVER (PARTITION BY trace ORDER BY j) AS t2 FROM gr)
  SELECT fr.trace, fr.j, {sql_snap('avg(s.x)','x')}, count(*) AS points FROM fr JOIN signals s ON s.trace=fr.trace AND s.t>=fr.t AND s.t<fr.t2 GROUP BY 1,2""")
def _frames(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    out = timejoin.frame_average(grid(s), s, "t", ["x"])
    return out.select("trace", "j", snap("x").alias("x"), "points")


@query("interpolate_on_grid", f"""WITH {GRID}, nx AS (SELECT *, lead(t) OVER (PARTITION BY trace ORDER BY i) AS t2, lead(x) OVER (PARTITION BY trace ORDER BY i) AS x2 FROM signals)
  SELECT gr.trace, gr.j, {sql_snap('CASE WHEN nx.t=gr.t THEN nx.x ELSE nx.x+(gr.t-nx.t)/(nx.t2-nx.t)*(nx.x2-nx.x) END','x')} FROM gr JOIN nx ON nx.trace=gr.trace AND gr.t>=nx.t AND (gr.t<nx.t2 OR nx.t2 IS NULL)""")
def _interpolate(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    out = timejoin.interpolate(grid(s), s, "t", "x")
    return out.select("trace", "j", snap("x").alias("x"))


@query("transition_rates", f"""WITH {PULLS} SELECT trace, i, {sql_snap('0.01*exp(f*0.5/(0.01380649*298.15))','bell')},
  {sql_snap('CASE WHEN f<30 THEN 0.01*pow(1-0.5*f*0.5/(20*0.01380649*298.15),0)*exp(20*(1-pow(1-0.5*f*0.5/(20*0.01380649*298.15),2))) END','chs')},
  {sql_snap('pi()/sqrt(6)*0.01380649*298.15/f','xd')}, {sql_snap('d*f*0.5/(0.01380649*298.15)*exp(-f*0.5/(0.01380649*298.15))','k0')} FROM pulls""")
def _rates(spark, sf_dir):
    f = F.col("f")
    return pulls(spark, sf_dir).select(
        "trace", "i", snap(kinetics.bell_rate(f, 0.01, 0.5)).alias("bell"),
        F.when(f < 30, snap(kinetics.chs_rate(f, 0.01, 0.5, 20))).alias("chs"),
        snap(kinetics.guess_x_dagger(f)).alias("xd"),
        snap(kinetics.guess_k0(f, F.col("d") * f, F.lit(0.5))).alias("k0"))
