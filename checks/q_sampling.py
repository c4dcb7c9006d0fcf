"""Split, resampling, synthetic and noise queries."""

import math

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import table, using, view
from halocline.operators import noise as N, sampling as D


def obs(spark, sf):
    return view(spark, sf, "obs")


def uni(seed, *keys):
    """DuckDB text of the hash uniform."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT / {float(16**13)!r}::DOUBLE)"


def nrm(seed, *keys):
    return f"(sqrt(-2e0*ln(1e0-{uni(seed, *keys)}))*cos(2e0*pi()*{uni(seed + 1, *keys)}))"


TRAIN, VALID, TEST = [77, 69, 83, 78], [87, 72, 71], [68, 67, 73]


@query("d1_split_by_group", using("obs") + f"""SELECT event_id, CASE WHEN pcode IN {tuple(TRAIN)} THEN 'train'
  WHEN pcode IN {tuple(VALID)} THEN 'valid' ELSE 'test' END AS role FROM obs""", keys="*")
def d1(spark, sf):
    return D.split_by_group(obs(spark, sf), TRAIN, VALID, TEST).select("event_id", "role")


@query("d1_split_counts", using("obs") + f"""SELECT CASE WHEN pcode IN {tuple(TRAIN)} THEN 'train'
  WHEN pcode IN {tuple(VALID)} THEN 'valid' ELSE 'test' END AS role, count(*) AS n FROM obs GROUP BY 1""", keys="*")
def d1b(spark, sf):
    return D.role_counts(D.split_by_group(obs(spark, sf), TRAIN, VALID, TEST))


@query("d2_split_random", using("obs") + """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY
    substr(md5('7:' || event_id), 1, 12), event_id) <= floor((SELECT count(*) FROM obs)*0.2e0) THEN 'valid' ELSE 'train' END AS role FROM obs""",
       keys="*")
def d2(spark, sf):
    return D.split_random(obs(spark, sf), "event_id", 7, 0.2).select("event_id", "role")


@query("d3_weighted_resample", using("obs") + f"""
  , e AS (SELECT event_id, sum(weight) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)/(SELECT sum(weight) FROM obs) AS hi FROM obs),
  d AS (SELECT {uni(3, 'event_id')} AS u FROM obs)
  SELECT event_id, count(*) AS copies FROM (SELECT e.event_id FROM d ASOF JOIN e ON d.u < e.hi) GROUP BY event_id""", keys="*")
def d3(spark, sf):
    o = obs(spark, sf)
    return D.resample_rows(o, "event_id", o.count(), 3, "weight", expand=False).select("event_id", "copies")


@query("d6_synthetic_fluxes", f"""WITH s AS (SELECT event_id, 5e0*sqrt(-2e0*ln(1e0-{uni(11, 'event_id')})) AS u,
    -0.8e0+0.8e0*{nrm(12, 'event_id')} AS dt FROM events)
  SELECT event_id, u, dt, 1.5e-3*u*u AS tau_mean, 0.2e0*1.5e-3*u*u+1e-2 AS tau_std, u*dt AS heat_mean, 0.15e0*abs(u*dt)+1e0 AS heat_std,
    1.5e-3*u*u + (0.2e0*1.5e-3*u*u+1e-2)*{nrm(14, 'event_id')} AS tau, u*dt + (0.15e0*abs(u*dt)+1e0)*{nrm(16, 'event_id')} AS heat FROM s""",
       keys="event_id")
def d6(spark, sf):
    return D.synthetic_fluxes(table(spark, sf, "events"), "event_id", 11)


@query("d7_synthetic_sine", f"""WITH s AS (SELECT event_id, (2e0*{uni(21, 'event_id')}-1e0)*pi() AS x FROM events)
  SELECT event_id, x, sin(x) AS y_mean, 0.1e0*pow(cos(x),2) AS y_std, sin(x)+0.1e0*pow(cos(x),2)*{nrm(22, 'event_id')} AS y FROM s""", keys="event_id")
def d7(spark, sf):
    return D.synthetic_sine(table(spark, sf, "events"), "event_id", 0.1, 21)


@query("d8_feature_grid", using("obs") + """, b AS (SELECT pcode, avg(rh) AS rh, avg(p) AS p FROM obs GROUP BY pcode)
  SELECT pcode, rh, p, i*3e1/200 AS U, j*2e1/100 AS tair, 1e1 AS tsea FROM b CROSS JOIN range(201) a(i) CROSS JOIN range(101) c(j)""",
       keys="pcode", digits=5)
def d8(spark, sf):
    base = obs(spark, sf).groupBy("pcode").agg(F.avg("rh").alias("rh"), F.avg("p").alias("p"))
    return D.feature_grid(base, D.GRID_U_DT["axes"], {"tsea": 10.0})


def _ar(alpha, members, seed, sd, reach):
    """Red noise as a truncated sum over the innovations of the same series."""
    return f"""ix AS (SELECT event_id, row_number() OVER (ORDER BY time, event_id) - 1 AS i, {sd} AS sd FROM obs),
  b AS (SELECT m::INT AS ensem, i, event_id, CASE WHEN i = 0 THEN 1e0 ELSE {math.sqrt(1 - alpha * alpha)!r}::DOUBLE END*sd*{nrm(seed, 'i', 'm')} AS b
     FROM ix CROSS JOIN range(1, {members + 1}) t(m)),
  e AS (SELECT c.ensem, c.event_id, sum(p.b*pow({alpha!r}::DOUBLE, c.i-p.i)) AS eps FROM b c JOIN b p
     ON p.ensem = c.ensem AND p.i <= c.i AND p.i > c.i - {reach} GROUP BY c.ensem, c.event_id)"""


@query("w12_red_noise", using("obs", extra=_ar(0.9, 3, 31, "sqrt(pred_var)", 420)) + "SELECT * FROM e", keys="ensem, event_id", digits=8)
def w12(spark, sf):
    o = obs(spark, sf).select("event_id", "time", "pred_var")
    return N.red_noise(o, F.sqrt("pred_var"), 0.9, 3, 31, "time", "event_id", ["event_id"]).select("ensem", "event_id", "eps")


GAP = "CASE WHEN event_id % 997 <> 500 THEN sqrt(pred_var) END"


@query("w12_missing_std", using("obs", extra=_ar(0.9, 3, 31, f"coalesce({GAP}, 0)", 420) + f""", g AS (SELECT min(i) AS gone FROM
     (SELECT row_number() OVER (ORDER BY time, event_id) - 1 AS i, {GAP} AS sd FROM obs) WHERE sd IS NULL)""") +
       "SELECT ensem, event_id, CASE WHEN gone IS NULL OR i < gone THEN eps END AS eps FROM e JOIN ix USING (event_id) CROSS JOIN g", keys="ensem, event_id", digits=8)
def w12_missing(spark, sf):
    o = obs(spark, sf).select("event_id", "time", "pred_var")
    std = F.when(F.col("event_id") % 997 != 500, F.sqrt("pred_var"))
    return N.red_noise(o, std, 0.9, 3, 31, "time", "event_id", ["event_id"]).select("ensem", "event_id", "eps")


@query("w13_heat_noise", using("obs", extra=_ar(1 - 3 / 10, 2, 41, "sqrt(pow(1e0+rh/1e2,2)+pow(2e0+lat/1e2,2))", 130)) +
       "SELECT ensem, event_id, eps AS eps_heat FROM e", keys="ensem, event_id", digits=7)
def w13(spark, sf):
    o = obs(spark, sf).select("event_id", "time", (1 + F.col("rh") / 100).alias("qh_std"), (2 + F.col("lat") / 100).alias("ql_std"))
    noisy = N.red_noise(o, N.noise_scale("heat"), 1 - 3 / 10, 2, 41, "time", "event_id", ["event_id"], "eps_heat")
    return noisy.select("ensem", "event_id", "eps_heat")


@query("w13_white_noise", using("obs", extra=_ar(0.0, 2, 51, "sqrt(pred_var)", 1)) +
       "SELECT ensem, event_id, eps AS eps_taux FROM e", keys="ensem, event_id", digits=8)
def w13b(spark, sf):
    o = obs(spark, sf).select("event_id", "time", F.sqrt("pred_var").alias("taux_std"))
    ids = o.select("time", "event_id")
    return N.flux_noise(o, "taux", 3.0, 3.0, 2, 51, "time", "event_id").join(ids, "time").select("ensem", "event_id", "eps_taux")


@query("m13_draw", using("obs") + f"SELECT event_id, pred_mean + sqrt(pred_var)*{nrm(61, 'event_id')} AS sample FROM obs", keys="event_id")
def m13(spark, sf):
    return N.draw(obs(spark, sf), "pred_mean", "pred_var", "event_id", 61).select("event_id", "sample")
