"""Series and window queries."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import using, view
from halocline.operators import quality as Q, series as S

SERIES = "series AS (SELECT date_trunc('hour', time) AS time, avg(taucx) AS x, avg(U) AS u FROM obs GROUP BY 1)"


def obs(spark, sf):
    return view(spark, sf, "obs")


def hourly(spark, sf):
    return S.resample_mean(obs(spark, sf).withColumnsRenamed({"taucx": "x", "U": "u"}), "time", "1 hour", ["x", "u"])


@query("a14_resample_hourly", using("obs", extra=SERIES) + "SELECT * FROM series", keys="time")
def a14(spark, sf):
    return hourly(spark, sf)


@query("a14_resample_by_group", using("obs") + """
  , b AS (SELECT pcode, time_bucket(INTERVAL 3 HOUR, time, TIMESTAMP '1970-01-01') AS time, avg(U) AS U FROM obs GROUP BY 1, 2),
  e AS (SELECT pcode, min(time) AS a, max(time) AS z FROM b GROUP BY pcode),
  s AS (SELECT pcode, unnest(range(a, z + INTERVAL 1 HOUR, INTERVAL 3 HOUR)) AS time FROM e)
  SELECT pcode, time, U FROM s LEFT JOIN b USING (pcode, time)""", keys="pcode, time")
def a14b(spark, sf):
    return S.resample_mean(obs(spark, sf), "time", "3 hours", ["U"], ["pcode"], fill=True)


@query("a14_resample_monthly", using("cases") +
       "SELECT flux, date_trunc('month', ts)::TIMESTAMP AS ts, avg(sst) AS sst FROM cases GROUP BY 1, 2", keys="flux, ts")
def a14c(spark, sf):
    return S.resample_mean(view(spark, sf, "cases"), "ts", "month", ["sst"], ["flux"])


@query("a20_interannual_std", using("cases") + """SELECT CAST(m AS INT) AS month, stddev_pop(sst) AS sst_std, stddev_pop(mld) AS mld_std
  FROM (SELECT year(ts) AS y, month(ts) AS m, avg(sst) AS sst, avg(mld) AS mld FROM cases GROUP BY 1, 2) GROUP BY m""", keys="month")
def a20(spark, sf):
    return S.interannual_std(view(spark, sf, "cases"), "ts", ["sst", "mld"])


@query("a25_coarsen", using("grid") + """SELECT ts, avg(lat) AS lat, avg(lon) AS lon, avg(sst) AS sst, avg(phs0) AS phs0
  FROM grid GROUP BY ts, floor((lat + 60)/5/2), floor(lon/10/2)""", keys="ts", digits=7)
def a25(spark, sf):
    return S.coarsen(view(spark, sf, "grid"), {"lat": (-60.0, 5.0), "lon": (0.0, 10.0)}, 2, ["sst", "phs0"], ["ts"])


@query("a29_time_mean", using("grid") + """SELECT lat, lon, avg(phs0) AS phs0, avg(phs0 - plp0) AS diff FROM grid
  WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' GROUP BY lat, lon""", digits=7)
def a29(spark, sf):
    g = Q.time_slice(view(spark, sf, "grid"), "2024-01-03", "2024-01-19", "ts")
    return S.time_mean(g, {"phs0": F.col("phs0"), "diff": F.col("phs0") - F.col("plp0")})


@query("a30_net_heat", using("obs") + "SELECT event_id, hsc + hlc AS q_net FROM obs", keys="event_id")
def a30(spark, sf):
    return obs(spark, sf).select("event_id", S.net_heat("hsc", "hlc").alias("q_net"))


# Track of each cruise: the position follows the day of the month, so it jumps at midnight.
TRACK = """track AS (SELECT event_id, time, pcode, hlc, hlb,
    -6e1 + 4e0*day(time) AS lat, -18e1 + 4e1*(day(time) % 9) AS lon FROM obs)"""


def track(spark, sf):
    return obs(spark, sf).select("event_id", "time", "pcode", "hlc", "hlb", (-60.0 + 4.0 * F.day("time")).alias("lat"),
                                 (-180.0 + 40.0 * (F.day("time") % 9)).alias("lon"))


def breaks_sql(view_name, gap, deg, strict=False):
    wrap = "abs(nlon-lon)" if strict else "CASE WHEN abs(nlon-lon) > 180 THEN 360-abs(nlon-lon) ELSE abs(nlon-lon) END"
    cond = f"date_diff('microsecond', time, nt)/6e7 > {gap}"
    if strict:
        cond = f"(pt IS NOT NULL AND (({cond} AND date_diff('microsecond', pt, time) > 0) OR abs(nlat-lat) > {deg} OR {wrap} > {deg}))"
    else:
        cond = f"({cond} OR abs(nlat-lat) > {deg} OR {wrap} > {deg})"
    return f"""br0 AS (SELECT *, lead(time) OVER w AS nt, lag(time) OVER w AS pt, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon
    FROM {view_name} WINDOW w AS (PARTITION BY pcode ORDER BY time, event_id)),
  br AS (SELECT *, CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS BIGINT) AS is_break FROM br0),
  st AS (SELECT *, CAST(coalesce(sum(is_break) OVER (PARTITION BY pcode ORDER BY time, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stage FROM br)"""


@query("w1_breaks_by_gap", using("obs", extra=breaks_sql("obs", 120, 1000)) + "SELECT event_id, is_break FROM br", keys="*")
def w1(spark, sf):
    return S.find_breaks(cut_once(obs(spark, sf)), ["pcode"], "time", "event_id", 120, 1000).select("event_id", "is_break")


def cut_once(df):
    return df.select("event_id", "time", "pcode", "lat", "lon")


@query("w1_breaks_by_position", using("obs", extra=TRACK + ", " + breaks_sql("track", 2880, 1)) +
       "SELECT event_id, is_break FROM br", keys="*")
def w1b(spark, sf):
    return S.find_breaks(track(spark, sf), ["pcode"], "time", "event_id").select("event_id", "is_break")


@query("w1_breaks_strict", using("obs", extra=TRACK + ", " + breaks_sql("track", 120, 1, True)) +
       "SELECT event_id, is_break FROM br", keys="*")
def w1c(spark, sf):
    return S.find_breaks(track(spark, sf), ["pcode"], "time", "event_id", 120, 1, True).select("event_id", "is_break")


@query("w2_stage_labels", using("obs", extra=TRACK + ", " + breaks_sql("track", 120, 1)) + "SELECT event_id, stage FROM st", keys="*")
def w2(spark, sf):
    return S.stage_label(track(spark, sf), ["pcode"], "time", "event_id", 120, 1).select("event_id", "stage")


@query("w2_stage_spans", using("obs", extra=breaks_sql("obs", 120, 1000)) +
       'SELECT pcode, min(time) AS start, max(time) AS "last", count(*) AS n FROM st GROUP BY pcode, stage', keys="*")
def w2b(spark, sf):
    return S.stage_spans(obs(spark, sf), ["pcode"], "time", "event_id", 120)


@query("a28_stage_bias", using("obs", extra=TRACK + ", " + breaks_sql("track", 120, 1)) +
       "SELECT pcode, stage, count(*) AS n, avg(hlc-hlb) AS bias FROM st GROUP BY pcode, stage HAVING count(*) > 20", keys="pcode, stage, n")
def a28(spark, sf):
    return S.stage_bias(S.stage_label(track(spark, sf), ["pcode"], "time", "event_id", 120, 1), ["pcode", "stage"], "hlc", "hlb")


@query("w3_track_check", using("obs", extra=breaks_sql("obs", 120, 1000)) + """
  , d AS (SELECT pcode, stage, lat, lon, abs(lat - lag(lat) OVER w) AS a, abs(lon - lag(lon) OVER w) AS o FROM st
     WINDOW w AS (PARTITION BY pcode, stage ORDER BY time, event_id))
  SELECT pcode, stage, max(CASE WHEN a > 2 AND abs(a-360) > 2 THEN 1 ELSE 0 END) AS lat_jump, avg(a) AS lat_step,
    max(CASE WHEN o > 2 AND abs(o-360) > 2 THEN 1 ELSE 0 END) AS lon_jump, avg(o) AS lon_step,
    max(CASE WHEN lat IS NULL OR lon IS NULL THEN 1 ELSE 0 END) AS missing FROM d GROUP BY pcode, stage""",
       keys="pcode, stage, lat_jump, lon_jump, missing")
def w3(spark, sf):
    st = S.stage_label(cut_once(obs(spark, sf)), ["pcode"], "time", "event_id", 120, 1000)
    return S.track_check(st, ["pcode", "stage"], "time", "event_id")


@query("w4_sampling_gaps", using("obs") + """, g AS (SELECT pcode, date_diff('microsecond', lag(time) OVER
    (PARTITION BY pcode ORDER BY time, event_id), time)/1e6/6e1 AS gap FROM obs)
  SELECT pcode, count(gap) AS n, count(*) FILTER (gap > 60) AS n_long, max(gap) AS longest, avg(gap) AS mean,
    quantile_disc(gap, 0.5) AS median FROM g GROUP BY pcode""", keys="pcode, n, n_long")
def w4(spark, sf):
    return S.gap_summary(S.gap_profile(obs(spark, sf), "time", "event_id", ["pcode"]), ["pcode"])


@query("w5_rolling_mean", using("obs") + """, r AS (SELECT event_id, taucx, count(taucx) OVER w AS n, avg(taucx) OVER w AS m FROM obs
    WINDOW w AS (PARTITION BY pcode ORDER BY time, event_id ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING))
  SELECT event_id, CASE WHEN n = 24 THEN m END AS rolling, taucx - coalesce(CASE WHEN n = 24 THEN m END, 0) AS rolling_anomaly
  FROM r""", keys="event_id")
def w5(spark, sf):
    return S.rolling_mean(obs(spark, sf).select("event_id", "pcode", "time", "taucx"), "taucx", 24, "time", "event_id", ["pcode"]) \
        .select("event_id", "rolling", "rolling_anomaly")


AC = """ix AS (SELECT event_id, time, taucx - avg(taucx) OVER () AS x, row_number() OVER (ORDER BY time, event_id) AS i FROM obs),
  ac AS (SELECT lag, sum(a.x*b.x)/(SELECT sum(x*x) FROM ix) AS r FROM ix a CROSS JOIN range(201) l(lag)
    JOIN ix b ON b.i = a.i + lag GROUP BY lag)"""


@query("w6_autocorrelation", using("obs", extra=AC) + "SELECT CAST(lag AS BIGINT) AS lag, r FROM ac", keys="lag")
def w6(spark, sf):
    return S.autocorr(obs(spark, sf), "taucx", 200, "time", "event_id")


@query("w6_autocorrelation_detrended", using("obs", extra=SERIES) + """, ro AS (SELECT time, x - coalesce(CASE WHEN count(x) OVER w = 48
     THEN avg(x) OVER w END, 0) AS x FROM series WINDOW w AS (ORDER BY time ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING)),
  ix AS (SELECT x - avg(x) OVER () AS x, row_number() OVER (ORDER BY time) AS i FROM ro)
  SELECT CAST(lag AS BIGINT) AS lag, sum(a.x*b.x)/(SELECT sum(x*x) FROM ix) AS r FROM ix a CROSS JOIN range(201) l(lag)
    JOIN ix b ON b.i = a.i + lag GROUP BY lag""", keys="lag")
def w6b(spark, sf):
    return S.autocorr(hourly(spark, sf), "x", 200, "time", detrend=48)


@query("w7_correlation_time", using("obs", extra=AC) + """, k AS (SELECT arg_min(lag, abs(r - exp(-1e0))) AS k,
    max(r) FILTER (lag = 1) AS r1 FROM ac)
  SELECT CAST(k AS BIGINT) AS k, 1e0/(1e0-exp(-1e0/k)) AS t_fold, 1e0/(1e0-r1) AS t_lag1 FROM k""", keys="k")
def w7(spark, sf):
    return S.corr_time(S.autocorr(obs(spark, sf), "taucx", 200, "time", "event_id"))


@query("w16_lag_correlation", using("obs") + """, ix AS (SELECT U AS x, row_number() OVER (ORDER BY time, event_id) AS i
    FROM obs WHERE U IS NOT NULL)
  SELECT CAST(lag AS BIGINT) AS lag, corr(a.x, b.x) AS r FROM ix a CROSS JOIN range(1, 100) l(lag) JOIN ix b ON b.i = a.i + lag
  GROUP BY lag""", keys="lag")
def w16(spark, sf):
    return S.lag_corr(obs(spark, sf), "U", 99, "time", "event_id")


@query("w9_hourly_interpolation", using("obs") + """, n AS (SELECT time, taucx, hsc, lead(time) OVER w AS nt, lead(taucx) OVER w AS nx,
    lead(hsc) OVER w AS nh FROM obs WINDOW w AS (ORDER BY time)),
  g AS (SELECT unnest(range(TIMESTAMP '2024-01-01', (SELECT max(time) + INTERVAL 1 HOUR FROM obs), INTERVAL 1 HOUR)) AS t),
  j AS (SELECT *, date_diff('microsecond', time, t)/date_diff('microsecond', time, nt)::DOUBLE AS f
    FROM g JOIN n ON t >= time AND t < nt)
  SELECT t AS time, taucx + (nx - taucx)*f AS taucx, hsc + (nh - hsc)*f AS hsc FROM j""", keys="time")
def w9(spark, sf):
    return S.resample_linear(obs(spark, sf), "time", ["taucx", "hsc"], "1 hour")


@query("w14_fill_nearest", using("obs") + """, ix AS (SELECT event_id, pcode, U,
    row_number() OVER (PARTITION BY pcode ORDER BY time, event_id) AS i FROM obs),
  f AS (SELECT *, max(CASE WHEN U IS NOT NULL THEN i END) OVER (PARTITION BY pcode ORDER BY i) AS pi,
    min(CASE WHEN U IS NOT NULL THEN i END) OVER (PARTITION BY pcode ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM ix)
  SELECT f.event_id, v.U FROM f JOIN ix v ON v.pcode = f.pcode AND v.i =
    CASE WHEN f.pi IS NULL THEN f.ni WHEN f.ni IS NULL THEN f.pi WHEN f.i - f.pi <= f.ni - f.i THEN f.pi ELSE f.ni END""", keys="event_id")
def w14(spark, sf):
    return S.fill_nearest(obs(spark, sf).select("event_id", "pcode", "time", "U"), "U", "time", "event_id", ["pcode"]) \
        .select("event_id", "U")


@query("w15_second_difference", using("grid") + """SELECT ts, lat, lon, lead(phs0) OVER w - 2*phs0 + lag(phs0) OVER w AS d2 FROM grid
  WINDOW w AS (PARTITION BY ts, lat ORDER BY lon)""", keys="ts")
def w15(spark, sf):
    return S.second_diff(view(spark, sf, "grid"), "phs0", ["ts", "lat"], "lon").select("ts", "lat", "lon", "d2")
