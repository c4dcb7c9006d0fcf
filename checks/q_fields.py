"""Interpolation queries."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import using, view
from halocline.operators import interpolation as I, quality as Q
from halocline.plans.waves import add_waves

# Cell numbers and shares of each observation on the 6-hourly, 5 x 10 degree grid.
PLACE = """n0 AS (SELECT *, CASE WHEN lon > 0 THEN lon ELSE 360 + lon END AS x, date_diff('microsecond', TIMESTAMP '2024-01-01', time)/2.16e10 AS tt,
    (lat+60)/5e0 AS yy FROM obs),
  n1 AS (SELECT *, CASE WHEN yy BETWEEN 0 AND 24 THEN least(floor(yy), 23) END AS i, CASE WHEN x BETWEEN 0 AND 350 THEN least(floor(x/1e1), 34) END AS j,
    CASE WHEN tt BETWEEN 0 AND 119 THEN least(floor(tt), 118) END AS k FROM n0),
  gi AS (SELECT *, (lat+60)/5e0 AS gi, lon/1e1 AS gj, date_diff('microsecond', TIMESTAMP '2024-01-01', ts)/2.16e10 AS gk FROM grid)"""


def tri(col, fill=False):
    return f"""(SELECT event_id, sum((CASE WHEN a=1 THEN yy-i ELSE 1-yy+i END)*(CASE WHEN b=1 THEN x/1e1-j ELSE 1-x/1e1+j END)
      *(CASE WHEN c=1 THEN tt-k ELSE 1-tt+k END)*{f'coalesce({col}, 0)' if fill else col}) AS v, count({'*' if fill else col}) AS n
    FROM n1 CROSS JOIN (VALUES (0),(1)) q(a) CROSS JOIN (VALUES (0),(1)) r(b) CROSS JOIN (VALUES (0),(1)) s(c)
    JOIN gi ON gi.gi = i+a AND gi.gj = j+b AND gi.gk = k+c GROUP BY event_id)"""


def track(spark, sf):
    return Q.norm_lon(view(spark, sf, "obs").select("event_id", "time", "lat", "lon"))


@query("j3_track_interpolation", using("obs", "grid", extra=PLACE) + f"""SELECT event_id, CASE WHEN p.n = 8 THEN p.v END AS phs0,
    CASE WHEN t.n = 8 THEN t.v END AS sst FROM obs LEFT JOIN {tri('phs0')} p USING (event_id) LEFT JOIN {tri('sst')} t USING (event_id)""",
       keys="event_id", digits=7)
def j3(spark, sf):
    return I.interp_track(track(spark, sf), view(spark, sf, "grid"), ["phs0", "sst"]).select("event_id", "phs0", "sst")


@query("l3_waves_on_track", using("obs", "grid", extra=PLACE) + f"""SELECT event_id, coalesce(CASE WHEN p.n = 8 THEN p.v END, 0) AS phs0,
    coalesce(CASE WHEN t.n = 8 THEN t.v END, 0) AS plp0 FROM obs LEFT JOIN {tri('phs0', True)} p USING (event_id)
    LEFT JOIN {tri('plp0', True)} t USING (event_id)""", keys="event_id", digits=7)
def l3(spark, sf):
    return add_waves(track(spark, sf), view(spark, sf, "grid"), ["phs0", "plp0"]).select("event_id", "phs0", "plp0")


# The 30 days of the field are spread over three years; two of the cruises share a month.
CRUISE_MONTHS = {71: ["200907", "200908", "201002"], 72: ["200908", "200909"], 87: ["201001", "201103", "201104"]}
SPREAD = "TIMESTAMP '2009-07-01' + to_microseconds(36*date_diff('microsecond', TIMESTAMP '2024-01-01', {}))"


def spread(col):
    """The same times as SPREAD."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col(col))
    return F.timestamp_add("MICROSECOND", 36 * micros, F.lit("2009-07-01").cast("timestamp_ntz"))


@query("l3_waves_by_cruise", using("obs", "grid", extra=f"""cm AS (SELECT * FROM (VALUES {', '.join(f"({c}, '{m}')" for c, ms in CRUISE_MONTHS.items() for m in ms)}) AS v(pcode, m)),
  f AS (SELECT *, {SPREAD.format('ts')} AS t FROM grid), o AS (SELECT *, CASE WHEN lon > 0 THEN lon ELSE 360 + lon END AS x, {SPREAD.format('time')} AS t FROM obs),
  ax AS (SELECT pcode, t, lead(t) OVER (PARTITION BY pcode ORDER BY t) AS t1 FROM (SELECT DISTINCT pcode, t FROM f JOIN cm ON m = strftime(t, '%Y%m'))),
  pl AS (SELECT event_id, x, lat, o.t, ax.t AS ta, t1 AS tb, date_diff('microsecond', ax.t, o.t)/date_diff('microsecond', ax.t, t1)::DOUBLE AS wt FROM o JOIN ax ON o.pcode = ax.pcode
     AND o.t >= ax.t AND (o.t < t1 OR (o.t = t1 AND NOT EXISTS (SELECT 1 FROM ax z WHERE z.pcode = ax.pcode AND z.t > t1)))),
  ce AS (SELECT *, least(floor((lat+60)/5e0), 23) AS i, least(floor(x/1e1), 34) AS j FROM pl WHERE lat BETWEEN -60 AND 60 AND x BETWEEN 0 AND 350),
  w AS (SELECT event_id, sum((CASE WHEN a=1 THEN (ce.lat+60)/5e0-i ELSE 1-(ce.lat+60)/5e0+i END)*(CASE WHEN b=1 THEN x/1e1-j ELSE 1-x/1e1+j END)
     *(CASE WHEN c=1 THEN wt ELSE 1-wt END)*coalesce(phs0, 0)) AS v, count(*) AS n FROM ce CROSS JOIN (VALUES (0),(1)) q(a) CROSS JOIN (VALUES (0),(1)) r(b)
     CROSS JOIN (VALUES (0),(1)) s(c) JOIN f ON f.lat = -60+5*(i+a) AND f.lon = 10*(j+b) AND f.t = CASE WHEN c=1 THEN tb ELSE ta END GROUP BY event_id)""") + """SELECT event_id, pcode,
  coalesce(CASE WHEN n = 8 THEN v END, 0) AS phs0 FROM obs LEFT JOIN w USING (event_id)""", keys="event_id, pcode", digits=7)
def l3_by_cruise(spark, sf):
    o = Q.norm_lon(view(spark, sf, "obs").select("event_id", "pcode", spread("time").alias("time"), "lat", "lon"))
    wave = view(spark, sf, "grid").withColumn("ts", spread("ts"))
    cruises = spark.createDataFrame(list(CRUISE_MONTHS.items()), "pcode int, months array<string>")
    return add_waves(o, wave, ["phs0"], cruise="pcode", cruises=cruises).select("event_id", "pcode", "phs0")


MEAN = """m AS (SELECT lat, lon, avg(sst) AS sst, avg(phs0) AS phs0 FROM grid GROUP BY lat, lon),
  d AS (SELECT *, CASE WHEN lat BETWEEN -60 AND 60 THEN least(floor((lat+60)/5e0), 23) END AS i,
     CASE WHEN lon BETWEEN 0 AND 350 THEN least(floor(lon/1e1), 34) END AS j FROM points),
  b AS (SELECT point_id, sum((CASE WHEN a=1 THEN (d.lat+60)/5e0-i ELSE 1-(d.lat+60)/5e0+i END)*(CASE WHEN b=1 THEN d.lon/1e1-j ELSE 1-d.lon/1e1+j END)*sst) AS sst,
     sum((CASE WHEN a=1 THEN (d.lat+60)/5e0-i ELSE 1-(d.lat+60)/5e0+i END)*(CASE WHEN b=1 THEN d.lon/1e1-j ELSE 1-d.lon/1e1+j END)*phs0) AS phs0,
     count(sst) AS n FROM d CROSS JOIN (VALUES (0),(1)) q(a) CROSS JOIN (VALUES (0),(1)) r(b)
     JOIN m ON m.lat = -60+5*(i+a) AND m.lon = 10*(j+b) GROUP BY point_id)"""


@query("j4_regrid", using("grid", "points", extra=MEAN) + """SELECT point_id, air, CASE WHEN n = 4 THEN sst END AS sst, phs0
  FROM points LEFT JOIN b USING (point_id)""".replace("SELECT point_id, air, CASE", "SELECT point_id, points.air, CASE").replace(
    "END AS sst, phs0", "END AS sst, b.phs0"), keys="point_id", digits=7)
def j4(spark, sf):
    src = view(spark, sf, "grid").groupBy("lat", "lon").agg(F.avg("sst").alias("sst"), F.avg("phs0").alias("phs0"))
    return I.regrid(src, view(spark, sf, "points"), ["sst", "phs0"]).select("point_id", "air", "sst", "phs0")
