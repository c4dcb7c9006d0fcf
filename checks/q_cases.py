"""Profile, ensemble and case queries."""

from pyspark.sql import functions as F

from checks.q_functions import rho_sql
from checks.registry import query
from checks.views import using, view
from halocline.functions.clock import floor_time
from halocline.operators import cases as C, profiles as P
from halocline.session import scratch


def prof(spark, sf):
    return view(spark, sf, "prof")


def cases(spark, sf):
    return view(spark, sf, "cases")


def mld_sql(value, step, src="prof", keys="pid"):
    return f"""v AS (SELECT *, {value} AS v FROM {src}),
  t AS (SELECT {keys}, max_by(v, z) + {step} AS thr, count(*) AS n FROM v GROUP BY {keys}),
  r AS (SELECT v.*, thr, n, row_number() OVER (PARTITION BY {keys} ORDER BY v, z) AS i,
     sum(CASE WHEN v < thr THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}) AS below FROM v JOIN t USING ({keys})),
  k AS (SELECT *, greatest(1, least(n - 1, below)) AS k FROM r),
  m AS (SELECT {keys}, max(thr) AS thr, max(z) FILTER (i = k) AS z0, max(z) FILTER (i = k + 1) AS z1,
     max(v) FILTER (i = k) AS v0, max(v) FILTER (i = k + 1) AS v1 FROM k GROUP BY {keys}),
  mld AS (SELECT {keys}, z0 + (thr - v0)*(z1 - z0)/nullif(v1 - v0, 0) AS mld FROM m)"""


@query("w10_mixed_layer_temperature", using("prof", extra=mld_sql("temp", "-0.2e0")) + "SELECT * FROM mld", keys="pid", digits=6)
def w10(spark, sf):
    return P.mixed_layer_depth(prof(spark, sf), ["pid"], "temperature")


@query("w10_mixed_layer_density", using("prof", extra=mld_sql(rho_sql(), "0.1e0")) + "SELECT * FROM mld", keys="pid", digits=5)
def w10b(spark, sf):
    return P.mixed_layer_depth(prof(spark, sf), ["pid"], "density")


@query("w11_surface", using("prof") + "SELECT pid, max_by(temp, z) AS temp, max_by(salt, z) AS salt FROM prof GROUP BY pid", keys="pid")
def w11(spark, sf):
    return P.surface(prof(spark, sf), ["pid"], ["temp", "salt"])


LEVELS = [-104.0, -97.5, -60.0, -42.0, -12.25, -5.0, -1.0]


@query("w8_common_levels", using("prof") + f""", g AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in LEVELS)}]) AS zg),
  s AS (SELECT pid, z, temp, lead(z) OVER w AS z1, lead(temp) OVER w AS t1, row_number() OVER w AS i,
     count(*) OVER (PARTITION BY pid) AS n FROM prof WINDOW w AS (PARTITION BY pid ORDER BY z))
  SELECT pid, zg AS z, temp + (t1-temp)/(z1-z)*(zg-z) AS temp FROM s JOIN g ON
    (zg > z OR i = 1) AND (zg <= z1 OR i = n - 1) WHERE z1 IS NOT NULL""", keys="pid", digits=7)
def w8(spark, sf):
    return P.interp_levels(prof(spark, sf), ["pid"], LEVELS, ["temp"])


ENS = """d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, ensem, avg(temp) AS temp FROM prof GROUP BY 1, 2)"""


@query("a15_ensemble_stats", using("prof", extra=ENS) +
       "SELECT day, avg(temp) AS temp_mean, stddev_pop(temp) AS temp_std FROM d GROUP BY day", keys="day")
def a15(spark, sf):
    return C.ensemble_stats(C.member_daily(prof(spark, sf), ["temp"]), ["temp"], ["day"])


DAILY = """d AS (SELECT method, date_trunc('day', ts)::TIMESTAMP AS ts, ensem, avg(mld) AS mld, avg(sst) AS sst FROM cases
    WHERE flux = 'ANN' GROUP BY 1, 2, 3),
  det AS (SELECT method, date_trunc('day', ts)::TIMESTAMP AS ts, avg(mld) AS mld, avg(sst) AS sst FROM cases WHERE flux = 'Bulk' GROUP BY 1, 2),
  e AS (SELECT method, ts, avg(mld) AS mm, stddev_pop(mld) AS ms, avg(sst) AS sm, stddev_pop(sst) AS ss FROM d GROUP BY 1, 2),
  em AS (SELECT method, year(ts) AS y, month(ts) AS m, avg(mm) AS mm, avg(ms) AS ms, avg(sm) AS sm, avg(ss) AS ss FROM e GROUP BY 1, 2, 3),
  dm AS (SELECT method, year(ts) AS y, month(ts) AS m, avg(mld) AS mld, avg(sst) AS sst FROM det GROUP BY 1, 2, 3)"""


@query("a16_stochastic_drift", using("cases", extra=DAILY) + """SELECT method, CAST(y AS INT) AS year, CAST(m AS INT) AS month,
  abs(mm)-abs(mld) AS mld_diff, ms AS mld_std, sm-sst AS sst_diff, ss AS sst_std FROM em JOIN dm USING (method, y, m)""",
       keys="method, year, month", digits=7)
def a16(spark, sf):
    c = cases(spark, sf)
    ens = C.member_daily(c.filter("flux = 'ANN'"), ["mld", "sst"], by=["method"]).withColumnRenamed("day", "ts")
    det = c.filter("flux = 'Bulk'").groupBy("method", floor_time("ts", "day").alias("ts")).agg(F.avg("mld").alias("mld"), F.avg("sst").alias("sst"))
    return C.stoch_metrics(ens, det, ["method"])


DIST = """mo AS (SELECT flux, method, year(ts) AS y, month(ts) AS m, avg(mld) AS mld, avg(sst) AS sst, avg(q) AS q
    FROM cases GROUP BY ALL),
  dist AS (SELECT a.flux, a.method, CAST(a.y AS INT) AS year, CAST(a.m AS INT) AS month, abs(a.mld)-abs(b.mld) AS mld_diff,
    a.sst-b.sst AS sst_diff, a.q-b.q AS q_diff FROM mo a JOIN mo b ON a.y = b.y AND a.m = b.m"""
SAME = DIST + " AND a.method = b.method WHERE a.flux = 'ANN' AND b.flux = 'Bulk')"


@query("a17_case_distance", using("cases", extra=DIST + """ WHERE a.flux = 'ANN' AND a.method = 'kpp'
    AND b.flux = 'Bulk' AND b.method = 'kepsilon')""") + "SELECT year, month, mld_diff, sst_diff, q_diff FROM dist", keys="year, month")
def a17(spark, sf):
    return C.case_distance(cases(spark, sf), {"flux": "ANN", "method": "kpp"}, {"flux": "Bulk", "method": "kepsilon"})


@query("a17_case_distances", using("cases", extra=SAME) + "SELECT * FROM dist", keys="flux, method, year, month")
def a17b(spark, sf):
    return C.case_distances(cases(spark, sf), ["method"])


@query("a18_year_mean", using("cases", extra=SAME) + "SELECT method, " + ", ".join(
    f"avg(mld_diff) FILTER (month = {m}) AS m{m:02d}" for m in range(1, 13)) + " FROM dist GROUP BY method", keys="method", digits=7)
def a18(spark, sf):
    return C.year_mean(C.case_distances(cases(spark, sf), ["method"]), "mld_diff", ["method"])


@query("a19_sign_agreement", using("cases", extra=SAME) + """SELECT method, month,
  CASE WHEN count(DISTINCT sign(sst_diff)) = 1 THEN 1 ELSE 0 END AS agree FROM dist GROUP BY method, month""", keys="*")
def a19(spark, sf):
    return C.sign_agree(C.case_distances(cases(spark, sf), ["method"]), "sst_diff", ["method"])


HOURLY = """h AS (SELECT date_trunc('hour', time) AS datetime, avg(hsc) AS q FROM obs GROUP BY 1),
  t AS (SELECT date_trunc('hour', time) AS datetime, avg(taucx) AS taux FROM obs WHERE pcode <> 77 AND U > 10 GROUP BY 1)"""


@query("j1_join_on_time", using("obs", extra=HOURLY) + "SELECT datetime, q, taux FROM h JOIN t USING (datetime)", keys="datetime")
def j1(spark, sf):
    o = view(spark, sf, "obs").withColumn("datetime", floor_time("time", "hour"))
    a = o.groupBy("datetime").agg(F.avg("hsc").alias("q"))
    b = o.filter("pcode <> 77 AND U > 10").groupBy("datetime").agg(F.avg("taucx").alias("taux"))
    return C.join_on_time(a, b)


@query("j2_case_delta", using("prof") + """, d AS (SELECT ensem, date_trunc('day', ts)::TIMESTAMP AS ts, z, avg(temp) AS temp,
     avg(salt) AS salt FROM prof GROUP BY ALL)
  SELECT a.ts, a.z, a.temp-b.temp AS temp, a.salt-b.salt AS salt FROM d a JOIN d b ON a.ts = b.ts AND a.z = b.z
    AND a.ensem = 0 AND b.ensem = 1""", keys="ts")
def j2(spark, sf):
    d = C.member_daily(prof(spark, sf), ["temp", "salt"], by=["z"]).withColumnRenamed("day", "ts")
    return C.case_delta(d.filter("ensem = 0"), d.filter("ensem = 1"), ["ts", "z"], ["temp", "salt"])


@query("j5_cruise_lookup", using("obs", "cruise") + "SELECT event_id, pcode, name, region FROM obs LEFT JOIN cruise USING (pcode)", keys="*")
def j5(spark, sf):
    return C.with_cruise(view(spark, sf, "obs")).select("event_id", "pcode", "name", "region")


@query("j7_load_cases", using("cases") + """, c AS (SELECT *, year(ts) AS y, month(ts) AS m FROM cases WHERE dt = 60),
  mo AS (SELECT method, y, m, avg(sst) FILTER (flux = 'ANN') AS a, avg(sst) FILTER (flux = 'Bulk') AS b FROM c GROUP BY ALL)
  SELECT method, CAST(y AS INT) AS year, CAST(m AS INT) AS month, a - b AS sst_diff FROM mo WHERE a IS NOT NULL AND b IS NOT NULL""",
       keys="method, year, month")
def j7(spark, sf):
    path = scratch(spark, "cases")
    cases(spark, sf).withColumn("year", F.year("ts")).write.partitionBy("flux", "method", "dt", "year").parquet(path)
    both = C.load_cases(spark, path, [{"flux": "ANN", "dt": 60}, {"flux": "Bulk", "dt": 60}]).drop("year")
    return C.case_distances(both, ["method"]).select("method", "year", "month", "sst_diff")


REPORT = mld_sql(rho_sql(), "0.1e0", "prof", "pid, ts, ensem") + """,
  top AS (SELECT pid, ts, ensem, max_by(temp, z) AS sst, max_by(q, z) AS q FROM prof GROUP BY ALL),
  c AS (SELECT CASE WHEN ensem < 2 THEN 'ANN' ELSE 'Bulk' END AS flux, ts, mld, sst, q FROM mld JOIN top USING (pid, ts, ensem)),
  w AS (SELECT CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, avg(mld) FILTER (flux='ANN') AS ma,
    avg(mld) FILTER (flux='Bulk') AS mb, avg(sst) FILTER (flux='ANN') AS sa, avg(sst) FILTER (flux='Bulk') AS sb,
    avg(q) FILTER (flux='ANN') AS qa, avg(q) FILTER (flux='Bulk') AS qb FROM c GROUP BY ALL)"""


@query("l4_compare_cases", using("prof", extra=REPORT) + """SELECT year, month, abs(ma)-abs(mb) AS mld_diff, sa-sb AS sst_diff,
  qa-qb AS q_diff FROM w WHERE sa IS NOT NULL AND sb IS NOT NULL""", keys="year, month", digits=5)
def l4(spark, sf):
    from halocline.plans.comparison import compare_profiles
    p = prof(spark, sf).withColumn("flux", F.when(F.col("ensem") < 2, "ANN").otherwise("Bulk"))
    return compare_profiles(p, {"flux": "ANN"}, {"flux": "Bulk"}, ["pid", "ts", "flux"])


@query("l5_check_forcing", using("obs") + """, a AS (SELECT date_trunc('hour', time) AS ts, avg(hsc) AS q FROM obs GROUP BY 1),
  b AS (SELECT date_trunc('hour', time) AS ts, avg(hsb) AS qb FROM obs GROUP BY 1)
  SELECT CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, count(*) AS n, max(abs(q-qb)) AS q_max, avg(q)-avg(qb) AS q_diff
  FROM a JOIN b USING (ts) GROUP BY 1, 2""", keys="year, month, n")
def l5(spark, sf):
    o = view(spark, sf, "obs").withColumn("ts", floor_time("time", "hour"))
    a, b = o.groupBy("ts").agg(F.avg("hsc").alias("q")), o.groupBy("ts").agg(F.avg("hsb").alias("qb"))
    return C.check_forcing(a, b, {"q": "qb"})
