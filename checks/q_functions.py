"""Scalar function queries."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import using, view
from halocline.functions import clock as C, thermo as T

ES = "6.1121e0*exp(17.502e0*{t}/(240.97e0+{t}))*(1.0007e0+{p}*3.46e-6)"


def es(t, p="p/1e2"):
    return "(" + ES.format(t=t, p=f"({p})") + ")"


def obs(spark, sf):
    return view(spark, sf, "obs").withColumn("mb", F.col("p") / 100.0)


@query("f1_qsat", using("obs") + f"SELECT event_id, {es('tair')} AS es FROM obs", keys="event_id")
def f1(spark, sf):
    return obs(spark, sf).select("event_id", T.qsat("tair", "mb").alias("es"))


@query("f2_qsea", using("obs") + f"SELECT event_id, 622e0*0.98e0*{es('tsea')}/(p/1e2 - 0.378e0*0.98e0*{es('tsea')}) AS qs FROM obs",
       keys="event_id")
def f2(spark, sf):
    return obs(spark, sf).select("event_id", T.qsea("tsea", "mb").alias("qs"))


RH = f"1e2*((p/1e2)*qair/(0.622e0+0.378e0*qair))/{es('tair')}"


@query("f3_relative_humidity", using("obs") + f"SELECT event_id, {RH} AS rh FROM obs", keys="event_id", digits=6)
def f3(spark, sf):
    return obs(spark, sf).select("event_id", T.rhcalc("tair", "mb", "qair").alias("rh"))


@query("f4_with_rh", using("obs") + f"""SELECT event_id, {RH} AS rh,
  1e2*(1010e0*qair/(0.622e0+0.378e0*qair))/{es('tair', '1010e0')} AS rh_const FROM obs""", keys="event_id", digits=6)
def f4(spark, sf):
    o = T.with_rh(obs(spark, sf).drop("rh"))
    return T.with_rh(o.withColumnRenamed("rh", "rh1"), p_pa=None).select(
        "event_id", F.col("rh1").alias("rh"), F.col("rh").alias("rh_const"))


EM = f"(rh/1e2*{es('tair')})"


@query("f5_specific_humidity", using("obs") +
       f"SELECT event_id, 621.97e0*{EM}/(p/1e2 - 0.378e0*{EM}) AS q, {EM} AS e FROM obs", keys="event_id")
def f5(spark, sf):
    return obs(spark, sf).withColumn("s", T.qair("tair", "mb", "rh")).select("event_id", "s.q", "s.e")


@query("f6_air_density", using("obs") + f"""SELECT event_id,
  ((p - {EM}*1e2)*0.028964e0 + {EM}*1e2*0.018016e0)/(8.314e0*(tair+273.15e0)) AS moist,
  p/(287.058e0*(tair+273.15e0)) AS dry FROM obs""", keys="event_id")
def f6(spark, sf):
    return obs(spark, sf).select("event_id", T.rhoa("tair", "mb", "rh").alias("moist"), T.rhod("tair", "mb").alias("dry"))


GRV = """9.7803267715e0*(1e0 + 0.0052790414e0*pow(sin(radians(lat)),2) + 0.0000232718e0*pow(sin(radians(lat)),4)
  + 0.0000001262e0*pow(sin(radians(lat)),6) + 0.0000000007e0*pow(sin(radians(lat)),8))"""


@query("f7_gravity", using("obs") + f"SELECT event_id, {GRV} AS g FROM obs", keys="event_id")
def f7(spark, sf):
    return obs(spark, sf).select("event_id", T.grv("lat").alias("g"))


@query("f8_latent_heat", using("prof") + """, l AS (SELECT pid, lev, salt, (2.5008991412e6 - 2.3691806479e3*temp
  + 2.6776439436e-1*temp*temp - 8.1027544602e-3*temp*temp*temp - 2.0799346624e-5*temp*temp*temp*temp)/1e3 AS pure FROM prof)
  SELECT pid, lev, pure, pure*(1e0 - 1e-3*salt) AS sea FROM l""", keys="pid, lev", digits=7)
def f8(spark, sf):
    return view(spark, sf, "prof").withColumn("s", T.le_water("temp", "salt")).select("pid", "lev", "s.pure", "s.sea")


@query("f9_wind_vector", using("obs") + """, w AS (SELECT event_id, -U*cos(radians(wdir + 18e1)) AS u1,
  -U*sin(radians(wdir + 18e1)) AS v1 FROM obs)
  SELECT event_id, u1, v1, sqrt(u1*u1+v1*v1) AS spd, cos(atan2(v1, u1)) AS cos_dir FROM w""", keys="event_id")
def f9(spark, sf):
    w = obs(spark, sf).withColumn("s", T.spd_dir2uv("U", "wdir")).select("event_id", F.col("s.u").alias("u1"), F.col("s.v").alias("v1"))
    w = w.withColumn("d", T.uv2spd_dir("u1", "v1"))
    return w.select("event_id", "u1", "v1", F.col("d.spd").alias("spd"), F.cos(F.radians("d.dir")).alias("cos_dir"))


ZETA = "z AS (SELECT event_id, (event_id % 1201 - 600)/2e1 AS z FROM obs)"


def _far(slope):
    y = f"pow(1e0 - {slope}*z, 0.3333e0)"
    return f"(1.5e0*ln((1e0+{y}+{y}*{y})/3e0) - sqrt(3e0)*atan((1e0+2e0*{y})/sqrt(3e0)) + 4e0*atan(1e0)/sqrt(3e0))"


def psit_sql():
    near = "(2e0*ln((1e0+sqrt(1e0-15e0*z))/2e0))"
    return f"""CASE WHEN z < 0 THEN (1e0 - z*z/(1e0+z*z))*{near} + z*z/(1e0+z*z)*{_far('34.15e0')}
      WHEN z >= 0 THEN -(pow(1e0+0.6667e0*z, 1.5e0) + 0.6667e0*(z-14.28e0)*exp(-least(50e0, 0.35e0*z)) + 8.525e0) END"""


def psiu_sql(a, near_slope, far_slope):
    x = f"pow(1e0-{near_slope}*z, 0.25e0)"
    near = f"(2e0*ln((1e0+{x})/2e0) + ln((1e0+{x}*{x})/2e0) - 2e0*atan({x}) + 2e0*atan(1e0))"
    return f"""CASE WHEN z < 0 THEN (1e0 - z*z/(1e0+z*z))*{near} + z*z/(1e0+z*z)*{_far(far_slope)}
      WHEN z >= 0 THEN -({a}*z + 0.75e0*(z-5e0/0.35e0)*exp(-least(50e0, 0.35e0*z)) + 0.75e0*5e0/0.35e0) END"""


@query("f10_stability", using("obs", extra=ZETA) + f"""SELECT event_id, {psit_sql()} AS psit_26,
  {psiu_sql('0.7e0', '15e0', '10.15e0')} AS psiu_26, {psiu_sql('1e0', '18e0', '10e0')} AS psiu_40 FROM z""", keys="event_id")
def f10(spark, sf):
    z = obs(spark, sf).select("event_id", ((F.col("event_id") % 1201 - 600) / 20.0).alias("z"))
    return z.select("event_id", T.psit_26("z").alias("psit_26"), T.psiu_26("z").alias("psiu_26"), T.psiu_40("z").alias("psiu_40"))


ICE = """i AS (SELECT event_id, tair - 15e0 AS t, p/1e2 AS mb, rh, 3e1 + event_id % 7 AS ss, qair FROM obs),
  f AS (SELECT *, -0.0575e0*ss + 0.00171052e0*pow(ss, 1.5e0) - 0.0002154996e0*ss*ss AS tf FROM i),
  v AS (SELECT *, CASE WHEN t < tf THEN 6.1115e0*exp(22.452e0*t/(t+272.55e0))*(1.0003e0+4.18e-6*mb)
        ELSE 6.1121e0*exp(17.502e0*t/(t+240.97e0))*(1.0007e0+3.46e-6*mb) END AS e,
        CASE WHEN t < 0 THEN 6.1115e0*exp(22.452e0*t/(t+272.55e0))*(1.0003e0+4.18e-6*mb)
        ELSE 6.1121e0*exp(17.502e0*t/(t+240.97e0))*(1.0007e0+3.46e-6*mb) END AS e0 FROM f)"""


def icy(spark, sf):
    o = obs(spark, sf).select("event_id", (F.col("tair") - 15).alias("t"), "mb", "rh", "qair",
                              (30.0 + F.col("event_id") % 7).alias("ss"))
    return o.withColumn("tf", T.freeze_pt("ss"))


@query("f11_saturation_with_ice", using("obs", extra=ICE) + """SELECT event_id, e,
  622e0*(1e0-0.02e0*ss/35e0)*e/(mb - 0.378e0*(1e0-0.02e0*ss/35e0)*e) AS q_sea,
  622e0*0.01e0*rh*e0/(mb - 0.378e0*0.01e0*rh*e0) AS q_air, 1e2*(qair*mb/(0.378e0*qair+0.622e0))/e AS rh_back FROM v""",
       keys="event_id", digits=8)
def f11(spark, sf):
    o = icy(spark, sf)
    return o.select("event_id", T.bucksat("t", "mb", "tf").alias("e"), T.qsat26sea("t", "mb", "ss", "tf").alias("q_sea"),
                    T.qsat26air("t", "mb", "rh")["q"].alias("q_air"), T.rh26("t", "mb", "qair", "tf").alias("rh_back"))


@query("f12_freezing_point", using("obs", extra=ICE) + "SELECT event_id, tf FROM f", keys="event_id")
def f12(spark, sf):
    return icy(spark, sf).select("event_id", "tf")


ALBEDO = ("alb AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {j}, {T.albedo_rule(0.05 * i, 2.0 * j)!r}::DOUBLE)" for i in range(21) for j in range(46)) + ") AS v(ti, aj, albedo))")
SUN = """s0 AS (SELECT event_id, 2e2 + U*20e0 AS sw, lat, lon, dayofyear(time) + (hour(time)*36e2 + minute(time)*6e1)/8.64e4 AS jd FROM obs),
  s1 AS (SELECT *, radians(23.45e0*cos(2e0*pi()*(jd-173e0)/365.25e0)) AS sd, pi()*(jd - floor(jd))*24e0/12e0 + radians(lon) AS h FROM s0),
  s2 AS (SELECT *, sin(radians(lat))*sin(sd) - cos(radians(lat))*cos(sd)*cos(h) AS sp FROM s1),
  s3 AS (SELECT event_id, sp >= 0 AS up, CASE WHEN sp >= 0 THEN degrees(asin(sp)) ELSE 0e0 END AS altitude,
    CASE WHEN sp >= 0 THEN 1380e0*sp ELSE 0e0 END AS solar_max,
    CASE WHEN sp >= 0 THEN least(2e0, sw/(1380e0*sp)) ELSE 0e0 END AS transmission FROM s2 WHERE sw IS NOT NULL),
  s4 AS (SELECT *, CAST(least(20, round_even(transmission/0.05e0, 0)) AS INT) AS ti, CAST(round_even(altitude/2e0, 0) AS INT) AS aj FROM s3)"""


@query("f13_albedo", using("obs", extra=SUN + ", " + ALBEDO) + """SELECT event_id,
  CASE WHEN up THEN albedo ELSE 0e0 END AS albedo, transmission, solar_max, altitude FROM s4 LEFT JOIN alb USING (ti, aj)""",
       keys="event_id", digits=7)
def f13(spark, sf):
    jd = F.dayofyear("time") + (F.hour("time") * 3600.0 + F.minute("time") * 60.0) / 86400.0
    o = obs(spark, sf).filter(F.col("U").isNotNull()).select("event_id", (200 + F.col("U") * 20).alias("sw"), jd.alias("jd"), "lon", "lat")
    return T.with_albedo(o, "sw", "jd", "lon", "lat").select("event_id", "albedo", "transmission", "solar_max", "altitude")


@query("f14_decimal_day", using("obs") + """SELECT event_id, dayofyear(time) + (hour(time)
  + (minute(time) + (second(time) + 0.125e0)/6e1)/6e1)/24e0 AS jd FROM obs""", keys="event_id", digits=7)
def f14(spark, sf):
    code = F.concat(F.lpad(F.minute("time").cast("string"), 2, "0"), F.lpad(F.second("time").cast("string"), 2, "0"), F.lit("125"))
    return obs(spark, sf).select("event_id", C.decimal_day(
        F.dayofyear("time").cast("string"), F.hour("time").cast("string"), code).alias("jd"))


@query("f15_day_of_year", using("cases") + """SELECT row_id, CAST(dayofyear(ts) AS INT) AS yday, CAST(month(ts) AS INT) AS mo,
  CAST(day(ts) AS INT) AS da FROM cases""", keys="*")
def f15(spark, sf):
    c = view(spark, sf, "cases").withColumn("yday", C.day_of_year(F.year("ts"), F.month("ts"), F.day("ts")))
    mo, da = C.month_day(F.year("ts"), F.col("yday"))
    return c.select("row_id", "yday", mo.alias("mo"), da.alias("da"))


@query("f16_yearday_to_time", using("cases") + """SELECT row_id, make_timestamp(epoch_us(make_timestamp(year(ts), 1, 1, 0, 0, 0))
  + CAST((dayofyear(ts) - 1 + (row_id % 1000)/1e3) * 8.64e10 AS BIGINT)) AS t FROM cases""", keys="*")
def f16(spark, sf):
    return view(spark, sf, "cases").select("row_id", C.yearday_to_time(
        F.year("ts"), F.dayofyear("ts") + (F.col("row_id") % 1000) / 1e3).alias("t"))


def rho_sql(s="salt", t="temp"):
    return f"""(999.842594e0 + 6.793952e-2*{t} - 9.095290e-3*pow({t},2) + 1.001685e-4*pow({t},3) - 1.120083e-6*pow({t},4)
    + 6.536332e-9*pow({t},5) + (8.24493e-1 - 4.0899e-3*{t} + 7.6438e-5*pow({t},2) - 8.2467e-7*pow({t},3) + 5.3875e-9*pow({t},4))*{s}
    + (-5.72466e-3 + 1.0227e-4*{t} - 1.6546e-6*pow({t},2))*pow({s},1.5e0) + 4.8314e-4*{s}*{s})"""


@query("f17_sea_water_density", using("prof") + f"SELECT pid, lev, {rho_sql()} AS rho FROM prof", keys="pid, lev", digits=7)
def f17(spark, sf):
    return view(spark, sf, "prof").select("pid", "lev", T.rho0("salt", "temp").alias("rho"))


@query("f18_log_ratio", using("obs") + "SELECT event_id, ln(zu/1e-4)/ln(1e1/1e-4) AS r FROM obs", keys="event_id")
def f18(spark, sf):
    return obs(spark, sf).select("event_id", T.log_ratio(1e-4, "zu", 10.0).alias("r"))


@query("f19_normal_density", using("obs") + """SELECT event_id,
  exp(-0.5e0*pow((taucx-pred_mean)/sqrt(pred_var), 2))/(sqrt(pred_var)*sqrt(2e0*pi())) AS f FROM obs""", keys="event_id")
def f19(spark, sf):
    return obs(spark, sf).select("event_id", T.normal_pdf("taucx", "pred_mean", F.sqrt("pred_var")).alias("f"))
