"""Projection, filter and mask queries."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import using, view
from halocline.operators import quality as Q


def obs(spark, sf):
    return view(spark, sf, "obs")


@query("p1_complete_cases", using("obs") + "SELECT event_id, U, taucx FROM obs WHERE U IS NOT NULL", keys="event_id")
def p1(spark, sf):
    return Q.complete_cases(obs(spark, sf), ["U", "tsea", "taucx"]).select("event_id", "U", "taucx")


@query("p2_rename_keep", using("obs") + "SELECT event_id, U AS wspd, tsea AS sst FROM obs", keys="event_id")
def p2(spark, sf):
    return Q.harmonise(obs(spark, sf), {"event_id": "event_id", "wspd": "U", "sst": "tsea"})


@query("p3_units_and_signs", using("obs") +
       "SELECT event_id, qair*1e3 AS q_g, p/1e2 AS p_mb, -hsc AS hs_up, tsea + 273.15e0 AS sst_k FROM obs", keys="event_id")
def p3(spark, sf):
    return Q.harmonise(obs(spark, sf), {
        "event_id": "event_id", "q_g": {"from": "qair", "scale": 1000.0}, "p_mb": {"from": "p", "scale": 0.01},
        "hs_up": {"from": "hsc", "sign": -1}, "sst_k": {"from": "tsea", "add": 273.15}})


@query("p4_qc_filter", using("obs") + "SELECT event_id, qc FROM obs WHERE qc = 0", keys="*")
def p4(spark, sf):
    return Q.qc_ok(obs(spark, sf)).select("event_id", "qc")


@query("p5_covariance_to_flux", using("obs") +
       """SELECT event_id, -(hsc/1.2e3)*1004.67e0*1.2e0 AS hsc, -(-taucx/1.2e0)*1.2e0 AS taucx,
          -(-taucy/1.2e0)*1.2e0 AS taucy FROM obs""", keys="event_id")
def p5(spark, sf):
    o = obs(spark, sf).select("event_id", (-F.col("taucx") / 1.2).alias("uw"), (-F.col("taucy") / 1.2).alias("vw"),
                              (F.col("hsc") / 1.2e3).alias("wt"), F.lit(1004.67).alias("cpa"), F.lit(1.2).alias("rhoair"))
    return Q.cov_to_flux(o).select("event_id", "hsc", "taucx", "taucy")


@query("p6_constant_where_present", using("obs") +
       "SELECT event_id, CASE WHEN U IS NOT NULL AND U <> 0 THEN 1e1 END AS zu FROM obs", keys="event_id")
def p6(spark, sf):
    return obs(spark, sf).select("event_id", Q.const_like("U", 10.0).alias("zu"))


WIND = """w AS (SELECT event_id, pcode, taucx, U*cos(radians(wdir)) AS ux, U*sin(radians(wdir)) AS uy FROM obs),
  v AS (SELECT *, sqrt(ux*ux + uy*uy) AS s FROM w)"""


def wind(spark, sf):
    return obs(spark, sf).select("event_id", "taucx", (F.col("U") * F.cos(F.radians("wdir"))).alias("ux"),
                                 (F.col("U") * F.sin(F.radians("wdir"))).alias("uy"))


@query("p7_wind_parts", using("obs", extra=WIND) +
       "SELECT event_id, s AS U, ux/nullif(s,0) AS cos, uy/nullif(s,0) AS sin FROM v", keys="event_id")
def p7(spark, sf):
    return Q.wind_parts(wind(spark, sf)).select("event_id", "U", "cos", "sin")


@query("p8_rotate_stress", using("obs", extra=WIND) +
       """SELECT event_id, taucx*ux/s AS taux, taucx*uy/s AS tauy, abs(0.1e0*ux/s) AS taux_std,
          abs(0.1e0*uy/s) AS tauy_std FROM v""", keys="event_id")
def p8(spark, sf):
    w = Q.wind_parts(wind(spark, sf), eps=1e-8).withColumn("sd", F.lit(0.1))
    return Q.rotate_stress(w, "taucx", "sd").select("event_id", "taux", "tauy", "taux_std", "tauy_std")


RANGES = {"U": (1.0, 20.0), "tair": (8.0, 30.0), "p": (100200.0, 102500.0)}


@query("p9_range_filter", using("obs") + """SELECT event_id, U FROM obs
  WHERE U BETWEEN 1 AND 20 AND tair BETWEEN 8 AND 30 AND p BETWEEN 100200 AND 102500""", keys="event_id")
def p9(spark, sf):
    return Q.in_range(obs(spark, sf), RANGES).select("event_id", "U")


@query("p9_range_counts", using("obs") + """SELECT
  CAST(sum(CASE WHEN U BETWEEN 1 AND 20 THEN 0 ELSE 1 END) AS BIGINT) AS U_bad,
  CAST(sum(CASE WHEN tair BETWEEN 8 AND 30 THEN 0 ELSE 1 END) AS BIGINT) AS tair_bad,
  CAST(sum(CASE WHEN p BETWEEN 100200 AND 102500 THEN 0 ELSE 1 END) AS BIGINT) AS p_bad FROM obs""", keys="*")
def p9b(spark, sf):
    return Q.range_report(obs(spark, sf), RANGES)


@query("p9_range_blank", using("obs") + """SELECT event_id, CASE WHEN U BETWEEN 1 AND 20 THEN U END AS U,
  CASE WHEN tair BETWEEN 8 AND 30 THEN tair END AS tair FROM obs""", keys="event_id")
def p9c(spark, sf):
    return Q.in_range(obs(spark, sf), RANGES, "null").select("event_id", "U", "tair")


@query("p10_default_pressure", using("obs") + """SELECT event_id,
  CASE WHEN p > 100300 AND p < 102000 THEN p ELSE 101000e0 END AS p FROM obs""", keys="event_id")
def p10(spark, sf):
    return obs(spark, sf).select("event_id", Q.clip_or_default("p", 100300, 102000, 101000).alias("p"))


@query("p11_plausible", using("obs") + """SELECT CAST(avg(p) BETWEEN 60000 AND 150000 AS INT) AS p_ok,
  CAST(avg(rh) BETWEEN 0 AND 120 AS INT) AS rh_ok, avg(p) AS p_mean, avg(rh) AS rh_mean FROM obs""", digits=6,
       keys="p_ok, rh_ok")
def p11(spark, sf):
    return Q.plausible(obs(spark, sf))


@query("p12_wet_mask", using("grid") + """SELECT ts, lat, lon, sst, CASE WHEN wet = 1 THEN phs0 END AS phs0
  FROM grid WHERE sst IS NOT NULL""", keys="ts")
def p12(spark, sf):
    g = Q.apply_mask(Q.wet_only(view(spark, sf, "grid")), "wet", ["phs0"])
    return g.select("ts", "lat", "lon", "sst", "phs0")


@query("p13_grid_to_samples", using("grid") +
       "SELECT sst, phs0, plp0 FROM grid WHERE lat < 30 AND sst IS NOT NULL AND phs0 IS NOT NULL")
def p13(spark, sf):
    return Q.grid_to_samples(view(spark, sf, "grid"), ["sst", "phs0", "plp0"], 30.0)


@query("p14_longitude", using("obs") +
       "SELECT event_id, CASE WHEN lon > 0 THEN lon ELSE 360 + lon END AS lon FROM obs", keys="event_id")
def p14(spark, sf):
    return Q.norm_lon(obs(spark, sf)).select("event_id", "lon")


@query("p15_outliers", using("obs") + """SELECT event_id, hsc FROM obs
  WHERE abs(-hsc/(U + 1e-8)/(tair - tsea + 1e-8)) < 1e2""", keys="event_id")
def p15(spark, sf):
    ch = -F.col("hsc") / (F.col("U") + 1e-8) / (F.col("tair") - F.col("tsea") + 1e-8)
    return Q.drop_outliers(obs(spark, sf), ch, 100.0).select("event_id", "hsc")


@query("p15_outlier_counts", using("obs") + """SELECT count(*) AS before, count(*) FILTER (abs(hsc) < 2e1) AS after
  FROM obs""", keys="*")
def p15b(spark, sf):
    return Q.outlier_report(obs(spark, sf), F.col("hsc"), 20.0)


@query("p16_regime", using("obs") + """SELECT event_id, hlc FROM obs
  WHERE U > 8 AND U < 9 AND rh > 70 AND rh < 80 AND tair - tsea > -3 AND tair - tsea < 3""", keys="event_id")
def p16(spark, sf):
    return Q.regime(obs(spark, sf), {"U": (8, 9), "rh": (70, 80), "tair - tsea": (-3, 3)}).select("event_id", "hlc")


@query("p17_time_slice", using("obs") + """SELECT event_id, U FROM obs
  WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-13'""", keys="event_id")
def p17(spark, sf):
    return Q.time_slice(obs(spark, sf), "2024-01-05", "2024-01-12").select("event_id", "U")


@query("p17_year_and_month", using("cases") +
       "SELECT row_id, sst FROM cases WHERE year(ts) = 1997 AND month(ts) = 5", keys="row_id")
def p17b(spark, sf):
    return Q.in_month(Q.in_year(view(spark, sf, "cases"), 1997, "ts"), 5, "ts").select("row_id", "sst")


@query("p18_groups", using("obs") + "SELECT event_id, pcode FROM obs WHERE pcode IN (77, 67, 72)", keys="*")
def p18(spark, sf):
    return Q.by_group(obs(spark, sf), [77, 67, 72]).select("event_id", "pcode")


@query("p19_label", using("obs") +
       "SELECT event_id, CASE WHEN pcode IN (77, 69) THEN 'east' ELSE 'other' END AS label FROM obs", keys="*")
def p19(spark, sf):
    return obs(spark, sf).select("event_id", Q.label_as("pcode", [77, 69], "east", "other").alias("label"))


@query("p20_angle", using("obs") + """SELECT event_id, cos(radians(wdir - lon)) AS cos_angle,
  zu*cos(radians(wdir - lon)) AS zu_along FROM obs""", keys="event_id")
def p20(spark, sf):
    return Q.angle_cos(obs(spark, sf), "wdir", "lon", "zu").select("event_id", "cos_angle", "zu_along")


@query("p21_features", using("obs") + """SELECT event_id, U AS x1, tair - tsea AS x2, rh AS x3, taucx AS y1, hsc AS y2,
  hlc AS y3, hlb AS b3, weight AS w FROM obs""", keys="event_id")
def p21(spark, sf):
    a = Q.assemble(obs(spark, sf), "U_Tdiff_rh", ["taucx", "hsc", "hlc"], ["taubx", "hsb", "hlb"], "weight")
    return a.select("event_id", *[F.col("x")[i].alias(f"x{i + 1}") for i in range(3)],
                    *[F.col("y")[i].alias(f"y{i + 1}") for i in range(3)], F.col("bulk")[2].alias("b3"), "w")


@query("p22_residual_target", using("obs") +
       "SELECT event_id, taucx - taubx AS taucx_res, hsc - hsb AS hsc_res FROM obs", keys="event_id")
def p22(spark, sf):
    return Q.residual_target(obs(spark, sf), {"taucx": "taubx", "hsc": "hsb"}).select("event_id", "taucx_res", "hsc_res")


@query("p23_step_weight", using("obs") +
       "SELECT event_id, CASE WHEN U > 18 THEN 1e2 ELSE 1e0 END AS w FROM obs", keys="event_id")
def p23(spark, sf):
    return Q.with_weight(obs(spark, sf), Q.step_weight, "U", "w").select("event_id", "w")


@query("p24_far_mask", using("obs") + "SELECT event_id, hlc, hlb FROM obs WHERE abs(hlb - hlc) > 8", keys="event_id")
def p24(spark, sf):
    return Q.far_mask(obs(spark, sf), F.col("hlb"), F.col("hlc"), 8.0).select("event_id", "hlc", "hlb")


@query("p25_fill", using("obs") + "SELECT event_id, coalesce(U, 0) AS U, 0e0 AS phs0 FROM obs", keys="event_id")
def p25(spark, sf):
    return Q.fill_missing(obs(spark, sf), ["U", "phs0"]).select("event_id", "U", "phs0")


@query("p26_update_where", using("obs") +
       "SELECT event_id, CASE WHEN pcode IN (69, 87) THEN zu + 2.5e0 ELSE zu END AS zu FROM obs", keys="event_id")
def p26(spark, sf):
    return Q.update_where(obs(spark, sf), F.col("pcode").isin(69, 87), "zu", F.col("zu") + 2.5).select("event_id", "zu")


@query("p27_columns_by_pattern", using("obs") + "SELECT hsb, hsc, hlb, hlc FROM obs")
def p27(spark, sf):
    return Q.cols_like(obs(spark, sf), "h[sl][bc]")


@query("p28_region_box", using("obs") +
       "SELECT event_id, lat, lon FROM obs WHERE lon BETWEEN -100 AND 20 AND lat BETWEEN -30 AND 45", keys="event_id")
def p28(spark, sf):
    return Q.region_box(obs(spark, sf), (-100, 20), (-30, 45)).select("event_id", "lat", "lon")


@query("p29_ustar", using("obs") + """SELECT event_id, sqrt(sqrt(taucx*taucx + taucy*taucy)/1.2e0) AS ustar,
  taucy/nullif(taucx, 0) AS cross_ratio FROM obs""", keys="event_id", digits=7)
def p29(spark, sf):
    return Q.ustar(obs(spark, sf), "taucx", "taucy").select("event_id", "ustar", "cross_ratio")
