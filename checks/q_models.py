"""Network, training, weighting and chain queries."""

import math

from pyspark.sql import functions as F

from checks import models as N
from checks.fit_sql import gaussian_sql, predictions_sql, two_step_sql, variance_sql
from checks.models import net_sql
from checks.q_bulk import COEF, SIX, es, solver_sql
from checks.q_fields import MEAN
from checks.q_functions import ALBEDO, RH as _RH, SUN
from checks.q_sampling import nrm
from checks.registry import query
from checks.views import using, view
from halocline.operators import bulk as B, network as W, quality as Q, sampling as D, training as TR, weights as K
from halocline.plans.forcing import build_forcing, prepared_state
from halocline.plans.global_map import global_map
from halocline.plans.training_set import build_training, station_target
from halocline.session import scratch
from halocline.sources import sinks as S, text as R

OK = "obs_ok AS (SELECT * FROM obs WHERE U IS NOT NULL)"


def obs(spark, sf):
    return Q.complete_cases(view(spark, sf, "obs"), ["U"])


@query("m1_forward_pass", using("obs", extra=OK) + f"SELECT event_id, {net_sql(N.SH, 'mean')} AS sh_mean, {net_sql(N.SH, 'var')} AS sh_var FROM obs_ok",
       keys="event_id", digits=6)
def m1(spark, sf):
    return W.predict(obs(spark, sf), {"sh": N.SH}).select("event_id", "sh_mean", "sh_var")


SQ = N.demo("hsc", 5, -10.0, 15.0, var_activation="square")
SOFT = N.demo("hsc", 6, -10.0, 15.0, var_activation="softplus")


@query("m1_output_functions", using("obs", extra=OK) + f"SELECT event_id, {net_sql(SQ, 'var')} AS square_var, {net_sql(SOFT, 'var')} AS soft_var FROM obs_ok",
       keys="event_id", digits=6)
def m1b(spark, sf):
    return W.predict(obs(spark, sf), {"square": SQ, "soft": SOFT}).select("event_id", "square_var", "soft_var")


DIFF = N.demo("hsc", 7, -10.0, 15.0, diff=("tsea", "tair"))


@query("m2_difference_feature", using("obs", extra=OK) + f"SELECT event_id, {net_sql(DIFF, 'mean')} AS d_mean FROM obs_ok", keys="event_id", digits=6)
def m2(spark, sf):
    return W.predict(obs(spark, sf), {"d": DIFF}).select("event_id", "d_mean")


@query("m7_predict", using("obs", extra=OK) + f"""SELECT event_id, {net_sql(N.LH, 'mean')} AS lh_mean, {net_sql(N.LH, 'var')} AS lh_var,
  sqrt({net_sql(N.LH, 'var')}) AS lh_std FROM obs_ok""", keys="event_id", digits=6)
def m7(spark, sf):
    return W.predict(obs(spark, sf), {"lh": N.LH}).select("event_id", "lh_mean", "lh_var", F.sqrt("lh_var").alias("lh_std"))


@query("m8_predict_fluxes", using("obs", extra=OK) + f"""SELECT event_id, {net_sql(N.SH, 'mean')} AS qh_ann, sqrt({net_sql(N.SH, 'var')}) AS qh_std,
  {net_sql(N.LH, 'mean')} AS ql_ann, sqrt({net_sql(N.LH, 'var')}) AS ql_std, {net_sql(N.M, 'mean')}*cos(radians(wdir)) AS taux_ann,
  {net_sql(N.M, 'mean')}*sin(radians(wdir)) AS tauy_ann, abs(sqrt({net_sql(N.M, 'var')})*cos(radians(wdir))) AS taux_std,
  abs(sqrt({net_sql(N.M, 'var')})*sin(radians(wdir))) AS tauy_std FROM obs_ok""", keys="event_id", digits=6)
def m8(spark, sf):
    o = obs(spark, sf).withColumns({"cos": F.cos(F.radians("wdir")), "sin": F.sin(F.radians("wdir"))})
    return W.predict_fluxes(o, N.SH, N.LH, N.M, "hlc").select(
        "event_id", "qh_ann", "qh_std", "ql_ann", "ql_std", "taux_ann", "tauy_ann", "taux_std", "tauy_std")


RAW = ["U", "tsea", "tair", "rh0", "p"]


@query("m9_flux_from_state", using("obs", extra=OK + f", s AS (SELECT event_id, U, wdir, tsea, tair, {_RH} AS rh0, p FROM obs_ok)") + f"""SELECT event_id,
  {net_sql(N.M, 'mean', RAW)}*cos(radians(wdir)) AS taux, {net_sql(N.M, 'mean', RAW)}*sin(radians(wdir)) AS tauy,
  {net_sql(N.SH, 'mean', RAW)} AS Qs, {net_sql(N.LH, 'mean', RAW)} AS Ql FROM s""", keys="event_id", digits=6)
def m9(spark, sf):
    o = obs(spark, sf).select("event_id", (F.col("U") * F.cos(F.radians("wdir"))).alias("ux"), (F.col("U") * F.sin(F.radians("wdir"))).alias("uy"),
                              F.col("tsea").alias("To"), F.col("tair").alias("Ta"), "p", F.col("qair").alias("q"))
    return W.ann_flux(o, N.SH, N.LH, N.M).select("event_id", "taux", "tauy", "Qs", "Ql")


FOUR = {"LH": N.LH, "SH": N.SH, "M": N.M, "M_cross": N.M_CROSS}


@query("m10_four_fluxes", using("obs", extra=OK) + "SELECT event_id, " + ", ".join(
    f"{net_sql(m, 'mean')} AS {n}, {net_sql(m, 'var')} AS {n}_var" for n, m in FOUR.items()) + " FROM obs_ok", keys="event_id", digits=6)
def m10(spark, sf):
    return W.add_fluxes(obs(spark, sf), FOUR).select("event_id", *FOUR, *[f"{n}_var" for n in FOUR])


MEMBERS = [N.demo("hsc", 10 + i, -10.0, 15.0) for i in range(4)]


@query("m11_ensemble_prediction", using("obs", extra=OK) + ", e AS (SELECT event_id, " + ", ".join(
    f"{net_sql(m, 'mean')} AS y{i}, {net_sql(m, 'var')} AS v{i}" for i, m in enumerate(MEMBERS)) + """ FROM obs_ok)
  SELECT event_id, list_avg([y0,y1,y2,y3]) AS y_mean, list_stddev_pop([y0,y1,y2,y3]) AS y_std, list_avg([v0,v1,v2,v3]) AS sigma_mean,
    list_stddev_pop([v0,v1,v2,v3]) AS sigma_std FROM e""", keys="event_id", digits=6)
def m11(spark, sf):
    return W.predict_ensemble(obs(spark, sf), MEMBERS).select("event_id", "y_mean", "y_std", "sigma_mean", "sigma_std")


@query("m12_response_map", using("obs") + f""", b AS (SELECT pcode, avg(rh) AS rh, avg(p) AS p FROM obs GROUP BY pcode),
  g AS (SELECT pcode, rh, p, i*3e1/60 AS U, j*2e1/40 AS tair, 1e1 AS tsea FROM b CROSS JOIN range(61) x(i) CROSS JOIN range(41) y(j))
  SELECT pcode, U, tair, 'sh' AS model, {net_sql(N.SH, 'mean')} AS mean, sqrt({net_sql(N.SH, 'var')}) AS std FROM g UNION ALL
  SELECT pcode, U, tair, 'lh', {net_sql(N.LH, 'mean')}, sqrt({net_sql(N.LH, 'var')}) FROM g""", keys="pcode, model", digits=6)
def m12(spark, sf):
    base = view(spark, sf, "obs").groupBy("pcode").agg(F.avg("rh").alias("rh"), F.avg("p").alias("p"))
    grid = D.feature_grid(base, {"U": (0.0, 30.0, 61), "tair": (0.0, 20.0, 41)}, {"tsea": 10.0})
    return W.response_map(grid, {"sh": N.SH, "lh": N.LH}).select("pcode", "U", "tair", "model", "mean", "std")


FAST = TR.FitParams(epochs=3, batches=2, lr=0.02)
FEATURES = ["U", "tsea", "tair", "rh"]


def _log(spark, log):
    return TR.log_table(spark, log)


def _fit(parts, log):
    return using("obs", extra=OK + ", " + ", ".join(parts)) + log


KEYS = "model, epoch, role, metric"


@query("m3_fit_gaussian", _fit(*gaussian_sql("obs_ok", "event_id", FEATURES, "taucx", 8, FAST, w="weight")), digits=6, keys=KEYS)
def m3(spark, sf):
    return _log(spark, TR.fit_gaussian(obs(spark, sf), FEATURES, ["taucx"], "event_id", [8], "weight", params=FAST)[1])


LONGER = TR.FitParams(epochs=8, batches=2, lr=0.02, reshuffle=False)


@query("m3_fitted_predictions", _fit(*predictions_sql("obs_ok", "event_id", FEATURES, "taucx", 8, LONGER, w="weight")), digits=6, keys="event_id")
def m3_predictions(spark, sf):
    """What the fitted model predicts for every row."""
    model = TR.fit_gaussian(obs(spark, sf), FEATURES, ["taucx"], "event_id", [8], "weight", params=LONGER)[0]
    return W.predict(obs(spark, sf), {"m": model}).select("event_id", F.col("m_mean").alias("mean"), F.col("m_var").alias("var"))


@query("m4_fit_two_step", _fit(*two_step_sql("obs_ok", "event_id", FEATURES, "taucx", 8, FAST, w="weight")), digits=6, keys=KEYS)
def m4(spark, sf):
    return _log(spark, TR.fit_gaussian(obs(spark, sf), FEATURES, ["taucx"], "event_id", [8], "weight", params=FAST, two_step=True)[1])


SWEEP = [gaussian_sql("obs_ok", "event_id", FEATURES, o, 8, FAST, s, label=f"{o}_{s}", tag=f"{o[0]}{s}") for o in ("taucx", "hsc") for s in (0, 1)]


@query("m5_fit_sweep", _fit([c for parts, _ in SWEEP for c in parts], " UNION ALL ".join(log for _, log in SWEEP)), digits=6, keys=KEYS)
def m5(spark, sf):
    grid = {f"{o}_{s}": {"okeys": [o], "seed": s} for o in ("taucx", "hsc") for s in (0, 1)}
    return _log(spark, TR.fit_sweep(obs(spark, sf), grid, FEATURES, "event_id", [8], params=FAST)[1])


LOG6 = gaussian_sql("obs_ok", "event_id", FEATURES, "hsc", 8, FAST)


@query("m6_training_log", _fit(LOG6[0], f"""SELECT epoch, role, max(value) FILTER (metric = 'nll') AS nll, max(value) FILTER (metric = 'r2') AS r2
  FROM ({LOG6[1]}) WHERE metric IN ('nll', 'r2') GROUP BY epoch, role"""), digits=6, keys="epoch, role")
def m6(spark, sf):
    model, log = TR.fit_gaussian(obs(spark, sf), FEATURES, ["hsc"], "event_id", [8], params=FAST)
    return _log(spark, log).filter("metric IN ('nll', 'r2')").groupBy("epoch", "role").pivot("metric", ["nll", "r2"]).agg(F.first("value"))


VAR_MODEL = N.demo("hsc", 8, -10.0, 15.0)


@query("m15_fit_variance", _fit(*variance_sql("obs_ok", "event_id", VAR_MODEL, FAST)), digits=6, keys=KEYS)
def m15(spark, sf):
    return _log(spark, TR.fit_variance_mse(obs(spark, sf), VAR_MODEL, "event_id", params=FAST)[1])


@query("s19_open_case", using("obs", extra=OK) + f"SELECT event_id, {net_sql(N.M, 'mean')} AS m_mean, {net_sql(N.M, 'var')} AS m_var FROM obs_ok",
       keys="event_id", digits=7)
def s19(spark, sf):
    path = scratch(spark, "case")
    S.save_case(spark, N.M, path, "m")
    return W.predict(obs(spark, sf), {"m": S.open_case(spark, path, "m")}).select("event_id", "m_mean", "m_var")


def station(spark, sf):
    return R.with_station_state(view(spark, sf, "station").withColumnRenamed("time", "datetime"))


STATE_RH = "1e2*((p/1e2)*q/(0.622e0+0.378e0*q))/(6.1121e0*exp(17.502e0*t/(240.97e0+t))*(1.0007e0+p/1e2*3.46e-6))"


def weights_sql(sample, target, cols, key, target_key, folds=5, seed=0, centres=100, tol=1e-2):
    """The fixed point for the kernel shares as a recursion over (width, fold), to the same tolerance; shares are lists of one number a centre.

    The texts that use it begin with WITH RECURSIVE.
    """
    d2 = " + ".join(f"pow(a.z{i}-c.z{i}, 2)" for i in range(len(cols)))
    z = ", ".join(f"({c}-m{i})/d{i} AS z{i}" for i, c in enumerate(cols))
    gammas = ", ".join(f"({i}, {g!r}::DOUBLE)" for i, g in enumerate(K.GAMMAS))
    ratio = ", ".join(f"sum(p[{i}]/mix)/count(*)" for i in range(1, centres + 1))
    scaled = "list_transform(list_zip(s1, q1), lambda x: x[1]*pow(x[2], w1))"

    def fit(name, pairs):
        return f"""{name} AS (SELECT g, k, list_transform(range({centres}), lambda x: 1e0/{centres}) AS s, list_transform(range({centres}), lambda x: 1e0/{centres}) AS s0,
             list_transform(range({centres}), lambda x: 1e0) AS q0, -1e308::DOUBLE AS f0, 1e0::DOUBLE AS w, false AS done FROM {pairs}
           UNION ALL
           SELECT g, k, list_transform(y, lambda x: x/greatest(list_sum(y), 1e-300)), s1, q1, f1, w1, f >= f0 AND list_max(q1) - 1 < {tol!r}::DOUBLE FROM (
             SELECT *, {scaled} AS y FROM (
               SELECT g, k, f, f0, CASE WHEN f >= f0 THEN s ELSE s0 END AS s1, CASE WHEN f >= f0 THEN q ELSE q0 END AS q1, greatest(f, f0) AS f1,
                 CASE WHEN f >= f0 THEN w*1.5e0 ELSE 1e0 END AS w1 FROM (
                 SELECT g, k, any_value(s) AS s, any_value(s0) AS s0, any_value(q0) AS q0, any_value(f0) AS f0, any_value(w) AS w,
                   sum(ln(mix))/count(*) AS f, [{ratio}] AS q FROM (
                   SELECT {name}.*, p, greatest(list_dot_product(s, p), 1e-300) AS mix FROM {name} JOIN ph USING (g) WHERE NOT done AND fold <> k) GROUP BY g, k))))"""

    return ", ".join([
        "sc AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(cols)) + f" FROM {sample})",
        f"sa AS (SELECT {key}, {z} FROM {sample} CROSS JOIN sc)",
        f"t0 AS (SELECT {z}, md5('{seed}:' || {target_key}) AS h FROM {target} CROSS JOIN sc)",
        f"ta AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY h) AS j, ('0x' || substr(h, 30, 3))::BIGINT % {folds} AS fold FROM t0)",
        f"ce AS (SELECT * FROM ta WHERE j <= {centres})", f"gm AS (SELECT * FROM (VALUES {gammas}) AS v(g, gamma))",
        f"mn AS MATERIALIZED (SELECT g, c.j AS l, greatest(avg(exp(-gamma*({d2}))), 1e-300) AS m FROM sa a CROSS JOIN ce c CROSS JOIN gm GROUP BY g, c.j)",
        f"ph AS MATERIALIZED (SELECT g, any_value(a.fold) AS fold, list(exp(-gamma*({d2}))/m ORDER BY c.j) AS p FROM ta a CROSS JOIN ce c CROSS JOIN gm JOIN mn USING (g) "
        "WHERE mn.l = c.j GROUP BY g, a.j)",
        fit("em", f"gm CROSS JOIN range({folds}) r(k)"),
        "be AS (SELECT g FROM em JOIN ph USING (g) WHERE done AND fold = k GROUP BY g ORDER BY sum(ln(greatest(list_dot_product(s0, p), 1e-300)))/count(*) DESC LIMIT 1)",
        fit("all_rows", f"(SELECT g, {folds} AS k FROM be)"), "fit AS (SELECT g, k, s0 AS s FROM all_rows WHERE done)",
        f"al AS (SELECT l, gamma, s[l]/m AS a FROM fit JOIN mn USING (g) JOIN gm USING (g) JOIN be USING (g) WHERE k = {folds})",
        f"wt AS (SELECT a.{key}, sum(al.a*exp(-gamma*({d2}))) AS w FROM sa a CROSS JOIN ce c JOIN al ON al.l = c.j GROUP BY a.{key})"])


def recursive(text):
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


SAMPLE = f"""smp AS (SELECT event_id, U, tsea-tair AS tdiff, rh FROM obs WHERE U IS NOT NULL),
  tgt AS (SELECT time AS datetime, sqrt(ux*ux+uy*uy) AS U, sst-t AS tdiff, {STATE_RH} AS rh FROM station)"""


@query("d4_importance_weights", recursive(using("obs", "station", extra=SAMPLE + ", " + weights_sql(
    "smp", "tgt", ["U", "tdiff", "rh"], "event_id", "datetime")) + "SELECT * FROM wt"), keys="event_id", digits=5)
def d4(spark, sf):
    o = obs(spark, sf).withColumn("tdiff", F.col("tsea") - F.col("tair"))
    return K.importance_weights(o, station_target(station(spark, sf)), ["U", "tdiff", "rh"], "event_id", "w", target_key="datetime").select("event_id", "w")


CELLS_60 = """smp AS (SELECT event_id, tsea AS sst, rh AS phs0 FROM obs WHERE U IS NOT NULL),
  tgt AS (SELECT sst, phs0, concat_ws('|', ts, lat, lon) AS cell FROM grid WHERE lat < 60 AND sst IS NOT NULL)"""


@query("d5_global_weights", recursive(using("obs", "grid", extra=CELLS_60 + ", " + weights_sql("smp", "tgt", ["sst", "phs0"], "event_id", "cell"))
       + "SELECT * FROM wt"), keys="event_id", digits=5)
def d5(spark, sf):
    o = obs(spark, sf).select("event_id", F.col("tsea").alias("sst"), F.col("rh").alias("phs0"))
    g = view(spark, sf, "grid").withColumn("cell", F.concat_ws("|", F.col("ts").cast("string"), F.col("lat").cast("string"), F.col("lon").cast("string")))
    return K.global_weights(o, g, ["sst", "phs0"], "event_id", name="w", target_key="cell").select("event_id", "w")


@query("l1_build_training", recursive(using("obs", "station", extra=OK + ", " + SAMPLE + ", " + weights_sql(
    "smp", "tgt", ["U", "tdiff", "rh"], "event_id", "datetime") + f", solved AS (WITH {solver_sql(humidity='qair')} SELECT event_id, U, o_tau AS taubx, "
    "-o_hs AS hsb, -o_hl AS hlb FROM sol)") + """SELECT event_id, U, taubx, hsb, hlb, w AS weight, 'bulk36' AS bulkalg, CAST(1 AS INT) AS weighting
  FROM solved JOIN wt USING (event_id)"""), keys="event_id, bulkalg, weighting", digits=5)
def l1(spark, sf):
    raw = view(spark, sf, "obs").select(
        "event_id", "time", "pcode", "U", F.col("tsea").alias("tsnk"), F.col("tair").alias("ta"), (F.col("qair") * 1e3).alias("qa"),
        (F.col("p") / 100).alias("dummy1"), F.col("rh").alias("dummy2"), F.col("wdir").alias("dir"), "zu", "zt", "zq", "lon", "lat",
        "taucx", "taucy", "hsc", "hlc")
    path = scratch(spark, "training")
    build_training(raw, "event_id", "bulk36", station_target(station(spark, sf)), path, target_key="datetime")
    return spark.read.parquet(path).select("event_id", "U", "taubx", "hsb", "hlb", "weight", "bulkalg", "weighting")


_COLS = ["sst", "t", "p", "heat", "lwr", "U", "rh", "c", "sn"]
# Hourly values between the station's own times, then the dates, then the step.
HOURLY = f"""s0 AS (SELECT *, sqrt(ux*ux+uy*uy) AS U, ux/sqrt(ux*ux+uy*uy) AS c, uy/sqrt(ux*ux+uy*uy) AS sn, {STATE_RH} AS rh FROM station),
  s1 AS (SELECT *, lead(time) OVER w AS t1, {', '.join(f'lead({c}) OVER w AS {c}_1' for c in _COLS)} FROM s0 WINDOW w AS (ORDER BY time)),
  hr AS (SELECT unnest(range((SELECT min(time) FROM s0), (SELECT max(time) + INTERVAL 1 HOUR FROM s0), INTERVAL 1 HOUR)) AS tt),
  s2 AS (SELECT *, coalesce(date_diff('microsecond', time, tt)/date_diff('microsecond', time, t1)::DOUBLE, 0) AS f FROM hr JOIN s1
     ON tt >= time AND (tt < t1 OR (t1 IS NULL AND tt = time))),
  s AS (SELECT tt AS time, {', '.join(f'CASE WHEN f = 0 THEN {c} ELSE {c} + ({c}_1-{c})*f END AS {c}' for c in _COLS)} FROM s2
     WHERE tt >= TIMESTAMP '2024-01-03' AND tt < TIMESTAMP '2024-01-21')"""
STATE = HOURLY + f""",
  w AS (SELECT time_bucket(INTERVAL 3 HOUR, time, TIMESTAMP '1970-01-01') AS datetime, avg(U) AS U, avg(sst) AS tsea, avg(t) AS tair, avg(rh) AS rh,
     avg(p) AS p, avg(lwr) AS lwr, avg(c) AS c, avg(sn) AS sn FROM s GROUP BY 1),
  st AS (SELECT *, row_number() OVER (ORDER BY datetime) - 1 AS i, {net_sql(N.SH, 'mean')} + {net_sql(N.LH, 'mean')} + lwr AS heat,
     sqrt({net_sql(N.SH, 'var')} + {net_sql(N.LH, 'var')}) AS sd_heat, {net_sql(N.M, 'mean')}*c AS taux, {net_sql(N.M, 'mean')}*sn AS tauy,
     abs(sqrt({net_sql(N.M, 'var')})*c) AS sd_taux, abs(sqrt({net_sql(N.M, 'var')})*sn) AS sd_tauy FROM w)"""


@query("l2_prepared_state", using("station", extra=HOURLY) + """SELECT time_bucket(INTERVAL 3 HOUR, time, TIMESTAMP '1970-01-01') AS datetime,
  avg(sst) AS tsea, avg(t) AS tair, avg(U) AS U, avg(heat) AS heat, CASE WHEN avg(U) <> 0 THEN 1e1 END AS zu FROM s GROUP BY 1""", keys="datetime", digits=7)
def l2a(spark, sf):
    return prepared_state(station(spark, sf), "2024-01-03", "2024-01-20").select("datetime", "tsea", "tair", "U", "heat", "zu")


def _noise(flux, seed, members):
    """Red noise with a = 0.95 on the 3-hourly state, as a sum over all earlier innovations."""
    return f"""b_{flux} AS (SELECT m::INT AS ensem, i, CASE WHEN i = 0 THEN 1e0 ELSE {math.sqrt(1 - 0.95 * 0.95)!r}::DOUBLE END*sd_{flux}*{nrm(seed, 'i', 'm')} AS b
     FROM st CROSS JOIN range(1, {members + 1}) t(m)),
  e_{flux} AS (SELECT c.ensem, c.i, sum(p.b*pow(0.95e0, c.i-p.i)) AS eps FROM b_{flux} c JOIN b_{flux} p ON p.ensem = c.ensem AND p.i <= c.i GROUP BY 1, 2)"""


@query("l2_forcing_heat", using("station", extra=STATE + ", " + _noise("heat", 5, 4)) +
       "SELECT ensem, datetime, heat + eps AS heat FROM st JOIN e_heat USING (i)", keys="ensem, datetime", digits=6)
def l2(spark, sf):
    return build_forcing(station(spark, sf), {"SH": N.SH, "LH": N.LH, "M": N.M}, "2024-01-03", "2024-01-20", members=4, seed=5,
                         path=scratch(spark, "forcing"))


@query("l2_forcing_momentum", using("station", extra=STATE + ", " + _noise("taux", 5, 3) + ", " + _noise("tauy", 7, 3)) +
       """SELECT x.ensem, datetime, taux + x.eps AS taux, tauy + y.eps AS tauy FROM st JOIN e_taux x USING (i)
  JOIN e_tauy y ON y.i = st.i AND y.ensem = x.ensem""", keys="ensem, datetime", digits=6)
def l2c(spark, sf):
    return build_forcing(station(spark, sf), {"SH": N.SH, "LH": N.LH, "M": N.M}, "2024-01-03", "2024-01-20", "momentum", members=3, seed=5)


CELLS = """air AS (SELECT point_id, lat, lon, 3+air/2 AS ux, 4-air/3 AS uy, 12+air/2 AS Ta FROM points),
  cell AS (SELECT a.* EXCLUDE (Ta), b.sst AS tsea, a.Ta AS tair, 0.007e0 AS qair, 101325e0 AS p, sqrt(ux*ux+uy*uy) AS U, 1e1 AS zu, 1e1 AS zt, 1e1 AS zq
     FROM air a JOIN b USING (point_id) WHERE b.n = 4), """
COLS = ["U", "tsea", "tair", "rh_", "p"]


@query("l6_global_map", using("grid", "points", extra=MEAN + ", " + CELLS + solver_sql(src="cell", humidity="qair")) + f""",
  z AS (SELECT *, {_RH} AS rh_ FROM sol)
  SELECT point_id, lat, lon, {net_sql(N.SH, 'mean', COLS)} AS Qs, {net_sql(N.LH, 'mean', COLS)} AS Ql, {net_sql(N.M, 'mean', COLS)}*ux/U AS taux,
    {net_sql(N.M, 'mean', COLS)}*uy/U AS tauy, -o_hs AS hsb, -o_hl AS hlb,
    {net_sql(N.SH, 'mean', COLS)} + {net_sql(N.LH, 'mean', COLS)} + o_hs + o_hl AS dq FROM z""", keys="point_id", digits=4)
def l6(spark, sf):
    ocean = view(spark, sf, "grid").groupBy("lat", "lon").agg(F.avg("sst").alias("sst"))
    air = view(spark, sf, "points").select("point_id", "lat", "lon", (3 + F.col("air") / 2).alias("ux"), (4 - F.col("air") / 3).alias("uy"),
                                           (12 + F.col("air") / 2).alias("Ta"), F.lit(0.007).alias("q"), F.lit(101325.0).alias("p"))
    return global_map(ocean, air, {"SH": N.SH, "LH": N.LH, "M": N.M})


LIT = f"""lit AS (WITH {SUN}, {ALBEDO}
  SELECT obs_ok.*, (2e2 + U*20e0)*(1e0 - CASE WHEN up THEN albedo ELSE 0e0 END) AS light FROM obs_ok JOIN s4 USING (event_id) LEFT JOIN alb USING (ti, aj)), """


@query("b2_albedo", using("obs", extra=OK + ", " + LIT + solver_sql(src="lit", cool=True, light="light")) + SIX, keys="event_id", digits=6)
def b2_albedo(spark, sf):
    """The cool skin under sunlight that is reflected by the table's albedo."""
    jd = F.dayofyear("time") + (F.hour("time") * 3600.0 + F.minute("time") * 60.0) / 86400.0
    o = obs(spark, sf).withColumns({"sw": 200 + F.col("U") * 20, "jd": jd})
    return B.bulk36(o, cool_skin=True, albedo=True).select("event_id", "tau", "hs", "hl", "cd", "ch", "ce")


AIR = f"0.01e0*rh*{es('tair')}"
TOLD = f"""obs_ok AS (SELECT event_id, U, tsea, tair, rh, p, 1e1 AS zt, 1e1 AS zq, 0.622e0*{AIR}/(p/1e2 - 0.378e0*{AIR}) AS qair FROM obs WHERE U IS NOT NULL), {COEF},
  nn AS (SELECT *, {net_sql(N.SH, 'mean')} AS sh, {net_sql(N.LH, 'mean')} AS lh, {net_sql(N.M, 'mean')} AS m, {net_sql(N.M_CROSS, 'mean')} AS mc FROM co)"""


@query("b8_flux_point_predictor", using("obs", extra=TOLD) + """SELECT event_id, m AS tau, -sh AS hs, -lh AS hl, sqrt(m*m + mc*mc)/(U*U*rho) AS cd,
  CASE WHEN abs(ch) < 100 THEN ch END AS ch, CASE WHEN abs(ce) < 100 THEN ce END AS ce FROM (SELECT *,
  sh/nullif(U*(tair+0.0098e0*zt-tsea)*1004.67e0*rho, 0) AS ch, lh/nullif(U*(qair-qsea)*le*rho, 0) AS ce FROM nn)""", keys="event_id", digits=6)
def b8_predictor(spark, sf):
    """Heat coefficients where the air is not all but as warm or as moist as the sea; beyond 100 they are rounding errors."""
    o = obs(spark, sf).select("event_id", "U", "tsea", "tair", "rh", "p")
    return B.flux_point(o, models={"SH": N.SH, "LH": N.LH, "M": N.M, "M_cross": N.M_CROSS}).select(
        "event_id", "tau", "hs", "hl", "cd", *[F.when(F.abs(c) < 100, F.col(c)).alias(c) for c in ("ch", "ce")])


@query("j6_scores_from_a_table", using("obs", extra=OK) + f"SELECT event_id, {net_sql(N.SH, 'mean')} AS sh_mean, {net_sql(N.SH, 'var')} AS sh_var FROM obs_ok",
       keys="event_id", digits=6)
def j6(spark, sf):
    """A model that lies in a table, one row a weight, sent to the rows it scores."""
    table = spark.createDataFrame(N.SH.rows(), "head string, layer int, i int, j int, w double")
    model = W.FluxModel.restore(N.SH.config(), [tuple(r) for r in table.collect()])  # a few hundred numbers
    return W.predict(obs(spark, sf), {"sh": model}).select("event_id", "sh_mean", "sh_var")
