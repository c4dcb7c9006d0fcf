"""Score queries."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import using, view
from halocline.operators import metrics as M, quality as Q

OK = "obs_ok AS (SELECT * FROM obs WHERE U IS NOT NULL)"


def obs(spark, sf):
    return Q.complete_cases(view(spark, sf, "obs"), ["U"])


@query("a1_mse_r2", using("obs", extra=OK) + """
  SELECT pcode, avg((pred_mean-taucx)*(pred_mean-taucx)) AS mse,
         1 - avg((pred_mean-taucx)*(pred_mean-taucx))/var_pop(taucx) AS r2 FROM obs_ok GROUP BY pcode""", keys="pcode")
def a1(spark, sf):
    return M.mse_r2(obs(spark, sf), "pred_mean", "taucx", ["pcode"])


@query("a2_mse_r2_weighted", using("obs", extra=OK) + """
  , m AS (SELECT pcode, sum(taucx*weight)/sum(weight) AS mu FROM obs_ok GROUP BY pcode)
  SELECT pcode, sum(weight*(pred_mean-taucx)*(pred_mean-taucx))/sum(weight) AS mse,
    1 - sum(weight*(pred_mean-taucx)*(pred_mean-taucx))/sum(weight*(taucx-mu)*(taucx-mu)) AS r2
  FROM obs_ok JOIN m USING (pcode) GROUP BY pcode""", keys="pcode")
def a2(spark, sf):
    return M.mse_r2_weighted(obs(spark, sf), "pred_mean", "taucx", "weight", ["pcode"])


@query("a3_r2_sample_variance", using("obs", extra=OK) + """
  SELECT pcode, avg((pred_mean-taucx)*(pred_mean-taucx)) AS mse,
         1 - avg((pred_mean-taucx)*(pred_mean-taucx))/var_samp(taucx) AS r2 FROM obs_ok GROUP BY pcode""", keys="pcode")
def a3(spark, sf):
    return M.mse_r2(obs(spark, sf), "pred_mean", "taucx", ["pcode"], ddof=1)


@query("a4_residual_moments", using("obs", extra=OK) + """
  SELECT pcode, sum(weight*(pred_mean-taucx)/sqrt(pred_var))/sum(weight) AS res_mean,
    sum(weight*(pred_mean-taucx)*(pred_mean-taucx)/pred_var)/sum(weight) AS res_var
  FROM obs_ok GROUP BY pcode""", keys="pcode")
def a4(spark, sf):
    return M.residual_moments(obs(spark, sf), "pred_mean", "taucx", "pred_var", "weight", ["pcode"])


NORMALS = "normal_q AS (SELECT unnest([" + ", ".join(repr(v) for v in M.normal_quantiles()) + "]) AS x)"


def _wd(points):
    """Distance between two weighted samples per pcode, single-partition windows."""
    return f"""
  w_at AS (SELECT pcode, x, sum(wa) AS a, sum(wb) AS b FROM ({points}) GROUP BY pcode, x),
  w_f AS (SELECT pcode, x, sum(a) OVER w / sum(a) OVER (PARTITION BY pcode) AS fa,
       sum(b) OVER w / sum(b) OVER (PARTITION BY pcode) AS fb, lead(x) OVER (PARTITION BY pcode ORDER BY x) AS nx
       FROM w_at WINDOW w AS (PARTITION BY pcode ORDER BY x ROWS UNBOUNDED PRECEDING)),
  w_d AS (SELECT pcode, sum(abs(fa-fb)*(nx-x)) AS wd FROM w_f GROUP BY pcode)"""


RES = "SELECT pcode, (pred_mean-taucx)/sqrt(pred_var) AS x, weight AS wa, 0e0 AS wb FROM obs_ok"
REF = "SELECT pcode, x, 0e0 AS wa, 1e0 AS wb FROM normal_q CROSS JOIN (SELECT DISTINCT pcode FROM obs_ok)"


@query("a5_wasserstein_normal", using("obs", extra=f"{OK}, {NORMALS}, " + _wd(f"{RES} UNION ALL {REF}"))
       + "SELECT * FROM w_d", keys="pcode")
def a5(spark, sf):
    return M.wasserstein_normal(obs(spark, sf), M.residual("pred_mean", "taucx", "pred_var"), "weight", ["pcode"])


@query("a5_wasserstein_two_columns", using("obs", extra=OK + ", " + _wd(
    "SELECT pcode, taucx AS x, weight AS wa, 0e0 AS wb FROM obs_ok UNION ALL "
    "SELECT pcode, taubx, 0e0, 1e0 FROM obs_ok")) + "SELECT * FROM w_d", keys="pcode")
def a5b(spark, sf):
    return M.wasserstein(M.two_columns(obs(spark, sf), "taucx", "taubx", "weight", None, ["pcode"]), ["pcode"])


@query("a6_evaluate", using("obs", extra=f"{OK}, {NORMALS}, " + _wd(f"{RES} UNION ALL {REF}")) + """
  , m AS (SELECT pcode, sum(taucx*weight)/sum(weight) AS mu FROM obs_ok GROUP BY pcode)
  SELECT pcode, sum(weight*(pred_mean-taucx)*(pred_mean-taucx))/sum(weight) AS mse,
    1 - sum(weight*(pred_mean-taucx)*(pred_mean-taucx))/sum(weight*(taucx-mu)*(taucx-mu)) AS r2,
    sum(weight*(pred_mean-taucx)/sqrt(pred_var))/sum(weight) AS res_mean,
    sum(weight*(pred_mean-taucx)*(pred_mean-taucx)/pred_var)/sum(weight) AS res_var, any_value(wd) AS wd,
    sum(weight*(taubx-taucx)*(taubx-taucx))/sum(weight) AS bulk_mse,
    1 - sum(weight*(taubx-taucx)*(taubx-taucx))/sum(weight*(taucx-mu)*(taucx-mu)) AS bulk_r2
  FROM obs_ok JOIN m USING (pcode) JOIN w_d USING (pcode) GROUP BY pcode""", keys="pcode")
def a6(spark, sf):
    return M.evaluate(obs(spark, sf), "pred_mean", "taucx", "pred_var", "taubx", "weight", ["pcode"])


@query("a7_bias", using("obs", extra=OK) + """
  SELECT pcode, sum(weight*(pred_mean-taucx))/sum(weight) AS ann_bias,
    sum(weight*(taubx-taucx))/sum(weight) AS bulk_bias FROM obs_ok GROUP BY pcode""", keys="pcode")
def a7(spark, sf):
    return M.bias(obs(spark, sf), "pred_mean", "taucx", "taubx", "weight", ["pcode"])


def _splits(splits):
    rows = ", ".join(f"('{s}', {c})" for s, cs in splits.items() for c in cs)
    return f"sp AS (SELECT * FROM (VALUES {rows}) AS v(split, pcode)), r AS (SELECT * FROM obs_ok JOIN sp USING (pcode))"


def _split_scores(splits):
    return using("obs", extra=OK + ", " + _splits(splits)) + """
  , m AS (SELECT split, sum(taucx*weight)/sum(weight) AS mu FROM r GROUP BY split)
  SELECT split, sum(weight*(pred_mean-taucx)*(pred_mean-taucx))/sum(weight) AS ann_mse,
    1 - sum(weight*(pred_mean-taucx)*(pred_mean-taucx))/sum(weight*(taucx-mu)*(taucx-mu)) AS ann_r2,
    sum(weight*(pred_mean-taucx))/sum(weight) AS ann_bias,
    sum(weight*(taubx-taucx)*(taubx-taucx))/sum(weight) AS bulk_mse,
    1 - sum(weight*(taubx-taucx)*(taubx-taucx))/sum(weight*(taucx-mu)*(taucx-mu)) AS bulk_r2,
    sum(weight*(taubx-taucx))/sum(weight) AS bulk_bias, count(*) AS n
  FROM r JOIN m USING (split) GROUP BY split"""


@query("a8_scores_by_region", _split_scores(M.SPLITS_4), keys="split, n")
def a8(spark, sf):
    return M.evaluate_over_splits(obs(spark, sf), M.SPLITS_4, "pred_mean", "taucx", "taubx", "weight")


@query("a8_scores_three_way", _split_scores(M.SPLITS_3), keys="split, n")
def a8b(spark, sf):
    return M.evaluate_over_splits(obs(spark, sf), M.SPLITS_3, "pred_mean", "taucx", "taubx", "weight")


@query("a8_scores_six_way", _split_scores(M.SPLITS_6), keys="split, n")
def a8c(spark, sf):
    """Trained and held-out rows of six splits whose training rows overlap."""
    return M.evaluate_over_splits(obs(spark, sf), M.SPLITS_6, "pred_mean", "taucx", "taubx", "weight")


@query("a9_bias_by_region", using("obs", extra=OK + ", " + _splits(M.SPLITS_4)) + """
  SELECT split, sum(weight*(pred_mean-taucx))/sum(weight) AS ann_bias,
    sum(weight*(taubx-taucx))/sum(weight) AS bulk_bias FROM r GROUP BY split""", keys="split")
def a9(spark, sf):
    return M.bias_over_splits(obs(spark, sf), M.SPLITS_4, "pred_mean", "taucx", "taubx", "weight")


# Five runs: run s perturbs the prediction by s per cent and holds out a hash fifth of the rows.
RUNS = """runs AS (SELECT seed, pcode, taucx, pred_mean*(1e0 + seed/1e2) AS pred,
   CASE WHEN ('0x' || substr(md5(seed || ':' || event_id), 1, 13))::BIGINT/4503599627370496e0 < 0.2e0
        THEN 'valid' ELSE 'train' END AS role FROM obs_ok CROSS JOIN range(5) s(seed))"""


def runs(spark, sf):
    r = obs(spark, sf).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("event_id").cast("string"))), 1, 13),
               16, 10).cast("bigint") / F.lit(float(16**13))
    return r.select("seed", "pcode", "taucx", (F.col("pred_mean") * (1 + F.col("seed") / 1e2)).alias("pred"),
                    F.when(u < 0.2, "valid").otherwise("train").alias("role"))


@query("a10_score_table", using("obs", extra=f"{OK}, {RUNS}") + """
  SELECT seed, max(r2) FILTER (role='train') AS train, max(r2) FILTER (role='valid') AS valid FROM (
    SELECT seed, role, 1 - avg((pred-taucx)*(pred-taucx))/var_pop(taucx) AS r2 FROM runs GROUP BY seed, role)
  GROUP BY seed""", keys="seed")
def a10(spark, sf):
    return M.score_table(runs(spark, sf), "seed", "role", "pred", "taucx", ["train", "valid"])


@query("a32_score_spread", using("obs", extra=f"{OK}, {RUNS}") + """
  SELECT pcode, avg(mse) AS mse_mean, avg(r2) AS r2_mean, stddev_pop(mse) AS mse_std, stddev_pop(r2) AS r2_std FROM (
    SELECT seed, pcode, avg((pred-taucx)*(pred-taucx)) AS mse, 1 - avg((pred-taucx)*(pred-taucx))/var_pop(taucx) AS r2
    FROM runs GROUP BY seed, pcode) GROUP BY pcode""", keys="pcode")
def a32(spark, sf):
    return M.score_spread(M.mse_r2(runs(spark, sf), "pred", "taucx", ["seed", "pcode"]), ["pcode"], ["mse", "r2"])


@query("a11_fit_scales", using("obs", extra=OK) + """
  , m AS (SELECT avg(tsea*weight) AS a, avg(U*weight) AS b FROM obs_ok)
  SELECT any_value(a) AS tsea_mean, sqrt(avg((tsea-a)*(tsea-a)*weight)) AS tsea_scale,
         any_value(b) AS U_mean, sqrt(avg((U-b)*(U-b)*weight)) AS U_scale FROM obs_ok CROSS JOIN m""", digits=8)
def a11(spark, sf):
    return M.fit_scales(obs(spark, sf), ["tsea", "U"], "weight")


NLL = "0.5e0*(ln(greatest(pred_var,1e-6)) + (taucx-pred_mean)*(taucx-pred_mean)/greatest(pred_var,1e-6))"


@query("a12_gaussian_nll", using("obs", extra=OK) + f"""
  SELECT pcode, avg({NLL}*weight) AS nll FROM obs_ok GROUP BY pcode""", keys="pcode")
def a12(spark, sf):
    return M.gaussian_nll(obs(spark, sf), "pred_mean", "taucx", "pred_var", "weight", ["pcode"])


@query("m14_score_scaled", using("obs", extra=OK) + f"""
  SELECT pcode, avg((pred_mean-taucx)*(pred_mean-taucx)*weight) AS mse,
    1 - avg((pred_mean-taucx)*(pred_mean-taucx)*weight)/avg(taucx*taucx*weight) AS r2, avg({NLL}*weight) AS nll,
    avg((pred_mean-taucx)/sqrt(pred_var)*weight) AS res_mean,
    avg((pred_mean-taucx)*(pred_mean-taucx)/pred_var*weight) AS res_var FROM obs_ok GROUP BY pcode""", keys="pcode")
def m14(spark, sf):
    return M.score_scaled(obs(spark, sf), "pred_mean", "taucx", "pred_var", "weight", ["pcode"])


@query("a13_weight_share", using("obs", extra=OK) + """
  SELECT pcode, count(*)/(SELECT count(*)::DOUBLE FROM obs_ok) AS unweighted,
    sum(weight)/(SELECT sum(weight) FROM obs_ok) AS weighted FROM obs_ok GROUP BY pcode""", keys="pcode")
def a13(spark, sf):
    return M.weight_share(obs(spark, sf), "weight", ["pcode"])
