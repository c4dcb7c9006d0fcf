"""Histogram and density queries."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import table, using, view
from halocline.operators import distributions as D, quality as Q
from halocline.operators.metrics import residual

OK = "obs_ok AS (SELECT * FROM obs WHERE U IS NOT NULL)"


def obs(spark, sf):
    return Q.complete_cases(view(spark, sf, "obs"), ["U"])


def bins_sql(edges):
    rows = ", ".join(f"({i}::INT, {a!r}::DOUBLE, {b!r}::DOUBLE, {str(i == len(edges) - 2).upper()})"
                     for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"(SELECT * FROM (VALUES {rows}) AS v(bin, lo, hi, last))"


def on_bins(x):
    return f"{x} >= lo AND ({x} < hi OR (last AND {x} = hi))"


E4 = D.edges_of(-4, 4, 79)


@query("a21_histogram", using("obs", extra=OK) + f"""
  , h AS (SELECT bin, any_value(lo) AS left, any_value(hi) AS right, sum(weight) AS weight FROM
    (SELECT (pred_mean-taucx)/sqrt(pred_var) AS r, weight FROM obs_ok) JOIN {bins_sql(E4)} b ON {on_bins('r')} GROUP BY bin)
  SELECT *, weight/(SELECT sum(weight) FROM h)/("right"-"left") AS density FROM h""", keys="bin")
def a21(spark, sf):
    o = obs(spark, sf).withColumn("r", residual("pred_mean", "taucx", "pred_var"))
    return D.histogram(o, "r", E4, "weight")


QTY = D.edges_of(0, 50, 25)


@query("a21_histogram_by_group", f"""WITH h AS (SELECT l_returnflag, bin, any_value(lo) AS left, any_value(hi) AS right,
    CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN {bins_sql(QTY)} b ON {on_bins('l_quantity')} GROUP BY l_returnflag, bin)
  SELECT *, weight/(sum(weight) OVER (PARTITION BY l_returnflag))/("right"-"left") AS density FROM h""", keys="l_returnflag, bin")
def a21b(spark, sf):
    return D.histogram(table(spark, sf, "lineitem"), "l_quantity", QTY, None, ["l_returnflag"])


@query("a22_hex_density", using("obs", extra=OK) + """
  , e AS (SELECT min(U) AS x0, (max(U)-min(U))/30 AS sx, min(hlc) AS y0, (max(hlc)-min(hlc))/17 AS sy FROM obs_ok),
  u AS (SELECT (U-x0)/sx AS u, (hlc-y0)/sy AS v, x0, y0, sx, sy FROM obs_ok CROSS JOIN e),
  d AS (SELECT *, pow(u-round_even(u,0),2)+3e0*pow(v-round_even(v,0),2) <
      pow(u-floor(u)-0.5e0,2)+3e0*pow(v-floor(v)-0.5e0,2) AS f FROM u),
  c AS (SELECT CASE WHEN f THEN round_even(u,0) ELSE floor(u)+0.5e0 END AS hx,
               CASE WHEN f THEN round_even(v,0) ELSE floor(v)+0.5e0 END AS hy, x0, y0, sx, sy FROM d)
  SELECT count(*) AS n, hx*any_value(sx)+any_value(x0) AS cx, hy*any_value(sy)+any_value(y0) AS cy, log10(count(*)+1) AS log_n
  FROM c GROUP BY hx, hy HAVING count(*) >= 2""", keys="n", digits=7)
def a22(spark, sf):
    return D.hex_density(obs(spark, sf), "U", "hlc", 30, 2)


G1 = [float(v) for v in range(0, 25)]
GX, GY = [float(v) for v in range(0, 24, 2)], [float(v) for v in range(-5, 6)]


def axis(name, values):
    return f"(SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {name})"


KDE = f"""
  , s AS (SELECT sum(weight) AS s, sum(weight*weight) AS s2, sum(weight*U)/sum(weight) AS m FROM obs_ok),
  k AS (SELECT any_value(s) AS s, sum(weight*pow(U-m,2))/any_value(s)/(1e0-any_value(s2)/pow(any_value(s),2))
      *pow(pow(any_value(s),2)/any_value(s2), -0.4e0) AS h2 FROM obs_ok CROSS JOIN s)
  SELECT g0, sum(weight*exp(-0.5e0*pow(U-g0,2)/h2))/any_value(s)/sqrt(2e0*pi()*any_value(h2)) AS density
  FROM obs_ok CROSS JOIN k CROSS JOIN {axis('g0', G1)} GROUP BY g0"""


@query("a23_kernel_density", using("obs", extra=OK) + KDE)
def a23(spark, sf):
    return D.kde_grid(obs(spark, sf), ["U"], [G1], "weight")


@query("a24_density_total", using("obs", extra=OK) + KDE.replace("\n  SELECT g0", ", d AS (SELECT g0") + f""")
  SELECT sum(density)*{G1[1] - G1[0]!r}::DOUBLE AS total, max(density) AS highest FROM d""")
def a24(spark, sf):
    """The density over its grid: near one where the grid covers the data."""
    d = D.kde_grid(obs(spark, sf), ["U"], [G1], "weight")
    return d.agg((F.sum("density") * (G1[1] - G1[0])).alias("total"), F.max("density").alias("highest"))


@query("a23_kernel_density_plane", using("obs", extra=OK) + f"""
  , o AS (SELECT U AS x, tair-tsea AS y FROM obs_ok),
  k0 AS (SELECT var_samp(x)*pow(count(*), -1e0/3e0) AS a, var_samp(y)*pow(count(*), -1e0/3e0) AS b,
        covar_samp(x, y)*pow(count(*), -1e0/3e0) AS c, count(*) AS n FROM o)
  SELECT g0, g1, sum(exp(-0.5e0*(b*pow(x-g0,2) - 2e0*c*(x-g0)*(y-g1) + a*pow(y-g1,2))/(a*b-c*c)))
    /sqrt(4e0*pi()*pi()*any_value(a*b-c*c)) AS density
  FROM o CROSS JOIN k0 CROSS JOIN {axis('g0', GX)} CROSS JOIN {axis('g1', GY)} GROUP BY g0, g1""", digits=7)
def a23b(spark, sf):
    o = obs(spark, sf).withColumn("dt", F.col("tair") - F.col("tsea"))
    return D.kde_grid(o, ["U", "dt"], [GX, GY], counts=True)


@query("a26_extent", using("obs") + """SELECT pcode, min(lat) AS lat_min, max(lat) AS lat_max, avg(lat) AS lat_mean,
  count(lat) AS lat_n, min(U) AS U_min, max(U) AS U_max, avg(U) AS U_mean, count(U) AS U_n FROM obs GROUP BY pcode""",
       keys="pcode, lat_n, U_n")
def a26(spark, sf):
    return D.extent(view(spark, sf, "obs"), ["lat", "U"], ["pcode"])


@query("a27_regime_stats", using("obs") + """SELECT count(hlc) AS n, avg(hlc) AS mean, stddev_pop(hlc) AS std FROM obs
  WHERE U > 8 AND U < 9 AND rh > 70 AND rh < 75""", keys="n")
def a27(spark, sf):
    return D.regime_stats(view(spark, sf, "obs"), {"U": (8, 9), "rh": (70, 75)}, "hlc")


@query("a31_binned_stats", using("obs", extra=OK) + """
  , e AS (SELECT min(U) AS lo, max(U) AS hi FROM obs_ok),
  b AS (SELECT *, (hi-lo)/20 AS w FROM e),
  r AS (SELECT taucx, CAST(least(19, floor((U-lo)/w)) AS INT) AS bin, lo, w FROM obs_ok CROSS JOIN b)
  SELECT bin, count(*) AS n, avg(taucx) AS mean, stddev_pop(taucx) AS std, any_value(lo)+bin*any_value(w) AS left
  FROM r GROUP BY bin""", keys="bin, n")
def a31(spark, sf):
    return D.binned_stats(obs(spark, sf), "U", "taucx", 20)


@query("b10_raw_coefficient", using("obs") + """, c AS (SELECT -hsc/(U+1e-8)/(tair-tsea+1e-8) AS ch FROM obs)
  SELECT count(ch) AS n, avg(ch) AS mean, stddev_pop(ch) AS std FROM c WHERE abs(ch) < 100""", keys="n")
def b10(spark, sf):
    return D.raw_exchange(view(spark, sf, "obs"), "hsc", "U", F.col("tair") - F.col("tsea"))


L7 = {"U": D.edges_of(0, 24, 24), "rh": D.edges_of(40, 110, 35)}


def _l7(c):
    return f"""SELECT pcode, '{c}' AS variable, bin, "left", n/(sum(n) OVER (PARTITION BY pcode))/(hi-"left") AS density FROM (
      SELECT pcode, bin, any_value(lo) AS "left", any_value(hi) AS hi, count(*) AS n FROM obs JOIN {bins_sql(L7[c])} b
      ON {on_bins(c)} GROUP BY pcode, bin)"""


@query("l7_compare_distributions", using("obs") + _l7("U") + " UNION ALL " + _l7("rh"), keys="pcode, variable, bin")
def l7(spark, sf):
    return D.compare_distributions(view(spark, sf, "obs"), L7, "pcode")
