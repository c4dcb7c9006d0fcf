"""Edges and properties of filters, scores, series, profiles, cases and interpolation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import (bulk as B, cases as C, distributions as D, interpolation as I, metrics as M, profiles as P,
                                 quality as Q, series as S)

NAN = float("nan")


def test_missing_is_null_or_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, None)], "id int, x double")
    assert [r["id"] for r in Q.complete_cases(df, ["x"]).collect()] == [1]
    with pytest.raises(ValueError, match="missing columns"):
        Q.complete_cases(df, ["y"])


def test_calm_wind(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "ux double, uy double")
    calm, wind = Q.wind_parts(df).orderBy("ux").collect()
    assert calm["U"] == 0 and calm["cos"] is None and (wind["cos"], wind["sin"]) == (0.6, 0.8)
    assert Q.wind_parts(df, eps=1e-8).orderBy("ux").first()["cos"] == 0.0
    assert [r["c"] for r in Q.wind_parts(df).orderBy("ux").select(Q.const_like("U", 10).alias("c")).collect()] == [None, 10.0]


def test_longitude_zero_becomes_360(spark):
    df = spark.createDataFrame([(0.0,), (-90.0,), (90.0,)], "lon double")
    assert sorted(r["lon"] for r in Q.norm_lon(df).collect()) == [90.0, 270.0, 360.0]


def test_end_day_is_whole(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 23:59:59.999' AS time UNION ALL SELECT TIMESTAMP_NTZ'2024-01-03 00:00:00'")
    assert Q.time_slice(df, "2024-01-01", "2024-01-02").count() == 1


def test_filters_reach_the_scan(spark, sf, tmp_path):
    path = str(tmp_path / "obs")
    from checks.views import view
    view(spark, sf, "obs").write.parquet(path)
    df = Q.region_box(Q.by_group(Q.time_slice(Q.qc_ok(spark.read.parquet(path)), "2024-01-02", "2024-01-09"), [77, 67]), (0, 90), (-30, 30)).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):plan.index("ReadSchema")]
    for part in ("EqualTo(qc,0)", "In(pcode", "GreaterThanOrEqual(time", "lon", "lat"):
        assert part in pushed
    assert "taucx" not in plan[plan.index("ReadSchema"):].split("\n")[0]


def scores(spark):
    rnd = random.Random(1)
    return spark.createDataFrame([(i % 3, rnd.gauss(0, 1), rnd.gauss(0, 1), 1.0) for i in range(300)], "g int, p double, t double, w double")


def test_equal_weights_are_no_weights(spark):
    df = scores(spark)
    a = M.mse_r2(df, "p", "t", ["g"]).orderBy("g").collect()
    b = M.mse_r2_weighted(df, "p", "t", "w", ["g"]).orderBy("g").collect()
    for x, y in zip(a, b):
        assert tuple(x) == pytest.approx(tuple(y), abs=1e-12)


def test_constant_truth_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "p double, t double")
    r = M.mse_r2(df, "p", "t").first()
    assert r["mse"] == 0.5 and r["r2"] is None


def test_wasserstein_known_values(spark):
    a = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "x double")
    b = spark.createDataFrame([(5.0,), (6.0,), (8.0,)], "x double")
    assert M.wasserstein(M.two_samples(a, "x", b, "x")).first()["wd"] == pytest.approx(5.0)
    assert M.wasserstein(M.two_samples(a, "x", a, "x")).first()["wd"] == pytest.approx(0.0)
    w = spark.createDataFrame([(0.0, 3.0), (1.0, 1.0)], "x double, w double")
    v = spark.createDataFrame([(0.0,)], "x double")
    assert M.wasserstein(M.two_samples(w, "x", v, "x", "w")).first()["wd"] == pytest.approx(0.25)


def test_wasserstein_with_a_hot_value(spark):
    rows = [(0.0,)] * 400 + [(float(i),) for i in range(1, 200)]
    a, b = spark.createDataFrame(rows, "x double"), spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    xs, ys = np.sort([r[0] for r in rows]), np.arange(100.0)
    at = np.sort(np.concatenate([xs, ys]))
    want = np.sum(np.abs(np.searchsorted(xs, at[:-1], "right") / len(xs) - np.searchsorted(ys, at[:-1], "right") / 100) * np.diff(at))
    assert M.wasserstein(M.two_samples(a, "x", b, "x")).first()["wd"] == pytest.approx(want)


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.5,)], "x double")
    got = {r["bin"]: r["weight"] for r in D.histogram(df, "x", [0.0, 1.0, 2.0], density=False).collect()}
    assert got == {0: 1.0, 1: 2.0}


def test_density_adds_up_to_the_count(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.gauss(0, 1), rnd.gauss(3, 2)) for _ in range(400)], "x double, y double")
    gx, gy = list(np.linspace(-6, 6, 49)), list(np.linspace(-8, 14, 67))
    total = D.kde_grid(df, ["x", "y"], [gx, gy], counts=True).agg(F.sum("density")).first()[0]
    assert total * (gx[1] - gx[0]) * (gy[1] - gy[0]) == pytest.approx(400, rel=1e-3)


def series(spark, gaps):
    t, rows = 0.0, []
    for i, g in enumerate(gaps):
        t += g
        rows.append((i, t))
    return spark.createDataFrame(rows, "id long, m double").select(
        "id", F.expr("TIMESTAMP_NTZ'2024-01-01'").alias("t0"), (F.col("m") * 60).alias("s")).select(
        "id", (F.col("t0") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)"))).alias("time"),
        F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit("a").alias("g"))


def test_a_gap_of_exactly_the_limit_does_not_break(spark):
    got = S.stage_label(series(spark, [0, 60, 61, 60]), ["g"], "time", "id", 60).orderBy("id").collect()
    assert [r["stage"] for r in got] == [0, 0, 1, 1]


def test_strict_form_skips_the_first_pair(spark):
    df = series(spark, [0, 100, 100, 1])
    loose = [r["is_break"] for r in S.find_breaks(df, ["g"], "time", "id", 60).orderBy("id").collect()]
    strict = [r["is_break"] for r in S.find_breaks(df, ["g"], "time", "id", 60, 1, True).orderBy("id").collect()]
    assert loose == [1, 1, 0, 0] and strict == [0, 1, 0, 0]


def test_longitude_jump_across_the_date_line_is_small(spark):
    df = series(spark, [0, 1]).withColumn("lon", F.when(F.col("id") == 0, 179.9).otherwise(-179.9))
    assert S.find_breaks(df, ["g"], "time", "id").agg(F.sum("is_break")).first()[0] == 0


def test_rolling_mean_edges_and_gaps(spark):
    df = spark.createDataFrame([(i, None if i == 7 else float(i)) for i in range(12)], "i long, x double")
    got = [r["rolling"] for r in S.rolling_mean(df, "x", 4, "i").orderBy("i").collect()]
    # window of four reaches two back and one forward
    assert got[:2] == [None, None] and got[2] == 1.5 and got[5] == 4.5 and got[6:10] == [None] * 4 and got[10] == 9.5 and got[11] is None


def test_autocorrelation_against_numpy(spark):
    rnd = np.random.default_rng(2)
    x = np.cumsum(rnd.normal(size=500))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    d = x - x.mean()
    want = [float(d[:len(d) - k] @ d[k:] / (d @ d)) for k in range(21)]
    old, S.BLOCK = S.BLOCK, 64
    try:
        got = [r["r"] for r in S.autocorr(df, "x", 20, "i").orderBy("lag").collect()]
        lags = [r["r"] for r in S.lag_corr(df, "x", 5, "i").orderBy("lag").collect()]
    finally:
        S.BLOCK = old
    assert got == pytest.approx(want, abs=1e-10)
    assert lags == pytest.approx([np.corrcoef(x[k:], x[:-k])[0, 1] for k in range(1, 6)], abs=1e-10)


def test_linear_resampling_stays_inside(spark):
    df = series(spark, [30, 60, 240]).withColumn("x", F.col("id") * 10.0)
    got = [(str(r["time"])[11:16], r["x"]) for r in S.resample_linear(df, "time", ["x"]).orderBy("time").collect()]
    assert [g[0] for g in got] == ["01:00", "02:00", "03:00", "04:00", "05:00"]
    assert got[0][1] == pytest.approx(5.0) and got[1][1] == pytest.approx(11.25)


def test_fill_nearest_prefers_the_earlier(spark):
    df = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, 3.0), (4, None), (5, None), (6, None), (7, 7.0)], "i long, x double")
    assert [r["x"] for r in S.fill_nearest(df, "x", "i").orderBy("i").collect()] == [1.0, 1.0, 1.0, 3.0, 3.0, 3.0, 7.0, 7.0]
    none = df.withColumn("x", F.lit(None).cast("double"))
    assert S.fill_nearest(none, "x", "i").filter("x IS NOT NULL").count() == 0


def profile(spark, temps):
    return spark.createDataFrame([(1, -10.0 * (len(temps) - i), t, 35.0) for i, t in enumerate(temps)], "pid int, z double, temp double, salt double")


def test_mixed_layer_depth(spark):
    mld = lambda t, **k: P.mixed_layer_depth(profile(spark, t), ["pid"], "temperature", **k).first()["mld"]
    assert mld([8.0, 9.0, 10.0]) == pytest.approx(-12.0)
    assert mld([9.95, 10.0]) == pytest.approx(-50.0)                # reached below the profile
    assert mld([9.95, 10.0], extrapolate=False) is None
    assert mld([10.0, 10.0]) is None                                # equal values
    assert mld([10.0]) is None
    with pytest.raises(ValueError):
        P.mixed_layer_depth(profile(spark, [1.0]), ["pid"], "colour")


def test_common_levels_extend_the_ends(spark):
    df = spark.createDataFrame([(1, -20.0, 0.0), (1, -10.0, 10.0), (2, -5.0, 1.0)], "pid int, z double, v double")
    got = {(r["pid"], r["z"]): r["v"] for r in P.interp_levels(df, ["pid"], [-25.0, -15.0, 0.0], ["v"]).collect()}
    assert got == {(1, -25.0): -5.0, (1, -15.0): 5.0, (1, 0.0): 20.0, (2, -25.0): None, (2, -15.0): None, (2, 0.0): None}


def test_levels_by_halving_and_repeated_depths(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    rows, want, levels = [], {}, [-60.0, -33.3, -20.0, -5.0, -0.1, 0.0, 4.0]
    for pid in range(40):
        z = np.round(rng.uniform(-50, 0, rng.integers(2, 30)), 1)
        z[-1] = z[0]  # a depth met twice
        v = rng.normal(size=len(z))
        rows += [(pid, float(a), float(b)) for a, b in zip(z, v)]
        d = np.unique(z)
        m = np.array([v[z == a].mean() for a in d])
        for level in levels:
            k = np.clip(np.searchsorted(d, level), 1, len(d) - 1) if len(d) > 1 else None
            want[pid, level] = None if k is None else m[k - 1] + (m[k] - m[k - 1]) / (d[k] - d[k - 1]) * (level - d[k - 1])
    out = P.interp_levels(spark.createDataFrame(rows, "pid int, z double, v double"), ["pid"], levels, ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
    got = {(r["pid"], r["z"]): r["v"] for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(w) if w is not None else got[k] is None for k, w in want.items())


def test_distributions_of_nothing_and_of_one_value(spark):
    import halocline.operators.distributions as X
    schema = "x double, y double"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (None, 5.0)], schema)
    some = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 3.0)], schema)
    assert X.hex_density(none, "x", "y").count() == 0 and X.binned_stats(none, "x", "y", 5).count() == 0
    assert X.hex_density(one, "x", "y").agg(F.sum("n")).first()[0] == 2
    assert [tuple(r) for r in X.binned_stats(one, "x", "y", 5).select("bin", "n", "mean", "std", "left").collect()] == [(0, 2, 2.0, 1.0, 2.0)]
    assert X.binned_stats(some, "x", "y", 5).schema.names == X.binned_stats(one, "x", "y", 5).schema.names
    grid = [[0.0, 1.0, 2.0]]
    for empty in (none, one):
        assert X.kde_grid(empty, ["x"], grid).count() == 0 and X.kde_grid(empty, ["x", "y"], grid * 2).count() == 0
    assert X.kde_grid(some, ["x"], grid).count() == 3 and X.kde_grid(some, ["x", "y"], grid * 2).count() == 0  # all on a line
    assert X.kde_grid(some, ["x"], grid).schema.names == X.kde_grid(none, ["x"], grid).schema.names


def test_reference_case_must_be_bulk(spark):
    with pytest.raises(ValueError, match="bulk"):
        C.case_distance(spark.range(1), {"flux": "ANN"}, {"flux": "ANN"})


def test_interpolation_is_exact_on_a_trilinear_field(spark):
    grid = spark.sql("""SELECT CAST(a.id AS DOUBLE) AS lat, b.id*10D AS lon, c.id*2D AS ts, 1 + a.id*2 + b.id*30D + c.id*10D + a.id*b.id*10D AS v
       FROM range(4) a CROSS JOIN range(5) b CROSS JOIN range(3) c""").filter("NOT (lat = 3 AND lon = 40 AND ts = 4)")
    pts = spark.createDataFrame([(0, 0.5, 15.0, 1.0), (1, 3.0, 0.0, 4.0), (2, 3.1, 0.0, 0.0), (3, 2.5, 35.0, 3.0), (4, None, 0.0, 0.0), (5, 2.0, 40.0, 4.0)],
                                "id int, lat double, lon double, time double")
    for salt in (1, 4):
        got = {r["id"]: r["v"] for r in I.interp_at(pts, grid, {"lat": "lat", "lon": "lon", "ts": "time"}, ["v"], salt=salt).collect()}
        f = lambda la, lo, t: 1 + 2 * la + 3 * lo + 5 * t + la * lo
        assert got[0] == pytest.approx(f(0.5, 15, 1)) and got[1] == pytest.approx(f(3, 0, 4))
        assert got[2] is None and got[3] is None and got[4] is None      # outside, missing corner, no position
    with pytest.raises(ValueError, match="two values"):
        I.interp_at(pts, grid.filter("lat = 0"), {"lat": "lat"}, ["v"])


def test_interpolation_on_a_long_uneven_axis(spark):
    """200 000 axis values, none of them in the plan, and a field read twice: for its axes and for its corners."""
    n = 200_000
    grid = spark.range(n).select((F.col("id") * 1.5 + F.pow(F.col("id") / n, 8) * 1e6).alias("x"), F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("y")).withColumn(
        "v", 2 * F.col("x") + 5 * F.col("y"))
    pts = spark.range(3000).select("id", (F.col("id") * 401.3 - 1000).alias("x"), ((F.col("id") % 10) / 10).alias("y"))
    out = I.interp_at(pts, grid, {"x": "x", "y": "y"}, ["v"])
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    top = (n - 1) * 1.5 + ((n - 1) / n) ** 8 * 1e6
    for r in out.collect():
        assert (r["v"] is None) == (not 0 <= r["x"] <= top) and (r["v"] is None or r["v"] == pytest.approx(2 * r["x"] + 5 * r["y"], abs=1e-6))


def test_bulk_signs_and_missing(spark):
    df = spark.createDataFrame([(1, 8.0, 20.0, 18.0, 75.0), (2, None, 20.0, 18.0, 75.0), (3, 8.0, 15.0, 20.0, 99.0), (4, 8.0, -3.0, -5.0, 80.0)],
                               "id int, U double, tsea double, tair double, rh double").withColumns(
        {"p": F.lit(101000.0), "zu": F.lit(10.0), "zt": F.lit(10.0), "zq": F.lit(10.0)})
    warm, none, cold, ice = B.bulk36(df).orderBy("id").collect()
    assert warm["hs"] > 0 and warm["hl"] > 0 and 0.05 < warm["tau"] < 0.15 and 0.0008 < warm["cd"] < 0.002
    assert cold["hs"] < 0 and none["tau"] is None and none["hl"] is None and ice["tau"] > 0
    app = B.apply_bulk(df).orderBy("id").collect()
    assert app[0]["hsb"] == pytest.approx(-warm["hs"]) and app[0]["tauby"] == 0.0 and app[1]["tauby"] is None
    with pytest.raises(ValueError, match="unknown bulk algorithm"):
        B.apply_bulk(df, "other")


def test_wave_age_raises_the_stress_of_young_seas(spark):
    df = spark.createDataFrame([(1, 12.0, 8.0, 3.0), (2, 12.0, 25.0, 1.0), (3, 12.0, None, None)], "id int, U double, cp double, sigh double").withColumns(
        {"tsea": F.lit(18.0), "tair": F.lit(17.0), "rh": F.lit(75.0), "p": F.lit(101000.0), "zu": F.lit(10.0), "zt": F.lit(10.0), "zq": F.lit(10.0)})
    young, old, wind = [r["tau"] for r in B.bulk36(df).orderBy("id").collect()]
    assert young > wind > old


def test_cool_skin_reduces_the_latent_heat(spark):
    df = spark.createDataFrame([(4.0, 28.0, 27.0, 75.0)], "U double, tsea double, tair double, rh double").withColumns(
        {"p": F.lit(101000.0), "zu": F.lit(10.0), "zt": F.lit(10.0), "zq": F.lit(10.0)})
    off = B.bulk36(df, extended=True).first()
    on = B.bulk36(df, cool_skin=True, extended=True).first()
    assert on["hl"] < off["hl"] and on["dt_skin"] > 0 and off["dt_skin"] == 0
    assert off["u10"] == pytest.approx(4.0, abs=1e-9) and off["t10"] == pytest.approx(27.0, abs=1e-9)


def test_profile_at_the_measuring_height_is_the_measurement(spark):
    df = spark.createDataFrame([(7.0, 20.0, 18.0, 75.0)], "U double, tsea double, tair double, rh double").withColumns(
        {"p": F.lit(101000.0), "zu": F.lit(15.0), "zt": F.lit(15.0), "zq": F.lit(15.0)})
    r = B.profile_at(df, 15.0).first()
    assert r["u_ref"] == pytest.approx(7.0) and r["t_ref"] == pytest.approx(18.0) and r["rh_ref"] == pytest.approx(75.0, abs=0.2)


def test_a_null_group_is_a_group(spark):
    rows = [(None, "2024-01-01 00:10", 1.0), (None, "2024-01-01 02:10", 3.0), ("a", "2024-01-01 00:10", 5.0), ("a", "2024-01-01 01:10", 6.0)]
    df = spark.createDataFrame(rows, "g string, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = [(r.g, r.t.hour, r.v) for r in S.resample_mean(df, "t", "1 hour", ["v"], ["g"], fill=True).orderBy("g", "t").collect()]
    assert got == [(None, 0, 1.0), (None, 1, None), (None, 2, 3.0), ("a", 0, 5.0), ("a", 1, 6.0)]
    assert {r.g for r in S.autocorr(df, "v", 1, "t", by=["g"]).collect()} == {None, "a"}


def test_the_width_of_common_levels_follows_the_rows(spark, monkeypatch):
    """A task holds a bounded number of profile rows however many there are."""
    monkeypatch.setattr(P, "TASK_ROWS", 100, raising=False)
    df = spark.range(6000).selectExpr("id % 300 AS pid", "CAST(id DIV 300 AS DOUBLE) AS z", "CAST(id AS DOUBLE) AS t")
    got = P.interp_levels(df, ["pid"], [0.5], ["t"])
    parts = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert got.count() == 300 and len(parts) > 30 and max(r["count"] for r in parts) < 30
