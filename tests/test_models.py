"""Sampling, noise, networks, fitting, weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import metrics as M, network as N, noise as E, sampling as D, training as T, weights as K
from halocline.sources.sinks import open_case, save_case


def test_split_has_the_exact_size_on_any_layout(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    a = {r["k"] for r in D.split_random(df, "k", 7, 0.2).filter("role = 'valid'").collect()}
    b = {r["k"] for r in D.split_random(df.repartition(9), "k", 7, 0.2).filter("role = 'valid'").collect()}
    assert len(a) == 200 and a == b
    assert a != {r["k"] for r in D.split_random(df, "k", 8, 0.2).filter("role = 'valid'").collect()}
    assert D.split_random(df, "k", 7, 0.0).filter("role = 'valid'").count() == 0
    assert D.split_random(df, "k", 7, 1.0).filter("role = 'valid'").count() == 1003


def test_split_refuses_a_repeated_key(spark):
    with pytest.raises(ValueError, match="not unique"):
        D.split_random(spark.range(100).withColumn("k", F.lit(1)), "k", 7, 0.5)


def test_resample_total_and_shares(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 3.0), (2, 1.0)], "k long, w double")
    got = {r["k"]: r["copies"] for r in D.resample_rows(df, "k", 4000, 1, "w", expand=False).collect()}
    assert sum(got.values()) == 4000 and 0 not in got and got[1] == pytest.approx(3000, abs=120)
    assert D.resample_rows(df, "k", 500, 1, "w").count() == 500


def test_resample_of_text_keys(spark):
    df = spark.range(50).selectExpr("concat('r', id) AS k", "CASE WHEN id < 25 THEN 3D ELSE 1D END AS w")
    got = D.resample_rows(df, "k", 4000, 1, "w", expand=False)
    assert got.columns == ["k", "w", "copies"] and got.agg(F.sum("copies")).first()[0] == 4000
    assert got.filter("w = 3").agg(F.sum("copies")).first()[0] == pytest.approx(3000, abs=150)
    assert D.resample_rows(df, "k", 70, 1).count() == 70


def test_synthetic_moments(spark):
    s = D.synthetic_fluxes(spark.range(20000).withColumnRenamed("id", "k"), "k", 3)
    r = s.select(((F.col("tau") - F.col("tau_mean")) / F.col("tau_std")).alias("a"), ((F.col("heat") - F.col("heat_mean")) / F.col("heat_std")).alias("b"),
                 "u", "dt").agg(F.avg("a"), F.stddev_pop("a"), F.avg("b"), F.stddev_pop("b"), F.avg("u"), F.avg("dt"), F.stddev_pop("dt")).first()
    assert tuple(r) == pytest.approx((0, 1, 0, 1, 5 * np.sqrt(np.pi / 2), -0.8, 0.8), abs=0.06)


@pytest.mark.parametrize("alpha, block", [(0.9, 16), (0.999, 8), (0.0, 16), (0.5, 4096)])
def test_red_noise_is_the_recursion(spark, alpha, block):
    n = 200
    df = spark.range(n).withColumnRenamed("id", "t").withColumn("s", 1 + F.col("t") / 100)
    old, E.BLOCK = E.BLOCK, block
    try:
        got = E.red_noise(df, F.col("s"), alpha, 2, 5, "t", innovation=F.sin(F.col("_i") * F.col("ensem"))).collect()
    finally:
        E.BLOCK = old
    for m in (1, 2):
        e, want = 0.0, []
        for i in range(n):
            x = (1 + i / 100) * np.sin(i * m)
            e = x if i == 0 else alpha * e + np.sqrt(1 - alpha**2) * x
            want.append(e)
        mine = [r["eps"] for r in sorted((r for r in got if r["ensem"] == m), key=lambda r: r["t"])]
        assert mine == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("alpha", [0.95, 0.3, 1e-3, 1e-170, 0.99999])
def test_red_noise_does_not_depend_on_the_blocks(spark, alpha, monkeypatch):
    """A std is missing at row 700: the member has no value from there on, whatever the blocks are."""
    df = spark.range(1000).withColumnRenamed("id", "t").withColumn("s", F.when(F.col("t") != 700, 1 + F.col("t") % 7))
    found = []
    for block in (8, 4096):
        monkeypatch.setattr(E, "BLOCK", block)
        found.append({(r.ensem, r.t): r.eps for r in E.red_noise(df, F.col("s"), alpha, 2, 5, "t").collect()})
    a, b = found
    assert len(a) == 2000 and all((v is None) == (t >= 700) for (_, t), v in a.items())
    assert {k: v for k, v in a.items() if v is not None} == pytest.approx({k: v for k, v in b.items() if v is not None}, rel=1e-9, abs=1e-12)


def test_red_noise_has_no_python_in_its_plan(spark):
    plan = E.red_noise(spark.range(50).withColumnRenamed("id", "t"), F.lit(1.0), 0.9, 2, 5, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_red_noise_statistics(spark):
    df = spark.range(6000).withColumnRenamed("id", "t")
    x = np.array([r["eps"] for r in E.red_noise(df, F.lit(2.0), 0.8, 1, 9, "t").orderBy("t").collect()])
    assert x.std() == pytest.approx(2.0, rel=0.08) and np.corrcoef(x[1:], x[:-1])[0, 1] == pytest.approx(0.8, abs=0.03)


def small(activation="exponential", degree=None, diff=None):
    return N.new_model(["a", "b"], ["y"], [3, 2], 1, {"xmean": [1.0, 0.0], "xscale": [2.0, 1.0], "ymean": [0.5], "yscale": [3.0]},
                       var_activation=activation, degree=degree, diff=diff)


@pytest.mark.parametrize("activation", list(N.OUTPUTS))
def test_forward_pass_and_scales(spark, activation):
    m = small(activation)
    x = np.array([[0.3, -1.0], [2.0, 0.7]])
    s = (x - [1.0, 0.0]) / [2.0, 1.0]
    h = s
    for w, b in m.var[:-1]:
        h = 1 / (1 + np.exp(-(h @ w.T + b)))
    z = (h @ m.var[-1][0].T + m.var[-1][1])[:, 0]
    want = {"no": z, "square": z**2, "exponential": np.exp(z), "softplus": np.log1p(np.exp(z))}[activation] * 9
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(9, None, 1.0)], "i int, a double, b double")
    got = N.predict(df, {"m": m}).orderBy("i").collect()
    assert [r["m_var"] for r in got[:2]] == pytest.approx(list(want)) and got[2]["m_var"] is None and got[2]["m_mean"] is None


def test_homogeneous_network():
    m = small(degree=2.0)
    x = np.array([[1.0, 2.0]])
    a, b = N.forward(m.mean, x, "no", 2.0), N.forward(m.mean, 3 * x, "no", 2.0)
    assert b == pytest.approx(9 * a)


def test_case_round_trip(spark, tmp_path):
    m = small(diff=("a", "b"))
    save_case(spark, m, str(tmp_path), "one")
    save_case(spark, small(), str(tmp_path), "two")
    back = open_case(spark, str(tmp_path), "one")
    x = np.array([[0.1, 0.2], [3.0, -1.0]])
    assert back.diff == ("a", "b") and np.allclose(back.apply(x)[0], m.apply(x)[0]) and np.allclose(back.apply(x)[1], m.apply(x)[1])


@pytest.mark.parametrize("loss, fix", [("nll", False), ("nll", True), ("mse", False), ("var_mse", False)])
@pytest.mark.parametrize("activation", ["exponential", "softplus", "square"])
def test_gradient_against_differences(loss, fix, activation):
    m, rng = small(activation), np.random.default_rng(0)
    s, y, w = rng.normal(size=(7, 2)), rng.normal(size=(7, 1)), rng.uniform(0.5, 2, (7, 1))
    p = T.FitParams(loss=loss, fix_mean=fix)
    _, g = T.batch_gradient(m, s, y, w, p, rng)
    theta, size = np.concatenate([T.flat(m.mean), T.flat(m.var)]), T.flat(m.mean).size

    def at(v):
        from dataclasses import replace
        return T.batch_gradient(replace(m, mean=T.unflat(v[:size], m.mean), var=T.unflat(v[size:], m.var)), s, y, w, p, rng)[0]

    for i in rng.choice(len(theta), 12, replace=False):
        if (fix or loss == "var_mse") and i < size:
            continue
        d = np.zeros_like(theta)
        d[i] = 1e-6
        assert g[i] == pytest.approx((at(theta + d) - at(theta - d)) / 2e-6, rel=1e-3, abs=1e-4)


@pytest.mark.parametrize("loss", ["nll", "mse", "var_mse"])
@pytest.mark.parametrize("degree", [1.0, 2.0, 0.5])
def test_gradient_with_a_degree(loss, degree):
    """The gradient is that of the loss of what `apply` predicts."""
    from dataclasses import replace
    m, rng = small("softplus", degree=degree), np.random.default_rng(1)
    m = replace(m, var=[(w, b + 2) for w, b in m.var])  # variances above the floor
    s, y, w = rng.normal(size=(9, 2)) * 2, rng.normal(size=(9, 1)), rng.uniform(0.5, 2, (9, 1))
    p = T.FitParams(loss=loss)
    value, g = T.batch_gradient(m, s, y, w, p, rng)
    mean, var = N.forward(m.mean, s, "no", degree), np.maximum(N.forward(m.var, s, "softplus", degree), T.VAR_FLOOR)
    e = mean - y
    assert value == pytest.approx({"nll": (w * 0.5 * (np.log(var) + e**2 / var)).sum(), "mse": (w * e**2).sum(), "var_mse": (w * (var - e**2) ** 2).sum()}[loss])
    theta, size = np.concatenate([T.flat(m.mean), T.flat(m.var)]), T.flat(m.mean).size
    at = lambda v: T.batch_gradient(replace(m, mean=T.unflat(v[:size], m.mean), var=T.unflat(v[size:], m.var)), s, y, w, p, rng)[0]
    for i in range(len(theta)):
        if (loss == "var_mse" and i < size) or (loss == "mse" and i >= size):
            continue
        d = np.zeros_like(theta)
        d[i] = 1e-6
        assert g[i] == pytest.approx((at(theta + d) - at(theta - d)) / 2e-6, rel=1e-3, abs=1e-4)


def test_a_homogeneous_fit_learns(spark):
    """y = |x| times a function of the direction; the fitted model predicts what was fitted."""
    df = spark.range(3000).selectExpr("id AS k", "sin(id * 0.7) * (1 + id % 5) AS a", "cos(id * 1.3) * (1 + id % 3) AS b").withColumn("y", F.sqrt(F.col("a") ** 2 + F.col("b") ** 2))
    scales = {"xmean": [0.0, 0.0], "xscale": [1.0, 1.0], "ymean": [0.0], "yscale": [1.0]}
    m0 = N.new_model(["a", "b"], ["y"], [6], 0, scales, degree=1.0)
    packed = T.pack(D.split_random(df, "k", 0, 0.2, "_r"), {"model": m0}, "k", None, {"model": "_r"})
    m, log = T.fit(packed, {"model": m0}, T.FitParams(epochs=60, batches=2, lr=0.05, loss="mse"))
    r2 = [v for _, _, role, k, v in log if role == "valid" and k == "r2"]
    out = N.predict(df, {"m": m["model"]}).agg(F.avg((F.col("m_mean") - F.col("y")) ** 2), F.var_pop("y")).first()
    assert r2[-1] > 0.97 and 1 - out[0] / out[1] > 0.97


def test_batches_partition_an_epoch_and_dropout_is_the_rows_own(spark):
    s = D.synthetic_fluxes(spark.range(900).withColumnRenamed("id", "k"), "k", 4)
    p = T.FitParams(epochs=3, batches=3, dropout=0.3)
    logs = []
    for parts in (1, 5):
        m = N.new_model(["u", "dt"], ["heat"], [4, 3], 0, T.scales_of(s, ["u", "dt"], ["heat"], None))
        rows = T.pack(D.split_random(s.repartition(parts), "k", 0, 0.2, "_r"), {"model": m}, "k", None, {"model": "_r"})
        logs.append(T.fit(rows, {"model": m}, p)[1])
    assert [r[:4] for r in logs[0]] == [r[:4] for r in logs[1]] and [r[4] for r in logs[0]] == pytest.approx([r[4] for r in logs[1]], rel=1e-9)


def test_fit_recovers_mean_and_noise(spark):
    s = D.synthetic_fluxes(spark.range(4000).withColumnRenamed("id", "k"), "k", 3).cache()
    p = T.FitParams(epochs=120, batches=1, lr=0.05)
    model, log = T.fit_gaussian(s, ["u", "dt"], ["tau"], "k", [8], params=p)
    out = N.predict(s, {"m": model})
    r = out.agg(F.corr("m_mean", "tau_mean"), F.corr(F.sqrt("m_var"), F.col("tau_std"))).first()
    assert r[0] > 0.98 and r[1] > 0.9
    mom = M.residual_moments(out, "m_mean", "tau", "m_var").first()
    assert abs(mom["res_mean"]) < 0.1 and mom["res_var"] == pytest.approx(1, abs=0.15)
    nll = [v for _, e, role, k, v in log if role == "valid" and k == "nll"]
    assert nll[-1] < nll[0] - 0.3
    rates = {e: v for _, e, role, k, v in log if k == "lr"}
    assert rates[58] == 0.05 and rates[60] == pytest.approx(0.01) and rates[119] == pytest.approx(0.05 * 0.2**3)


def test_two_steps_keep_the_mean_in_the_second(spark):
    s = D.synthetic_fluxes(spark.range(500).withColumnRenamed("id", "k"), "k", 4)
    rows = D.split_random(s, "k", 0, 0.2, "_r")
    m0 = {"model": N.new_model(["u", "dt"], ["heat"], [4], 0, T.scales_of(s, ["u", "dt"], ["heat"], None))}
    packed = T.pack(rows, m0, "k", None, {"model": "_r"})
    m1, _ = T.fit(packed, m0, T.FitParams(epochs=3, batches=1, loss="mse"))
    m2, _ = T.fit(packed, m1, T.FitParams(epochs=3, batches=1, fix_mean=True))
    assert np.array_equal(T.flat(m1["model"].mean), T.flat(m2["model"].mean)) and not np.array_equal(T.flat(m0["model"].mean), T.flat(m1["model"].mean))
    assert np.array_equal(T.flat(m0["model"].var), T.flat(m1["model"].var)) and not np.array_equal(T.flat(m1["model"].var), T.flat(m2["model"].var))


def test_early_stopping_ends_the_fit(spark):
    s = D.synthetic_fluxes(spark.range(300).withColumnRenamed("id", "k"), "k", 4)
    p = T.FitParams(epochs=40, batches=1, lr=3.0, early_stopping=True, patience=1, factor=0.5, max_stale=3)
    _, log = T.fit_gaussian(s, ["u", "dt"], ["heat"], "k", [4], params=p)
    assert max(e for _, e, *_ in log) < 39 and min(v for _, _, _, k, v in log if k == "lr") < 3.0


def test_members_mean_and_std(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0)], "a double, b double, c double")
    r = N.member_stats(df, ["a", "b", "c"], "m").first()
    assert r["m_mean"] == 3.0 and r["m_std"] == pytest.approx(np.std([1, 2, 6]))


def test_weights_carry_the_sample_to_the_target(spark):
    rng = np.random.default_rng(1)
    sample = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (3000, 2)))], "k long, x double, y double")
    target = spark.createDataFrame([(float(a), float(b)) for a, b in np.column_stack([rng.normal(1, 0.6, 1000), rng.normal(0, 1, 1000)])], "x double, y double")
    got = K.importance_weights(sample.unionByName(spark.sql("SELECT -1L AS k, CAST(NULL AS DOUBLE) AS x, 0D AS y")), target, ["x", "y"], "k", "w").cache()
    r = got.agg(F.avg("w"), F.min("w"), F.count("w")).first()
    assert r[0] == pytest.approx(1.0, abs=1e-6) and r[1] >= 0 and r[2] == 3000
    done = got.filter("w IS NOT NULL")
    before = M.wasserstein(M.two_samples(done, "x", target, "x")).first()["wd"]
    after = M.wasserstein(M.two_samples(done, "x", target, "x", "w")).first()["wd"]
    assert after < 0.35 * before


def test_weights_are_within_the_tolerance_of_the_best(spark):
    """A long plain fixed point on the same kernels gains less than the tolerance; too few steps are an error."""
    rng = np.random.default_rng(2)
    x, z = rng.normal(0, 1, (400, 1)), rng.normal(0.7, 0.5, (300, 1))
    sample = spark.createDataFrame([(i, float(a[0])) for i, a in enumerate(x)], "k long, x double")
    target = spark.createDataFrame([(i, float(a[0])) for i, a in enumerate(z)], "t long, x double")
    with pytest.raises(RuntimeError, match="converged"):
        K.importance_weights(sample, target, ["x"], "k", gammas=[1.0], centres=20, max_steps=2, tol=1e-6, target_key="t")
    got = np.array([r["w"] for r in K.importance_weights(sample.unionByName(target.select((F.col("t") + 400).alias("k"), "x")).filter("k < 400"), target, ["x"], "k", "w",
                                                         gammas=[1.0], centres=300, folds=3, tol=1e-3, target_key="t").orderBy("k").collect()])
    m, s = x.mean(), x.std()
    phi_s, phi_t = (np.exp(-((((a - m) / s) - ((z - m) / s).T) ** 2)) for a in (x, z))
    mean = phi_s.mean(axis=0)
    share = np.full(300, 1 / 300)
    for _ in range(20000):
        q = (phi_t / mean / (phi_t / mean @ share)[:, None]).mean(axis=0)
        share = share * q / (share * q).sum()
    best = np.log(phi_t / mean @ share).mean()
    # the mix at the target, read off the weights of the sample by the same kernels
    alpha = np.linalg.lstsq(phi_s, got, rcond=None)[0]
    assert got.mean() == pytest.approx(1, abs=1e-6) and best - 1e-3 - 1e-6 <= np.log(np.maximum(phi_t @ alpha, 1e-300)).mean() <= best + 1e-6


def test_batches_are_drawn_anew_for_every_epoch(spark, monkeypatch):
    """Each epoch's batches hold every row once, and other rows together than the epoch before."""
    s = D.synthetic_fluxes(spark.range(300).withColumnRenamed("id", "k"), "k", 4)
    step, seen = T._step, []

    def spy(part, *more):
        seen.append(frozenset(r["_key"] for r in part.select("_key").collect()))
        return step(part, *more)

    monkeypatch.setattr(T, "_step", spy)
    T.fit_gaussian(s, ["u", "dt"], ["heat"], "k", [3], params=T.FitParams(epochs=3, batches=2))
    epochs = [seen[i:i + 2] for i in (0, 2, 4)]
    assert all(not a & b and len(a | b) == 300 for a, b in epochs) and len({a for a, _ in epochs}) == 3


@pytest.mark.parametrize("name", ["m3_fit_gaussian", "m4_fit_two_step", "m5_fit_sweep", "m6_training_log", "m15_fit_variance"])
def test_the_fits_sql_draws_batches_for_every_epoch(name):
    import checks.q_models  # noqa: F401
    from checks.registry import ORACLES
    assert all(f"concat_ws(':', '{epoch}', k_)" in ORACLES[name] for epoch in range(3))


def test_long_expressions_are_compiled_and_kernels_are_computed_in_place(spark):
    """Generated methods stay below what HotSpot compiles, and a batch's kernels need little beside their result."""
    import tracemalloc
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    x, at = np.random.default_rng(0).normal(size=(2, 400, 3))
    tracemalloc.start()
    got = K._kernels(x, at, K.GAMMAS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d2 = ((x[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
    assert all((part == np.exp(-g * d2)).all() for g, part in zip(K.GAMMAS, got)) and peak < 1.7 * got.nbytes


def test_the_sweep_fits_networks_as_wide_as_the_single_fits(spark, sf, monkeypatch):
    """Eight hidden units for each of the four models, in the query and in its SQL (49 parameters a head)."""
    import checks.q_models as Q
    from checks.registry import ORACLES
    fit, seen = T.fit, {}
    monkeypatch.setattr(T, "fit", lambda rows, models, p: seen.update(models) or fit(rows, models, p))
    Q.m5(spark, sf)
    assert {n: [layers[0][0].shape for layers in (m.mean, m.var)] for n, m in seen.items()} == {f"{o}_{s}": [(8, 4)] * 2 for o in ("taucx", "hsc") for s in (0, 1)}
    assert " AS p97," in ORACLES["m5_fit_sweep"] and " AS p98," not in ORACLES["m5_fit_sweep"]
