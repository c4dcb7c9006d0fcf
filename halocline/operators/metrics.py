"""Scores of predictions against measurements; every score is one grouped aggregate."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from halocline.functions.arrays import doubles
from halocline.operators.ordered import CHUNK, cut, scan
from halocline.schema import require_columns


def _one() -> Column:
    return F.lit(1.0)


def weighted(w: str | None) -> Column:
    return F.col(w) if w else _one()


def wmean(x: Column, w: Column) -> Column:
    """Weighted mean over rows where both are present."""
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def wvar(x: Column, w: Column) -> Column:
    """Weighted variance about the weighted mean, in one pass."""
    return wmean(x * x, w) - wmean(x, w) * wmean(x, w)


def _pairs(df: DataFrame, *cols: str) -> DataFrame:
    require_columns(df, cols)
    return df.dropna("any", subset=list(cols))


def mse_r2(df: DataFrame, pred: str, truth: str, by: list[str] = (), ddof: int = 0) -> DataFrame:
    """Mean squared error and R2; `ddof=1` compares with the sample variance."""
    err = (F.col(pred) - F.col(truth)) ** 2
    var = F.var_pop(truth) if ddof == 0 else F.var_samp(truth)
    return _pairs(df, pred, truth).groupBy(*by).agg(
        F.avg(err).alias("mse"), (1 - F.try_divide(F.avg(err), var)).alias("r2"))


def mse_r2_weighted(df: DataFrame, pred: str, truth: str, w: str, by: list[str] = ()) -> DataFrame:
    err, wt = (F.col(pred) - F.col(truth)) ** 2, F.col(w)
    return _pairs(df, pred, truth, w).groupBy(*by).agg(
        wmean(err, wt).alias("mse"), (1 - F.try_divide(wmean(err, wt), wvar(F.col(truth), wt))).alias("r2"))


def residual(pred: str, truth: str, var: str) -> Column:
    """Error in units of the predicted standard deviation, prediction minus truth."""
    return F.try_divide(F.col(pred) - F.col(truth), F.sqrt(F.col(var)))


def residual_moments(df: DataFrame, pred: str, truth: str, var: str, w: str | None = None,
                     by: list[str] = ()) -> DataFrame:
    """Mean and raw second moment of the normalised residual."""
    r = residual(pred, truth, var)
    return _pairs(df, pred, truth, var, *([w] if w else [])).groupBy(*by).agg(
        wmean(r, weighted(w)).alias("res_mean"), wmean(r * r, weighted(w)).alias("res_var"))


def normal_quantiles(n: int = 2001) -> list[float]:
    """Mid-point quantiles of the standard normal."""
    d = NormalDist()
    return [d.inv_cdf((j - 0.5) / n) for j in range(1, n + 1)]


def wasserstein(points: DataFrame, by: list[str] = (), x: str = "x", wa: str = "wa", wb: str = "wb",
                like: DataFrame | None = None) -> DataFrame:
    """Area between two weighted empirical distribution functions.

    `points` holds both samples: a row of the first has weight `wa` and `wb` = 0, and the
    other way round. Chunk edges come from the rows as they are, without a shuffle; equal
    positions are then summed map-side, so no position is hot afterwards.
    """
    at = (cut(points.filter(F.col(x).isNotNull()), x, like=like).groupBy(*by, x, CHUNK)
          .agg(F.sum(wa).alias("a"), F.sum(wb).alias("b")))
    s = scan(at, list(by), x, None, {"fa": F.col("a"), "fb": F.col("b")}, totals=True, after=[x])
    gap = F.abs(F.try_divide(F.col("fa"), F.col("fa_total")) - F.try_divide(F.col("fb"), F.col("fb_total")))
    return s.groupBy(*by).agg(F.sum(gap * (F.col(f"next_{x}") - F.col(x))).alias("wd"))


def two_samples(a: DataFrame, x: str, b: DataFrame, y: str, w: str | None = None, v: str | None = None,
                by: list[str] = ()) -> DataFrame:
    """Stack two samples in the shape `wasserstein` reads."""
    left = a.select(*by, F.col(x).cast("double").alias("x"), weighted(w).alias("wa"), F.lit(0.0).alias("wb"))
    right = b.select(*by, F.col(y).cast("double").alias("x"), F.lit(0.0).alias("wa"), weighted(v).alias("wb"))
    return left.unionByName(right)


def two_columns(df: DataFrame, a: str, b: str, wa: str | None = None, wb: str | None = None, by: list[str] = ()) -> DataFrame:
    """Two columns of one table in the shape `wasserstein` reads, from a single pass."""
    def point(x, u, v):
        return F.struct(F.col(x).cast("double").alias("x"), u.cast("double").alias("wa"), v.cast("double").alias("wb"))

    zero = F.lit(0.0)
    return df.select(*by, F.inline(F.array(point(a, weighted(wa), zero), point(b, zero, weighted(wb)))))


def wasserstein_normal(df: DataFrame, x: Column, w: str | None = None, by: list[str] = (), n: int = 2001) -> DataFrame:
    """Distance of a column from the standard normal, which is a table of `n` quantiles."""
    mine = df.select(*by, x.alias("x"), weighted(w).alias("wa"), F.lit(0.0).alias("wb"))
    groups = mine.select(*by).distinct() if by else df.sparkSession.range(1).select()
    ref = groups.select(*by, F.explode(doubles(normal_quantiles(n))).alias("x"),
                        F.lit(0.0).alias("wa"), F.lit(1.0).alias("wb"))
    return wasserstein(mine.unionByName(ref), by, like=mine.filter(F.col("x").isNotNull()))


def evaluate(df: DataFrame, pred: str, truth: str, var: str, bulk: str, w: str | None = None,
             by: list[str] = ()) -> DataFrame:
    """Seven scores per group: predictor mse and r2, residual moments and distance, bulk mse and r2."""
    rows = _pairs(df, pred, truth, var, bulk, *([w] if w else []))
    wt, r = weighted(w), residual(pred, truth, var)
    e, eb = (F.col(pred) - F.col(truth)) ** 2, (F.col(bulk) - F.col(truth)) ** 2
    spread = wvar(F.col(truth), wt)
    scores = rows.groupBy(*by).agg(
        wmean(e, wt).alias("mse"), (1 - F.try_divide(wmean(e, wt), spread)).alias("r2"),
        wmean(r, wt).alias("res_mean"), wmean(r * r, wt).alias("res_var"),
        wmean(eb, wt).alias("bulk_mse"), (1 - F.try_divide(wmean(eb, wt), spread)).alias("bulk_r2"))
    wd = wasserstein_normal(rows, r, w, by)
    if not by:
        return scores.withColumn("wd", wd.select("wd").scalar())
    wd = wd.withColumnsRenamed({b: f"_g_{b}" for b in by})
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    return scores.join(wd, on, "left").drop(*[f"_g_{b}" for b in by])


def bias(df: DataFrame, pred: str, truth: str, bulk: str, w: str | None = None, by: list[str] = ()) -> DataFrame:
    rows = _pairs(df, pred, truth, bulk, *([w] if w else []))
    t, wt = F.col(truth), weighted(w)
    return rows.groupBy(*by).agg(wmean(F.col(pred) - t, wt).alias("ann_bias"), wmean(F.col(bulk) - t, wt).alias("bulk_bias"))


# Hold-out cruise codes of the geographic splits.
SPLITS_3 = {"metz": [77], "extratropics": [67, 72, 73, 78, 71], "tropics": [68, 83, 69, 87]}
SPLITS_4 = {"Metz": [77], "N. Pac./Atl.": [67, 72, 78], "Southern Ocean": [73, 71], "Tropics": [68, 83, 69, 87]}

# What each of the six overlapping splits holds out; it is trained on all other cruises of the list.
HELD_OUT_6 = [[77], [69], [83], [87, 72, 71], [68], [78, 67, 73]]


def roles_of(held_out: list[list[int]]) -> dict[str, list[int]]:
    """`<i> train` and `<i> test` code lists of splits that each leave some codes out; train lists overlap."""
    codes = [c for part in held_out for c in part]
    return {f"{i} {role}": [c for c in codes if (c in part) == (role == "test")] for i, part in enumerate(held_out, 1) for role in ("train", "test")}


SPLITS_6 = roles_of(HELD_OUT_6)


def hold_out(df: DataFrame, splits: dict[str, list[int]], code: str = "pcode") -> DataFrame:
    """Rows of each split's hold-out groups; a code listed by several splits repeats its rows.

    The split table has one row per listed code, so it is always small enough to broadcast.
    """
    rows = [(name, int(c)) for name, codes in splits.items() for c in codes]
    table = df.sparkSession.createDataFrame(rows, f"split string, {code} int")
    return df.join(F.broadcast(table), code)


def evaluate_over_splits(df: DataFrame, splits: dict[str, list[int]], pred: str, truth: str, bulk: str,
                         w: str | None = None, code: str = "pcode") -> DataFrame:
    """Mean squared error, R2 and bias of predictor and bulk in each split."""
    rows = hold_out(_pairs(df, pred, truth, bulk, *([w] if w else [])), splits, code)
    t, wt = F.col(truth), weighted(w)
    spread = wvar(t, wt)
    cols = []
    for tag, c in (("ann", F.col(pred)), ("bulk", F.col(bulk))):
        mse = wmean((c - t) ** 2, wt)
        cols += [mse.alias(f"{tag}_mse"), (1 - F.try_divide(mse, spread)).alias(f"{tag}_r2"), wmean(c - t, wt).alias(f"{tag}_bias")]
    return rows.groupBy("split").agg(*cols, F.count(F.lit(1)).alias("n"))


def bias_over_splits(df: DataFrame, splits: dict[str, list[int]], pred: str, truth: str, bulk: str,
                     w: str | None = None) -> DataFrame:
    return bias(hold_out(df, splits), pred, truth, bulk, w, ["split"])


def score_table(runs: DataFrame, seed: str, role: str, pred: str, truth: str, roles: list[str]) -> DataFrame:
    """One row per seed, the R2 of each role side by side."""
    return mse_r2(runs, pred, truth, [seed, role]).groupBy(seed).pivot(role, roles).agg(F.first("r2"))


def score_spread(scores: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Mean and population std of scores across runs."""
    return scores.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_mean") for c in cols],
                                   *[F.stddev_pop(c).alias(f"{c}_std") for c in cols])


def fit_scales(df: DataFrame, cols: list[str], w: str | None = None) -> DataFrame:
    """Location mean(x w) and scale sqrt(mean((x-m)^2 w)), both divided by the row count."""
    wt = weighted(w)
    rows = _pairs(df, *cols, *([w] if w else []))
    out = []
    for c in cols:
        x = F.col(c)
        m, m2, mw = F.avg(x * wt), F.avg(x * x * wt), F.avg(wt)
        out += [m.alias(f"{c}_mean"), F.sqrt(m2 - 2 * m * m + m * m * mw).alias(f"{c}_scale")]
    return rows.agg(*out)


def nll(pred: str, truth: str, var: str, floor: float = 1e-6) -> Column:
    """Gaussian negative log-likelihood without its constant; the variance has a floor."""
    v = F.greatest(F.col(var), F.lit(floor))
    return 0.5 * (F.log(v) + (F.col(truth) - F.col(pred)) ** 2 / v)


def gaussian_nll(df: DataFrame, pred: str, truth: str, var: str, w: str | None = None, by: list[str] = ()) -> DataFrame:
    return _pairs(df, pred, truth, var).groupBy(*by).agg(F.avg(nll(pred, truth, var) * weighted(w)).alias("nll"))


def score_scaled(df: DataFrame, pred: str, truth: str, var: str, w: str, by: list[str] = ()) -> DataFrame:
    """Five scores on scaled data; weights enter as mean(x w)."""
    wt, t = F.col(w), F.col(truth)
    r = residual(pred, truth, var)
    mse = F.avg((F.col(pred) - t) ** 2 * wt)
    return _pairs(df, pred, truth, var, w).groupBy(*by).agg(
        mse.alias("mse"), (1 - F.try_divide(mse, F.avg(t * t * wt))).alias("r2"),
        F.avg(nll(pred, truth, var) * wt).alias("nll"),
        F.avg(r * wt).alias("res_mean"), F.avg(r * r * wt).alias("res_var"))


def weight_share(df: DataFrame, w: str, by: list[str]) -> DataFrame:
    """Share of rows next to share of weight per group."""
    parts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("s"))
    n, s = parts.select(F.sum("n")).scalar(), parts.select(F.sum("s")).scalar()
    return parts.select(*by, F.try_divide(F.col("n"), n).alias("unweighted"), F.try_divide(F.col("s"), s).alias("weighted"))
