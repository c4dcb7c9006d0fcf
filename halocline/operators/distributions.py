"""Histograms, two-dimensional densities and kernel densities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from halocline.functions.arrays import doubles
from halocline.operators.metrics import weighted
from halocline.operators.quality import regime


def edges_of(lo: float, hi: float, n: int) -> list[float]:
    """`n` equal bins between two limits, as n+1 edges."""
    return [float(v) for v in np.linspace(lo, hi, n + 1)]


def _bin_of(df: DataFrame, col: str, edges: list[float], out: str) -> DataFrame:
    """Bin index as in `in_bins`, NULL for rows outside."""
    x = F.col(col).cast("double")
    at = df.withColumn("_x", F.when(x.between(edges[0], edges[-1]), x))
    return (Bucketizer(splits=list(edges), inputCol="_x", outputCol="_b", handleInvalid="keep").transform(at)
            .withColumn(out, F.when(F.col("_x").isNotNull(), F.col("_b").cast("int"))).drop("_x", "_b"))


def in_bins(df: DataFrame, col: str, edges: list[float], out: str = "bin") -> DataFrame:
    """Bin index; bins are closed on the left and the last bin on both sides. Rows outside are left out."""
    x = F.col(col).cast("double")
    inside = df.filter(x.between(edges[0], edges[-1])).withColumn("_x", x)
    return (Bucketizer(splits=list(edges), inputCol="_x", outputCol="_b", handleInvalid="skip").transform(inside)
            .withColumn(out, F.col("_b").cast("int")).drop("_x", "_b"))


def histogram(df: DataFrame, col: str, edges: list[float], w: str | None = None, by: list[str] = (),
              density: bool = True) -> DataFrame:
    """Weight per bin, or density so that the bins of a group integrate to one."""
    at = in_bins(df, col, edges).groupBy(*by, "bin").agg(F.sum(weighted(w)).alias("weight"))
    lo, hi = doubles(edges)[F.col("bin")], doubles(edges)[F.col("bin") + 1]
    at = at.select(*by, "bin", lo.alias("left"), hi.alias("right"), "weight")
    if not density:
        return at
    # at most len(edges) rows per group are left here
    whole = at.withColumn("_all", F.sum("weight").over(W.partitionBy(*by)) if by else at.select(F.sum("weight")).scalar())
    return whole.withColumn("density", F.try_divide(F.col("weight"), F.col("_all") * (F.col("right") - F.col("left")))).drop("_all")


def extent(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Minimum, maximum, mean and number of values of each column."""
    out = []
    for c in cols:
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.count(c).alias(f"{c}_n")]
    return df.groupBy(*by).agg(*out)


def hex_density(df: DataFrame, x: str, y: str, n: int = 50, min_count: int = 1,
                box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Counts on hexagons: two shifted square lattices, each point goes to the nearer centre.

    Without a `box` (xmin, xmax, ymin, ymax) the extent is taken from the data in one aggregate.
    No complete row gives no cell; a constant column has one cell along its axis.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    if box is None:
        box = tuple(rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
        if box[0] is None:  # no complete row: no cell
            box = (0.0, 0.0, 0.0, 0.0)
    xmin, xmax, ymin, ymax = box
    m = int(n / math.sqrt(3))
    sx, sy = (xmax - xmin) / n or 1.0, (ymax - ymin) / m or 1.0
    u, v = (F.col("x") - xmin) / sx, (F.col("y") - ymin) / sy
    i1, j1, i2, j2 = F.rint(u), F.rint(v), F.floor(u).cast("double"), F.floor(v).cast("double")
    d1 = (u - i1) ** 2 + 3.0 * (v - j1) ** 2
    d2 = (u - i2 - 0.5) ** 2 + 3.0 * (v - j2 - 0.5) ** 2
    first = d1 < d2
    cells = rows.select(F.when(first, i1).otherwise(i2 + 0.5).alias("hx"), F.when(first, j1).otherwise(j2 + 0.5).alias("hy"))
    return (cells.groupBy("hx", "hy").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
            .select((F.col("hx") * sx + xmin).alias("cx"), (F.col("hy") * sy + ymin).alias("cy"), "n",
                    F.log10(F.col("n") + 1.0).alias("log_n")))


def kernel_width(df: DataFrame, cols: list[str], w: str | None = None) -> tuple[np.ndarray, float, float] | None:
    """Covariance of a Gaussian kernel by Scott's rule, the weight total and the row count.

    None where there is none: without rows or weight, with one point, or with points on a line.
    """
    wt = weighted(w)
    aggs = [F.sum(wt).alias("s"), F.sum(wt * wt).alias("s2"), F.count(F.lit(1)).alias("n")]
    aggs += [F.try_divide(F.sum(wt * F.col(c)), F.sum(wt)).alias(f"m{i}") for i, c in enumerate(cols)]
    first = df.dropna("any", subset=cols).agg(*aggs).first()
    if not first["s"] or first["s"] ** 2 <= first["s2"]:
        return None
    mean = [first[f"m{i}"] for i in range(len(cols))]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    second = df.dropna("any", subset=cols).agg(*[
        F.sum(wt * (F.col(cols[i]) - mean[i]) * (F.col(cols[j]) - mean[j])).alias(f"c{i}{j}") for i, j in pairs]).first()
    total, squares = float(first["s"]), float(first["s2"])
    effective = total * total / squares
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = second[f"c{i}{j}"] / total / (1.0 - squares / total**2)
    spread = np.sqrt(np.diag(cov))
    if not (spread > 0).all() or np.linalg.det(cov / np.outer(spread, spread)) < 1e-12:
        return None
    return cov * effective ** (-2.0 / (len(cols) + 4)), total, float(first["n"])


def kde_grid(df: DataFrame, cols: list[str], grid: list[list[float]], w: str | None = None,
             counts: bool = False) -> DataFrame:
    """Gaussian kernel density of one or two columns on the product of the given axes.

    The weights of equal points are summed first, so that a recorded value costs one kernel
    however often it was met. Each task adds its points up on the whole grid, so only one grid
    per task is shuffled. `counts` scales the density by the number of samples. Without a
    kernel width (no rows, or all on one point or line) there are no rows.
    """
    rows = df.dropna("any", subset=cols + ([w] if w else []))
    width = kernel_width(rows, cols, w)
    if width is None:
        return df.sparkSession.createDataFrame([], ", ".join([*(f"g{k} double" for k in range(len(cols))), "density double"]))
    cov, total, n = width
    mesh = np.stack([m.ravel() for m in np.meshgrid(*grid, indexing="ij")], axis=1)
    whiten = np.linalg.cholesky(np.linalg.inv(cov))
    centres = mesh @ whiten
    factor = (n if counts else 1.0) / total / math.sqrt((2 * math.pi) ** len(cols) * np.linalg.det(cov))
    step = max(1, 4_000_000 // len(mesh))

    def spread(batches):
        import pandas as pd
        acc = np.zeros(len(centres))
        for pdf in batches:
            pts = pdf.iloc[:, :-1].to_numpy() @ whiten
            wts = pdf.iloc[:, -1].to_numpy()
            for a in range(0, len(pts), step):
                p, v = pts[a:a + step], wts[a:a + step]
                d2 = sum((p[:, k][:, None] - centres[:, k][None, :]) ** 2 for k in range(p.shape[1]))
                acc += v @ np.exp(-0.5 * d2)
        yield pd.DataFrame({"g": np.arange(len(acc)), "s": acc})

    narrow = (rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], weighted(w).alias("w"))
              .groupBy(*[f"x{i}" for i in range(len(cols))]).agg(F.sum("w").alias("w")))
    sums = narrow.mapInPandas(spread, "g long, s double").groupBy("g").agg(F.sum("s").alias("s"))
    at, left = [], F.col("g")
    for k in range(len(cols) - 1, -1, -1):
        at.insert(0, doubles(grid[k])[(left % len(grid[k])).cast("int")].alias(f"g{k}"))
        left = F.floor(left / len(grid[k]))
    return sums.select(*at, (F.col("s") * factor).alias("density"))


def regime_stats(df: DataFrame, bounds: dict[str, tuple[float, float]], col: str) -> DataFrame:
    """Mean and population std of a column inside a regime."""
    return regime(df, bounds).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.count(col).alias("n"))


def binned_stats(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """Mean and std of `y` in `n` equal bins of `x` between its extremes; one bin where `x` is constant, none without rows."""
    rows = df.dropna("any", subset=[x, y])
    lo, hi = rows.agg(F.min(x), F.max(x)).first()
    if lo is None or lo == hi:
        out = rows.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.count(y).alias("n")).filter("n > 0")
        return out.select(F.lit(0).alias("bin"), "mean", "std", "n", F.lit(lo).cast("double").alias("left"))
    edges = edges_of(lo, hi, n)
    at = in_bins(rows, x, edges).groupBy("bin").agg(
        F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.count(y).alias("n"))
    return at.withColumn("left", doubles(edges)[F.col("bin")])


def compare_distributions(df: DataFrame, cols: dict[str, list[float]], campaign: str) -> DataFrame:
    """Density histograms of several variables, campaign by campaign, in one long table; the rows are read once."""
    at = df.select(F.col(campaign), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    for i, edges in enumerate(cols.values()):
        at = _bin_of(at, f"_v{i}", edges, f"_b{i}")
    told = [F.struct(F.lit(c).alias("variable"), F.col(f"_b{i}").alias("bin"), F.get(doubles(edges), F.col(f"_b{i}")).alias("left"),
                     (F.get(doubles(edges), F.col(f"_b{i}") + 1) - F.get(doubles(edges), F.col(f"_b{i}"))).alias("_wide")) for i, (c, edges) in enumerate(cols.items())]
    counts = (at.select(campaign, F.inline(F.array(*told))).filter(F.col("bin").isNotNull())
              .groupBy(campaign, "variable", "bin", "left", "_wide").agg(F.count(F.lit(1)).alias("_n")))
    share = F.col("_n") / F.sum("_n").over(W.partitionBy(campaign, "variable")) / F.col("_wide")
    return counts.select(campaign, "variable", "bin", "left", share.alias("density"))


def raw_exchange(df: DataFrame, flux: str, u: str, dt: Column, eps: float = 1e-8, limit: float = 100.0) -> DataFrame:
    """Mean and std of -flux/(U+eps)/(dT+eps) after the outlier guard."""
    ch = F.try_divide(F.try_divide(-F.col(flux), F.col(u) + eps), dt + eps)
    kept = df.withColumn("ch", ch).filter(F.abs("ch") < limit)
    return kept.agg(F.avg("ch").alias("mean"), F.stddev_pop("ch").alias("std"), F.count("ch").alias("n"))
