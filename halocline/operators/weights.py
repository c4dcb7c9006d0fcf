"""Importance weights that carry a sample to a target distribution (kernel density ratio,
Sugiyama et al. 2008).

The ratio is a non-negative mix of Gaussian kernels around target centres. Divided by the
sample mean of each kernel, the mix becomes a mixture whose shares maximise the mean log weight
of the target, a concave problem. With q the mean over the target of each kernel over the mix,
expectation-maximisation multiplies the shares by q; here they are multiplied by q to a power that
grows by GROW with every step that gains and starts anew at 1 after one that does not. Every step is
one aggregate over the target, keeps the mean weight of the sample at one, and serves all
kernel widths and folds that are not finished. The largest q minus one bounds what the mean
log weight can still gain, so a fit ends when that is below a tolerance, and an error is
raised when it is not within the steps allowed.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from halocline.functions.hashing import hash_hex
from halocline.operators.training import FAN_IN, spread_and_cache

# Candidate kernel widths (gamma of exp(-gamma d^2)).
GAMMAS = [10.0 ** (i - 3) for i in range(7)]
MAX_CENTRES = 100
TINY = 1e-300
GROW = 1.5
SLICE = 500                     # rows whose kernels are computed together; they stay in the processor's cache


def _kernels(x: np.ndarray, centres: np.ndarray, gammas: list[float]) -> np.ndarray:
    """Kernel values, (gammas, rows, centres)."""
    d2 = sum((x[:, i, None] - centres[None, :, i]) ** 2 for i in range(x.shape[1]))
    out = np.empty((len(gammas), *d2.shape))
    for g, part in zip(gammas, out):
        np.exp(np.multiply(d2, -g, out=part), out=part)
    return out


def _summed(df: DataFrame, cols: list[str], fn, shape: tuple, n_parts: int) -> np.ndarray:
    """Sum over all rows of `fn(x, fold)`, an array of fixed shape; at most FAN_IN of them reach the driver."""
    size = int(np.prod(shape))

    def part(batches):
        acc = np.zeros(size)
        for pdf in batches:
            x, fold = pdf[cols].to_numpy(dtype=float), pdf["_fold"].to_numpy()
            for a in range(0, len(x), SLICE):
                acc += fn(x[a:a + SLICE], fold[a:a + SLICE]).ravel()
        yield pd.DataFrame({"v": [acc]})

    sums = df.select(*cols, "_fold").mapInPandas(part, "v array<double>")
    if n_parts > FAN_IN:
        def add(pdf):
            return pd.DataFrame({"v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})
        sums = sums.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).groupBy("_lane").applyInPandas(add, "v array<double>")
    out = np.zeros(size)
    for r in sums.collect():
        out += np.asarray(r["v"])
    return out.reshape(shape)


def importance_weights(sample: DataFrame, target: DataFrame, cols: list[str], key: str, name: str = "weight",
                       gammas: list[float] | None = None, centres: int = MAX_CENTRES, folds: int = 5, tol: float = 1e-2,
                       max_steps: int = 2000, target_key: str | None = None, seed: int = 0) -> DataFrame:
    """Add a weight with mean one to every complete sample row; incomplete rows get NULL.

    The width is chosen by the mean log weight of held-out target folds. Every fit is within
    `tol` of its greatest mean log weight.
    """
    gammas = list(gammas or GAMMAS)
    pick = hash_hex(seed, F.col(target_key) if target_key else F.concat_ws("|", *cols))
    target = target.dropna("any", subset=cols)
    source = sample.dropna("any", subset=cols)
    spread = source.agg(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.stddev_pop(c).alias(f"{c}_s") for c in cols]).first()
    if any(v is None for v in spread):
        raise ValueError("the sample has no complete row")
    scaled = [((F.col(c) - spread[f"{c}_m"]) / (spread[f"{c}_s"] or 1.0)).alias(c) for c in cols]
    t = target.select(*scaled, pick.alias("_h"), (F.conv(F.substring(pick, 30, 3), 16, 10).cast("int") % folds).alias("_fold"))
    first = (t if target_key else t.dropDuplicates(cols)).orderBy("_h", *cols).limit(centres)
    at = np.array([[r[c] for c in cols] for r in first.collect()], dtype=float)
    if not len(at):
        raise ValueError("the target has no complete row")
    t, t_parts = spread_and_cache(t.drop("_h"))
    s = source.select(*scaled).withColumn("_fold", F.lit(0))
    g, c = len(gammas), len(at)

    both = _summed(s, cols, lambda x, f: np.concatenate([_kernels(x, at, gammas).sum(axis=1), np.full((1, c), len(x))]), (g + 1, c), FAN_IN + 1)
    mean = np.maximum(both[:g] / both[g, 0], TINY)

    def sums(share, live):
        """For every live (width, fold): kernels over the mix, log mix and rows, and the last two over the rows held out. Fold `folds` holds out none."""
        wide = [i for i in range(g) if live[i].any()]

        def one(x, fold):
            phi = _kernels(x, at, [gammas[i] for i in wide]) / mean[wide][:, None, :]
            out = np.zeros((g, folds + 1, c + 4))
            for j, i in enumerate(wide):
                for k in np.flatnonzero(live[i]):
                    mine = fold != k
                    mix = np.maximum(phi[j] @ share[i, k], TINY)
                    out[i, k, :c] = (mine / mix) @ phi[j]
                    log = np.log(mix)
                    out[i, k, c:] = log[mine].sum(), mine.sum(), log[~mine].sum(), (~mine).sum()
            return out
        return _summed(t, cols, one, (g, folds + 1, c + 4), t_parts)

    def fitted(live):
        """Shares of the live (width, fold) pairs, each within the tolerance."""
        share = np.full((g, folds + 1, c), 1.0 / c)
        kept, slope = share.copy(), np.ones_like(share)
        reached, power = np.full((g, folds + 1), -np.inf), np.ones((g, folds + 1))
        steps = 0
        while live.any():
            if steps == max_steps:
                raise RuntimeError(f"weights have not converged to {tol} in {max_steps} steps: raise max_steps or tol")
            steps += 1
            got = sums(share, live)
            n = np.maximum(got[:, :, c + 1], 1)
            value, q = got[:, :, c] / n, got[:, :, :c] / n[:, :, None]
            gain = live & (value >= reached)
            kept[gain], slope[gain], reached[gain] = share[gain], q[gain], value[gain]
            live = live & ~(gain & (slope.max(axis=2) - 1 < tol))
            power = np.where(gain, power * GROW, 1.0)
            share = np.where(live[:, :, None], kept * slope ** power[:, :, None], kept)
            share /= np.maximum(share.sum(axis=2, keepdims=True), TINY)
        return kept

    # every width on the rows outside each fold, then the chosen width on all rows
    some = np.ones((g, folds + 1), bool)
    some[:, folds] = False
    held = sums(fitted(some), some)
    score = held[:, :folds, c + 2].sum(axis=1) / np.maximum(held[:, :folds, c + 3].sum(axis=1), 1)
    best = int(np.argmax(score))
    whole = np.zeros((g, folds + 1), bool)
    whole[best, folds] = True
    alpha, gamma = fitted(whole)[best, folds] / mean[best], gammas[best]
    t.unpersist()

    @F.pandas_udf("double")
    def ratio(v: pd.DataFrame) -> pd.Series:
        x = v.to_numpy(dtype=float)
        return pd.Series(np.concatenate([_kernels(x[a:a + SLICE], at, [gamma])[0] @ alpha for a in range(0, len(x), SLICE)])
                         if len(x) else np.zeros(0))

    complete = F.lit(True)
    for k in cols:
        complete = complete & F.col(k).isNotNull()
    w = ratio(F.struct(*scaled))
    return sample.withColumn(name, w).withColumn(name, F.when(complete, F.col(name)))


def global_weights(sample: DataFrame, grid: DataFrame, cols: list[str], key: str, max_lat: float = 60.0, **kw) -> DataFrame:
    """Weights toward a gridded climate: cells south of a latitude with all variables present."""
    from halocline.operators.quality import grid_to_samples
    keep = [kw["target_key"]] if kw.get("target_key") else []
    return importance_weights(sample, grid_to_samples(grid, cols + keep, max_lat), cols, key, **kw)
