"""First-order red noise for ensembles of forcing series.

e_0 = s_0 n_0 and e_i = a e_(i-1) + sqrt(1 - a^2) s_i n_i. A step is the affine map e -> a e + b, and maps compose, so
the recursion is a scan in levels: a series is cut in blocks, each block is summed up from zero by a window, the ends of
the blocks are a shorter series that obeys the same recursion with a to the power of the block length, and what is found
for them enters the next block. Levels end where so few powers of the coefficient differ from zero in double precision
that their terms are added by a join. No term that double precision can hold is left out, no step runs over a whole
series, and the block length changes results by rounding only.

A missing step (a NULL std or innovation) makes the state missing: from there on the member has no value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from halocline.functions.hashing import hash_normal
from halocline.operators.ordered import row_index

#: Most rows of a block.
BLOCK = 4096
#: Powers of a coefficient of at most this many are joined term by term.
TERMS = 8
_SMALLEST = 5e-324


def _recursion(rows: DataFrame, a: float, by: list[str]) -> DataFrame:
    """Add `_e` with _e(0) = _v(0) and _e(i) = a _e(i-1) + _v(i) along the dense index `_i` of each group; `_v` is never NULL."""
    if a < _SMALLEST:
        return rows.withColumn("_e", F.col("_v"))
    decay = -math.log(a)
    terms = int(-math.log(_SMALLEST) / decay)  # powers of a beyond this one are zero
    if terms <= TERMS:
        sent = rows.select(*by, "_v", F.col("_i").alias("_from"), F.explode(F.sequence(F.lit(0), F.lit(terms))).alias("_j"))
        sums = (sent.select(*by, (F.col("_from") + F.col("_j")).alias("_i"), (F.col("_v") * F.pow(F.lit(a), F.col("_j"))).alias("_t"))
                .groupBy(*by, "_i").agg(F.sum("_t").alias("_e")))
        return rows.join(sums, [*by, "_i"])
    # inside a block a^-k stays below 1e150
    size = max(2, min(BLOCK, int(150 * math.log(10) / decay)))
    blocked = rows.withColumn("_block", F.floor(F.col("_i") / size).cast("bigint"))
    k = F.col("_i") - F.col("_block") * size
    along = W.partitionBy(*by, "_block").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    local = blocked.withColumn("_l", F.pow(F.lit(a), k) * F.sum(F.col("_v") * F.pow(F.lit(a), -k)).over(along))
    ends = local.groupBy(*by, "_block").agg(F.max_by("_l", "_i").alias("_v")).withColumnRenamed("_block", "_i")
    states = _recursion(ends, a ** size, by).select(*by, (F.col("_i") + 1).alias("_block"), F.col("_e").alias("_c"))
    out = local.join(states, [*by, "_block"], "left")
    return out.withColumn("_e", F.col("_l") + F.pow(F.lit(a), k + 1) * F.coalesce("_c", F.lit(0.0))).drop("_block", "_l", "_c")


def red_noise(df: DataFrame, std: Column, alpha: float, members: int, seed: int, order: str, tie: str | None = None,
              keep: list[str] = (), name: str = "eps", innovation: Column | None = None) -> DataFrame:
    """`members` realisations along the rows of one series, long: (ensem, order, keep..., eps).

    The innovation defaults to a hash normal of (position, member). From the first missing
    std or innovation of a member on, its values are NULL.
    """
    if not 0.0 <= alpha < 1.0:
        raise ValueError("alpha must be in [0, 1)")
    keep = list(dict.fromkeys([order, *keep]))
    rows = row_index(df.withColumn("_sd", std), [], order, tie, "_i").select("_i", "_sd", *keep)
    rows = rows.withColumn("ensem", F.explode(F.sequence(F.lit(1), F.lit(members))))
    n = hash_normal(seed, F.col("_i"), F.col("ensem")) if innovation is None else innovation
    gain = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(math.sqrt(1 - alpha * alpha)))
    step = gain * F.col("_sd") * n
    driven = rows.withColumn("_step", F.when(~F.isnan(step), step)).withColumn("_v", F.coalesce("_step", F.lit(0.0)))
    gone = driven.groupBy("ensem").agg(F.min(F.when(F.col("_step").isNull(), F.col("_i"))).alias("_gone"))
    # one row a member
    out = _recursion(driven.drop("_sd", "_step"), alpha, ["ensem"]).join(F.broadcast(gone), "ensem", "left")
    return out.select("ensem", *keep, F.when(F.col("_gone").isNull() | (F.col("_i") < F.col("_gone")), F.col("_e")).alias(name))


def noise_scale(flux: str) -> Column:
    """Std of the perturbed flux: heat combines sensible and latent, stress is per component."""
    if flux == "heat":
        return F.hypot(F.col("qh_std"), F.col("ql_std"))
    if flux in ("taux", "tauy"):
        return F.col(f"{flux}_std")
    raise ValueError(f"unknown flux {flux}")


def flux_noise(df: DataFrame, flux: str, corr_hours: float, dt_hours: float, members: int, seed: int,
               order: str = "datetime", tie: str | None = None) -> DataFrame:
    """Red noise of a predicted flux; a correlation time equal to the step gives white noise."""
    return red_noise(df, noise_scale(flux), 1.0 - dt_hours / corr_hours, members, seed, order, tie, name=f"eps_{flux}")


def draw(df: DataFrame, mean: str, var: str, key: str, seed: int, name: str = "sample") -> DataFrame:
    """One draw per row from the predicted normal distribution."""
    return df.withColumn(name, F.col(mean) + F.sqrt(F.col(var)) * hash_normal(seed, F.col(key)))
