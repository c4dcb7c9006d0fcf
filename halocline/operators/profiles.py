"""Depth profiles: common levels, mixed-layer depth, surface values.

A profile is one depth axis, so its number of rows is set by the depth grid (a few hundred),
never by the amount of data; that is what makes an array per profile safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from halocline.functions.arrays import doubles
from halocline.functions.thermo import rho0
from halocline.session import shuffle_width

TASK_ROWS = 1_000_000           # rows of profiles that one task groups and sorts


def surface(df: DataFrame, by: list[str], cols: list[str], z: str = "z") -> DataFrame:
    """Values at the top level of each profile."""
    return df.groupBy(*by).agg(*[F.max_by(c, z).alias(c) for c in cols])


def _crossing(points: Column, threshold: Column, extrapolate: bool) -> Column:
    """Depth where a profile, sorted by value, reaches the threshold, by linear interpolation."""
    n = F.size(points)
    below = F.size(F.filter(points, lambda p: p["v"] < threshold))
    k = F.greatest(F.lit(1), F.least(n - 1, below))
    lo, hi = F.try_element_at(points, k), F.try_element_at(points, k + 1)
    depth = lo["z"] + (threshold - lo["v"]) * F.try_divide(hi["z"] - lo["z"], hi["v"] - lo["v"])
    inside = F.lit(True) if extrapolate else (below >= 1) & (threshold <= F.element_at(points, -1)["v"])
    return F.when((n >= 2) & inside, depth)


def mixed_layer_depth(df: DataFrame, by: list[str], criterion: str = "density", z: str = "z", temp: str = "temp",
                      salt: str = "salt", step: float | None = None, extrapolate: bool = True,
                      keep: list[str] = ()) -> DataFrame:
    """Depth (negative) where density is 0.1 above, or temperature 0.2 below, its surface value.

    The profile is sorted by value, so a non-monotone one is re-ordered; equal neighbouring
    values give NULL. `keep` carries surface values of further columns along.
    """
    if criterion == "density":
        value, delta = rho0(salt, temp), 0.1 if step is None else step
    elif criterion == "temperature":
        value, delta = F.col(temp), -(0.2 if step is None else step)
    else:
        raise ValueError(f"unknown criterion {criterion}")
    at = df.withColumn("_v", value).filter(F.col("_v").isNotNull() & F.col(z).isNotNull())
    prof = at.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_v").alias("v"), F.col(z).alias("z")))).alias("_pts"),
        F.max_by("_v", z).alias("_top"), *[F.max_by(c, z).alias(c) for c in keep])
    return prof.select(*by, *keep, _crossing(F.col("_pts"), F.col("_top") + delta, extrapolate).alias("mld"))


def _below(depths: Column, level: Column) -> Column:
    """How many of the sorted depths lie below a level, by halving steps."""
    n = F.size(depths)
    steps = F.transform(F.sequence(F.ceil(F.log2(n + 1)).cast("int") - 1, F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.try_element_at(depths, at + step) < level), at + step).otherwise(at))


def interp_levels(df: DataFrame, by: list[str], levels: list[float], cols: list[str], z: str = "z") -> DataFrame:
    """Profiles on common depths by linear interpolation; end segments are extended.

    Values at a depth that a profile has more than once are averaged first. A profile with
    fewer than two depths gives NULL, as does a segment with a missing end.
    """
    by = list(by)
    keep = df.filter(F.col(z).isNotNull())
    if by:
        # one shuffle by profile serves both aggregates; its width follows the rows, so that a task's memory does not
        keep = keep.repartition(max(shuffle_width(df.sparkSession), -(-df.count() // TASK_ROWS)), *by)
    points = keep.groupBy(*by, z).agg(*[F.avg(c).alias(c) for c in cols])
    prof = points.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(z).alias("z"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)]))).alias("_p"))
    grid = doubles(sorted(float(v) for v in levels))
    p, depths = F.col("_p"), F.col("_p.z")

    def at(level):
        k = F.greatest(F.lit(1), F.least(F.size(p) - 1, _below(depths, level)))
        lo, hi = F.try_element_at(p, k), F.try_element_at(p, k + 1)
        value = [lo[f"v{i}"] + (hi[f"v{i}"] - lo[f"v{i}"]) / (hi["z"] - lo["z"]) * (level - lo["z"]) for i in range(len(cols))]
        return F.struct(level.alias(z), *[F.when(F.size(p) >= 2, v).alias(c) for c, v in zip(cols, value)])

    return prof.select(*by, F.inline(F.transform(grid, at)))
