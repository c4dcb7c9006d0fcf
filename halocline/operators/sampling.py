"""Splits, resampling, synthetic samples and feature grids.

All draws come from keyed hashes, so they do not depend on partitions or on the run.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from halocline.functions.arrays import doubles
from halocline.functions.hashing import hash_hex, hash_normal, hash_rayleigh, hash_uniform
from halocline.operators.ordered import scan

DIGITS, LEVELS = 4, 3          # hex digits per pass, passes


def split_by_group(df: DataFrame, train: list[int], valid: list[int], test: list[int] | None = None, code: str = "pcode") -> DataFrame:
    """Add `role` by lists of codes. Without a third list the validation groups are the test groups too."""
    roles = [("train", c) for c in train] + [("valid", c) for c in valid] + [("test", c) for c in (valid if test is None else test)]
    table = df.sparkSession.createDataFrame(roles, f"role string, {code} int")
    return df.join(F.broadcast(table), code)


def role_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def _rank_hash(seed: int, key: str) -> Column:
    return F.substring(hash_hex(seed, F.col(key)), 1, DIGITS * LEVELS)


def split_random(df: DataFrame, key: str, seed: int = 7, ratio: float = 0.2, role: str = "role") -> DataFrame:
    """Exactly int(N ratio) rows are held out: those with the smallest hash of the unique key.

    The cut is found digit by digit: a count of at most 65 536 hash prefixes, then the same
    inside the one prefix that holds the cut. Rows are neither sorted nor shuffled.
    """
    h = _rank_hash(seed, key)
    wanted = int(df.count() * ratio)
    prefix, left = "", wanted
    for level in range(1, LEVELS + 1):
        inside = df.select(h.alias("h")).filter(F.col("h").startswith(prefix)) if prefix else df.select(h.alias("h"))
        counts = inside.groupBy(F.substring("h", 1, DIGITS * level).alias("p")).count().orderBy("p").collect()
        nxt = None
        for r in counts:
            if left < r["count"]:
                nxt = r["p"]
                break
            left -= r["count"]
        if nxt is None:
            return df.withColumn(role, F.lit("valid"))
        prefix = nxt
        if left == 0:
            break
    if left:
        # rows that share a 48-bit hash, normally one; the cut falls among their keys
        tied = [r[0] for r in df.filter(h == prefix).select(key).orderBy(key).limit(left + 1).collect()]
        if len(tied) > left and tied[left] == tied[left - 1]:
            raise ValueError(f"{key} is not unique, the split would be ambiguous")
        held = (h < prefix) | ((h == prefix) & (F.col(key) < tied[left] if len(tied) > left else F.lit(True)))
    else:
        held = h < prefix
    return df.withColumn(role, F.when(held, "valid").otherwise("train"))


def uniform_draws(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("draw"), hash_uniform(seed, F.col("id")).alias("u"))


def resample_rows(df: DataFrame, key: str, n: int, seed: int = 0, w: str | None = None, expand: bool = True) -> DataFrame:
    """Draw `n` rows with replacement, with probability proportional to `w`.

    Every row owns an interval of cumulative weight, in key order. Draws and interval ends
    are merged into one ordered scan; the number of draws below an end minus the number
    below the row before is the row's number of copies. Nothing is joined, and a row of
    great weight is one row until `expand` repeats it. Keys that are text are taken in the
    order of their hashes.
    """
    if isinstance(df.schema[key].dataType, T.StringType):
        hashed = df.withColumn("_order", F.xxhash64(key))
        return resample_rows(hashed, "_order", n, seed, w, expand).drop("_order")
    weight = (F.col(w) if w else F.lit(1.0)).cast("double")
    rows = scan(df, [], key, None, {"_cum": weight}, totals=True)
    ends = rows.select(F.struct(*df.columns).alias("_src"), F.try_divide(F.col("_cum"), F.col("_cum_total")).alias("_at"),
                       F.lit(0).cast("bigint").alias("_hit"), F.col(key).cast("double").alias("_k"))
    draws = uniform_draws(df.sparkSession, n, seed).select(
        F.lit(None).cast(ends.schema["_src"].dataType).alias("_src"), F.col("u").alias("_at"),
        F.lit(1).cast("bigint").alias("_hit"), F.lit(None).cast("double").alias("_k"))
    # a draw equal to an end belongs to the row after it, so ends come first at equal positions
    points = ends.unionByName(draws).withColumn("_tie", F.coalesce("_k", F.lit(math.inf)))
    counted = scan(points, [], "_at", "_tie", {"_below": F.col("_hit")}, inclusive=False).filter("_hit = 0")
    counted = scan(counted, [], "_k", None, before=["_below"])
    copies = F.col("_below") - F.coalesce("prev__below", F.lit(0).cast("bigint"))
    out = counted.select("_src.*", copies.alias("copies")).filter("copies > 0")
    if not expand:
        return out
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")


def synthetic_fluxes(keys: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One synthetic sample per key: Rayleigh wind, normal temperature difference, momentum and
    heat flux with state-dependent noise, together with their true mean and std."""
    k = F.col(key)
    rows = keys.select(k, hash_rayleigh(seed, 5.0, k).alias("u"), (-0.8 + 0.8 * hash_normal(seed + 1, k)).alias("dt"),
                       hash_normal(seed + 3, k).alias("_e1"), hash_normal(seed + 5, k).alias("_e2"))
    rows = rows.withColumns({
        "tau_mean": 0.0015 * F.col("u") ** 2, "tau_std": 0.2 * 0.0015 * F.col("u") ** 2 + 0.01,
        "heat_mean": F.col("u") * F.col("dt"), "heat_std": 0.15 * F.abs(F.col("u") * F.col("dt")) + 1.0})
    return rows.withColumns({"tau": F.col("tau_mean") + F.col("tau_std") * F.col("_e1"),
                             "heat": F.col("heat_mean") + F.col("heat_std") * F.col("_e2")}).drop("_e1", "_e2")


def synthetic_sine(keys: DataFrame, key: str, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """x uniform on (-pi, pi), y = sin x with noise of std `noise` cos(x)^2."""
    k = F.col(key)
    x = (2 * hash_uniform(seed, k) - 1) * math.pi
    rows = keys.select(k, x.alias("x"), hash_normal(seed + 1, k).alias("_e"))
    rows = rows.withColumns({"y_mean": F.sin("x"), "y_std": noise * F.cos("x") ** 2})
    return rows.withColumn("y", F.col("y_mean") + F.col("y_std") * F.col("_e")).drop("_e")


def feature_grid(base: DataFrame, axes: dict[str, tuple[float, float, int]], fixed: dict[str, float] | None = None) -> DataFrame:
    """For each row of `base` a regular grid over the axes (lo, hi, points), other features fixed."""
    out = base
    for name, (lo, hi, n) in axes.items():
        out = out.withColumn(name, F.explode(doubles(np.linspace(lo, hi, n))))
    return out.withColumns({k: F.lit(float(v)) for k, v in (fixed or {}).items()}) if fixed else out


# The two response grids, with the features that stay constant.
GRID_U_DT = {"axes": {"U": (0.0, 30.0, 201), "tair": (0.0, 20.0, 101)}, "fixed": {"tsea": 10.0, "rh": 80.0, "p": 101000.0, "zu": 10.0, "zt": 5.0}}
GRID_U_RH = {"axes": {"U": (0.0, 30.0, 201), "rh": (50.0, 110.0, 101)}, "fixed": {"tsea": 15.0, "tair": 15.0, "p": 101000.0, "zu": 10.0, "zt": 5.0}}
