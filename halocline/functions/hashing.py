"""Random numbers from keyed hashes: the same on every run, layout and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

HEX_DIGITS = 13


def hash_hex(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform on [0, 1): the first 13 hex digits of md5('seed:key...') over 16^13."""
    head = F.conv(F.substring(hash_hex(seed, *keys), 1, HEX_DIGITS), 16, 10).cast("bigint")
    return head / F.lit(float(16**HEX_DIGITS))


def hash_normal(seed: int, *keys: Column) -> Column:
    """Standard normal by Box-Muller from two hash uniforms (seeds `seed` and `seed+1`)."""
    u1, u2 = hash_uniform(seed, *keys), hash_uniform(seed + 1, *keys)
    return F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * math.pi * u2)


def hash_rayleigh(seed: int, scale: float, *keys: Column) -> Column:
    return scale * F.sqrt(-2 * F.log(1 - hash_uniform(seed, *keys)))


def bucket_of(n: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
