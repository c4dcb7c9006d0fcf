"""Model output to comparison report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from halocline.operators.cases import case_distance
from halocline.operators.profiles import mixed_layer_depth


def daily_state(profiles: DataFrame, keys: list[str], criterion: str = "density") -> DataFrame:
    """Mixed-layer depth, surface temperature and heat flux of every profile, in one pass."""
    return mixed_layer_depth(profiles, keys, criterion, keep=["temp", "q"]).withColumnRenamed("temp", "sst")


def compare_profiles(profiles: DataFrame, combo: dict, ref: dict, keys: list[str], criterion: str = "density") -> DataFrame:
    """Monthly distances between two cases, straight from their profiles."""
    return case_distance(daily_state(profiles, keys, criterion), combo, ref)
