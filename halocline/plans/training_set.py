"""Raw cruises to a weighted training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from halocline.operators.weights import importance_weights
from halocline.sources.sinks import write_training
from halocline.sources.tables import load_cruise

WEIGHT_ON = ["U", "tdiff", "rh"]


def station_target(station: DataFrame) -> DataFrame:
    """Station state in the variables the weights are fitted on."""
    return station.select(*[c for c in ("datetime",) if c in station.columns], "U", (F.col("sst") - F.col("t")).alias("tdiff"), "rh")


def build_training(raw: DataFrame, key: str, algo: str = "bulk36", target: DataFrame | None = None, path: str | None = None,
                   wave: int = 0, **kw) -> DataFrame:
    """Clean, append bulk fluxes, weight toward a target climate if one is given, save if a path is given."""
    obs = load_cruise(raw, algo, keep=[key]).withColumn("tdiff", F.col("tsea") - F.col("tair"))
    if target is None:
        obs = obs.withColumn("weight", F.lit(1.0))
    else:
        obs = importance_weights(obs, target, WEIGHT_ON, key, **kw)
    if path:
        write_training(obs, path, algo, 0 if target is None else 1, wave)
    return obs
