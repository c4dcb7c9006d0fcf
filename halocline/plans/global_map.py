"""Ocean field on the atmosphere grid, bulk and predicted fluxes, and their difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from halocline.operators.bulk import apply_bulk
from halocline.operators.interpolation import regrid
from halocline.operators.network import FluxModel, ann_flux
from halocline.operators.quality import clip_or_default, wet_only, wind_parts


def global_map(ocean: DataFrame, atmosphere: DataFrame, models: dict[str, FluxModel], algo: str = "bulk36", height: float = 10.0) -> DataFrame:
    """Per wet cell: bulk and predicted heat flux and stress, and predicted minus bulk heat flux.

    `ocean` has (lat, lon, sst), `atmosphere` has (lat, lon, ux, uy, Ta, q, p).
    """
    cells = wet_only(regrid(ocean, atmosphere, ["sst"])).withColumn("p", clip_or_default("p", 80000, 110000, 101000))
    z = F.lit(float(height))
    both = ann_flux(cells.withColumnRenamed("sst", "To"), models["SH"], models["LH"], models["M"])
    both = wind_parts(both.withColumns({"tsea": F.col("To"), "tair": F.col("Ta"), "qair": F.col("q"), "zu": z, "zt": z, "zq": z}))
    out = apply_bulk(both, algo)
    return out.select(*[c for c in atmosphere.columns if c in ("point_id", "lat", "lon")], "Qs", "Ql", "taux", "tauy", "hsb", "hlb",
                      (F.col("Qs") + F.col("Ql") - F.col("hsb") - F.col("hlb")).alias("dq"))
