"""Loaders that turn source-specific tables into the canonical observation columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from halocline.functions.clock import floor_time
from halocline.operators.bulk import apply_bulk
from halocline.operators.quality import complete_cases, cov_to_flux, harmonise, qc_ok
from halocline.schema import nan_to_null

# Column names, units and signs of the sources.
CRUISE_REQUIRED = ["taucx", "taucy", "hsc", "hlc", "U", "tsnk", "ta", "qa"]
CRUISE_SPEC = {
    "time": "time", "pcode": "pcode", "U": "U", "tsea": "tsnk", "tair": "ta", "qair": {"from": "qa", "scale": 1e-3},
    "p": {"from": "dummy1", "scale": 100.0}, "rh": "dummy2", "wdir": "dir", "zu": "zu", "zt": "zt", "zq": "zq",
    "lon": "lon", "lat": "lat", "taucx": "taucx", "taucy": "taucy",
    "hsc": {"from": "hsc", "sign": -1}, "hlc": {"from": "hlc", "sign": -1},
}
CAMPAIGN_REQUIRED = ["tau_streamwise_cov", "tau_crossstream_cov", "tau_bulk", "hl_cov", "hs_cov", "wspd", "tsea", "tair", "qair"]
CAMPAIGN_SPEC = {
    "taucx": "tau_streamwise_cov", "taucy": "tau_crossstream_cov", "hsc": "hs_cov", "hlc": "hl_cov", "U": "wspd",
    "tsea": "tsea", "tair": "tair", "qair": {"from": "qair", "scale": 1e-3}, "rh": "rhair", "zu": "zu", "zt": "ztq", "zq": "ztq",
    "wdir": "wdir", "cspd": "cspd", "cdir": "cdir", "wave_height": "wave_height", "wave_period": "wave_period",
    "wave_flag": "wave_flag",
}
BUOY_SPEC = {
    "U": "Ue", "tair": "Tair", "tsea": "Tsea", "rh": "RH", "p": {"from": "Pair", "scale": 100.0}, "zq": "zq", "zt": "zt", "zu": "zu",
    "taucx": "taucx", "taucy": "taucy", "hsc": "hsc", "taubx": "stress", "hsb": {"from": "shf", "sign": -1},
    "hlb": {"from": "lhf", "sign": -1}, "yyyy": "yyyy", "yday": "yday",
}
STANDARD_PRESSURE = 101000.0


def load_cruise(df: DataFrame, algo: str | None = "bulk36", keep: list[str] = ()) -> DataFrame:
    """Ship cruises: complete rows, canonical names and units, bulk fluxes appended."""
    spec = CRUISE_SPEC | {k: k for k in keep}
    out = harmonise(nan_to_null(df), spec, CRUISE_REQUIRED)
    return apply_bulk(out, algo) if algo else out


def load_campaign(df: DataFrame, algo: str | None = None, keep: list[str] = ()) -> DataFrame:
    """Second campaign: other names, signs already right. Bulk fluxes use a standard pressure, which the source lacks."""
    spec = CAMPAIGN_SPEC | {k: k for k in keep}
    out = harmonise(nan_to_null(df), spec, CAMPAIGN_REQUIRED)
    if not algo:
        return out
    return apply_bulk(out.withColumn("p", F.lit(STANDARD_PRESSURE)), algo)


def load_buoy(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Buoy samples: good flag, covariances to fluxes, canonical names, complete rows."""
    rows = cov_to_flux(qc_ok(nan_to_null(df), "Sbytes"), "UW", "VW", "WT")
    out = harmonise(rows, BUOY_SPEC | {k: k for k in keep})
    return complete_cases(out, list(BUOY_SPEC))


def reference_length(arrays: list[str], prefer: str | None) -> Column:
    """Length of the preferred array if it is there, else the most frequent length (first seen wins)."""
    sizes = F.array(*[F.when(F.col(c).isNotNull(), F.size(c)) for c in arrays])
    known = F.filter(sizes, lambda s: s.isNotNull())
    ranked = F.transform(F.array_distinct(known), lambda s: F.struct(
        F.size(F.filter(known, lambda t: t == s)).alias("n"), (-F.array_position(known, s)).alias("pos"), s.alias("len")))
    modal = F.array_max(ranked)["len"]
    return F.coalesce(F.when(F.col(prefer).isNotNull(), F.size(prefer)), modal) if prefer else modal


def explode_aligned(df: DataFrame, prefer: str | None = None) -> DataFrame:
    """One row per file with arrays -> one row per element; arrays of another length become NULL."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    prefer = prefer if prefer in arrays else None
    scalars = [c for c in df.columns if c not in arrays]
    rows = df.withColumn("_len", reference_length(arrays, prefer))
    fit = []
    for c in arrays:
        gap = F.array_repeat(F.lit(None).cast(df.schema[c].dataType.elementType), F.col("_len"))
        fit.append(F.coalesce(F.when(F.size(c) == F.col("_len"), F.col(c)), gap).alias(c))
    zipped = rows.select(*scalars, F.arrays_zip(*fit).alias("_z"))
    return zipped.select(*scalars, F.posexplode("_z").alias("element", "_e")).select(
        *scalars, "element", *[F.col("_e")[c].alias(c) for c in arrays])


def leftovers(df: DataFrame, prefer: str | None = None) -> DataFrame:
    """The arrays that do not have the reference length, per file, in long form."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    scalars = [c for c in df.columns if c not in arrays]
    rows = df.withColumn("_len", reference_length(arrays, prefer if prefer in arrays else None))
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("array<double>").alias("v")) for c in arrays])
    return rows.select(*scalars, "_len", F.inline(pairs)).filter(F.size("v") != F.col("_len")).drop("_len")


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Stack results of several files or campaigns; columns missing in one are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def assemble_fields(fields: dict[str, DataFrame], fine: list[str] = (), freq: str = "month", time: str = "ts",
                    keys: list[str] = ("lat", "lon")) -> DataFrame:
    """One table from one table per variable, joined on time and cell.

    Variables in `fine` come at a finer step and are averaged to `freq` first.
    """
    frames = []
    for name, f in fields.items():
        if name in fine:
            f = f.groupBy(floor_time(time, freq).alias("_t"), *keys).agg(F.avg(name).alias(name))
            f = f.withColumnRenamed("_t", time)
        else:
            f = f.select(floor_time(time, freq).alias(time), *keys, name)
        frames.append(f)
    return reduce(lambda a, b: a.join(b, [time, *keys]), frames)
