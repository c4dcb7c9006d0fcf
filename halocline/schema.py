"""Canonical columns, entry checks and the missing-value rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Canonical observation vocabulary: name -> unit. Heat fluxes are positive from air to ocean.
OBSERVATION_UNITS = {
    "time": "UTC", "pcode": "-", "U": "m/s", "tsea": "degC", "tair": "degC", "qair": "kg/kg",
    "rh": "%", "p": "Pa", "zu": "m", "zt": "m", "zq": "m", "lon": "deg", "lat": "deg", "wdir": "deg",
    "taucx": "N/m2", "taucy": "N/m2", "hsc": "W/m2", "hlc": "W/m2",
    "taubx": "N/m2", "tauby": "N/m2", "hsb": "W/m2", "hlb": "W/m2", "weight": "-",
}

# Profile columns. `temp`/`salt` instead of one-letter names: column names ignore case.
PROFILE_COLUMNS = ["ts", "z", "ux", "uy", "temp", "salt", "nn", "nu", "taux", "tauy", "Q", "swr"]

PA_PER_MB = 100.0
KELVIN = 273.15            # offset used when converting inputs
KELVIN_SOLVER = 273.16     # offset used inside the bulk solvers


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    have = {c.lower() for c in df.columns}
    missing = [c for c in cols if c.lower() not in have]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def finite(col: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(col), col)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
