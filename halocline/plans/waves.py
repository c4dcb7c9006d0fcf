"""Wave fields along cruise tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from halocline.operators.cases import cruise_table
from halocline.operators.interpolation import interp_track
from halocline.operators.quality import fill_missing

FIRST_YEAR = 1993       # the wave reanalysis starts here
WAVE_VARIABLES = ["phs0", "plp0", "pdir0", "phs1", "plp1", "pdir1"]


def cruise_months(wave: DataFrame, time: str = "ts") -> DataFrame:
    """Wave rows in the months of any cruise (at most one row per cruise month is broadcast)."""
    months = cruise_table(wave.sparkSession).select(F.explode("months").alias("_m")).distinct()
    return (wave.withColumn("_m", F.date_format(F.col(time), "yyyyMM"))
            .join(F.broadcast(months), "_m", "left_semi").drop("_m"))


def _months_of_cruises(cruises: DataFrame, cruise: str):
    """Field times (axis, value) with the code of every cruise whose months they are in."""
    months = cruises.select(F.col("pcode").alias(cruise), F.explode("months").alias("_m")).distinct()

    def of(times: DataFrame) -> DataFrame:
        month = F.date_format(F.timestamp_micros(F.col("value").cast("bigint")), "yyyyMM")
        return times.withColumn("_m", month).join(F.broadcast(months), "_m").drop("_m")  # a few rows a cruise

    return of


def add_waves(obs: DataFrame, wave: DataFrame, cols: list[str], time: str = "time", grid_time: str = "ts",
              only_cruise_months: bool = False, first_year: int | None = FIRST_YEAR, cruise: str | None = None, cruises: DataFrame | None = None) -> DataFrame:
    """Observations from `first_year` on (None: all) with wave columns interpolated in time and space; 0 where there is no wave value.

    With `cruise`, the column of the cruise code, each row is interpolated between field times of its own cruise's months
    only, and has 0 outside of them or without a known cruise. `cruises` (pcode, months) defaults to the cruise table.
    """
    rows = obs if first_year is None else obs.filter(F.col(time) >= F.lit(f"{first_year}-01-01").cast("timestamp_ntz"))
    field = fill_missing(cruise_months(wave, grid_time) if only_cruise_months else wave, cols)
    if cruise is None:
        return fill_missing(interp_track(rows, field, cols, time, grid_time), cols)
    known = cruise_table(obs.sparkSession) if cruises is None else cruises
    return fill_missing(interp_track(rows, field, cols, time, grid_time, by=[cruise], times=_months_of_cruises(known, cruise)), cols)
