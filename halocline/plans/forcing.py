"""Station state to forcing ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from halocline.operators.network import FluxModel, predict_fluxes
from halocline.operators.noise import flux_noise
from halocline.operators.quality import const_like, time_slice
from halocline.operators.series import resample_linear, resample_mean
from halocline.session import cut_lineage
from halocline.sources.sinks import write_forcing

STATE = ["sst", "ux", "uy", "t", "p", "q", "taux", "tauy", "heat", "swr", "lwr", "U", "rh", "cos", "sin"]
RENAMED = {"t": "tair", "sst": "tsea", "q": "qair"}


def prepared_state(station: DataFrame, first: str, last: str, dt_hours: int = 3, time: str = "datetime") -> DataFrame:
    """Hourly by interpolation, cut to the dates, averaged to the step, with 10 m heights."""
    hourly = resample_linear(station, time, STATE, "1 hour")
    coarse = resample_mean(time_slice(hourly, first, last, time), time, f"{dt_hours} hours", STATE)
    return coarse.withColumns({z: const_like("U", 10.0) for z in ("zu", "zt", "zq")}).withColumnsRenamed(RENAMED)


def build_forcing(station: DataFrame, models: dict[str, FluxModel], first: str, last: str, flux: str = "heat", corr_hours: float = 60.0,
                  dt_hours: int = 3, members: int = 10, seed: int = 0, path: str | None = None, time: str = "datetime") -> DataFrame:
    """Members of perturbed heat flux or stress, long: (ensem, time, values); written as text when a path is given."""
    # The coarse series feeds mean, noise and files, so it is computed once.
    state = cut_lineage(predict_fluxes(prepared_state(station, first, last, dt_hours, time), models["SH"], models["LH"], models["M"]))
    if flux == "heat":
        noise = flux_noise(state, "heat", corr_hours, dt_hours, members, seed, time)
        state = state.select(time, (F.col("qh_ann") + F.col("ql_ann") + F.col("lwr")).alias("heat_mean"), F.col("heat").alias("heat_bulk"))
        names = ["heat"]
    elif flux == "momentum":
        x = flux_noise(state, "taux", corr_hours, dt_hours, members, seed, time)
        y = flux_noise(state, "tauy", corr_hours, dt_hours, members, seed + 2, time)
        noise = x.join(y, ["ensem", time])
        state = state.select(time, F.col("taux_ann").alias("taux_mean"), F.col("tauy_ann").alias("tauy_mean"),
                             F.col("taux").alias("taux_bulk"), F.col("tauy").alias("tauy_bulk"))
        names = ["taux", "tauy"]
    else:
        raise ValueError(f"unknown flux {flux}")
    if path:
        noise = cut_lineage(noise)
        write_forcing(noise, state, path, [f"{n}_mean" for n in names], [f"eps_{n}" for n in names], [f"{n}_bulk" for n in names], time)
    both = noise.join(state, time)
    return both.select("ensem", time, *[(F.col(f"{n}_mean") + F.col(f"eps_{n}")).alias(n) for n in names])
