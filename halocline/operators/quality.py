"""Row filters, ranges, masks and small column rewrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from halocline.functions.clock import ntz
from halocline.schema import finite, require_columns


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows where any of the columns is missing (NULL or NaN)."""
    require_columns(df, cols)
    return df.dropna("any", subset=cols)


def harmonise(df: DataFrame, spec: dict[str, dict | str], require: list[str] = ()) -> DataFrame:
    """Rename, scale, flip and keep columns as one projection.

    `spec` maps a canonical name to a source column or to
    `{"from": column or Column, "scale": factor, "sign": +1/-1, "add": offset}`.
    `require` lists source columns that must be present for a row to be kept.
    """
    rows = complete_cases(df, list(require)) if require else df
    out = []
    for name, s in spec.items():
        s = {"from": s} if isinstance(s, (str, Column)) else s
        col = s["from"] if isinstance(s["from"], Column) else F.col(s["from"])
        factor = s.get("scale", 1.0) * s.get("sign", 1)
        if factor != 1.0:
            col = col * F.lit(float(factor))
        if s.get("add"):
            col = col + F.lit(float(s["add"]))
        out.append(col.alias(name))
    return rows.select(*out)


def qc_ok(df: DataFrame, flag: str = "qc") -> DataFrame:
    return df.filter(F.col(flag) == 0)


def cov_to_flux(df: DataFrame, uw: str = "uw", vw: str = "vw", wt: str = "wt", cpa: str = "cpa", rho: str = "rhoair") -> DataFrame:
    """Covariances to stress and sensible heat flux."""
    return (df.withColumn("hsc", -F.col(wt) * F.col(cpa) * F.col(rho))
            .withColumn("taucx", -F.col(uw) * F.col(rho)).withColumn("taucy", -F.col(vw) * F.col(rho)))


def const_like(col: str, value: float) -> Column:
    """A constant that is missing where the column is missing or zero."""
    return F.when(F.col(col).isNotNull() & (F.col(col) != 0), F.lit(float(value)))


def wind_parts(df: DataFrame, ux: str = "ux", uy: str = "uy", eps: float | None = None) -> DataFrame:
    """Add speed `U` and direction cosines. Calm rows get NULL cosines, or 0 with `eps`."""
    speed = F.hypot(F.col(ux), F.col(uy))
    safe = F.when(speed == 0, F.lit(eps)).otherwise(speed) if eps else speed
    return df.withColumns({"U": speed, "cos": F.try_divide(F.col(ux), safe), "sin": F.try_divide(F.col(uy), safe)})


def rotate_stress(df: DataFrame, tau: str, std: str | None = None, prefix: str = "tau") -> DataFrame:
    """Along-wind stress to x and y by the direction cosines; the std uses absolute values."""
    cols = {f"{prefix}x": F.col(tau) * F.col("cos"), f"{prefix}y": F.col(tau) * F.col("sin")}
    if std:
        cols |= {f"{prefix}x_std": F.abs(F.col(std) * F.col("cos")), f"{prefix}y_std": F.abs(F.col(std) * F.col("sin"))}
    return df.withColumns(cols)


# Valid input ranges of the bulk algorithms (K, kg/kg, m/s, Pa, W/m2).
VALID_RANGES = {
    "sst": (270.0, 320.0), "t_zt": (180.0, 330.0), "hum_zt": (0.0, 0.08), "u_zu": (-50.0, 50.0),
    "v_zu": (-50.0, 50.0), "slp": (80000.0, 110000.0), "rad_sw": (0.0, 1500.0), "rad_lw": (0.0, 750.0),
}


def in_range(df: DataFrame, ranges: dict[str, tuple[float, float]], mode: str = "drop") -> DataFrame:
    """Keep only rows in range (`drop`), blank values out of range (`null`), or add `<c>_bad` (`flag`)."""
    require_columns(df, ranges)
    ok = {c: F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()}
    if mode == "drop":
        for cond in ok.values():
            df = df.filter(cond)
        return df
    if mode == "null":
        return df.withColumns({c: F.when(cond, F.col(c)) for c, cond in ok.items()})
    if mode == "flag":
        return df.withColumns({f"{c}_bad": F.coalesce(~cond, F.lit(True)).cast("int") for c, cond in ok.items()})
    raise ValueError(f"unknown mode {mode}")


def range_report(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Number of rows outside each range, in one aggregate."""
    flagged = in_range(df, ranges, "flag")
    return flagged.agg(*[F.sum(f"{c}_bad").alias(f"{c}_bad") for c in ranges])


def clip_or_default(col: str, lo: float, hi: float, default: float) -> Column:
    """The value strictly between the limits, else the default (also for missing)."""
    return F.when((F.col(col) > lo) & (F.col(col) < hi), F.col(col)).otherwise(F.lit(float(default)))


def plausible(df: DataFrame, p: str = "p", rh: str = "rh", required: list[str] = ("U", "tsea", "tair", "rh", "p")) -> DataFrame:
    """One row: mean pressure and humidity and whether they look like Pa and %."""
    require_columns(df, required)
    return df.agg(F.avg(p).alias("p_mean"), F.avg(rh).alias("rh_mean"),
                  F.avg(p).between(60000, 150000).cast("int").alias("p_ok"),
                  F.avg(rh).between(0, 120).cast("int").alias("rh_ok"))


def wet_only(df: DataFrame, sst: str = "sst") -> DataFrame:
    return df.filter(F.col(sst).isNotNull())


def apply_mask(df: DataFrame, mask: str, cols: list[str]) -> DataFrame:
    """Blank the columns where the mask is not 1."""
    return df.withColumns({c: F.when(F.col(mask) == 1, F.col(c)) for c in cols})


def grid_to_samples(df: DataFrame, cols: list[str], max_lat: float, lat: str = "lat") -> DataFrame:
    """Cells south of a latitude with all variables present, as samples."""
    return complete_cases(df.filter(F.col(lat) < max_lat), cols).select(*cols)


def norm_lon(df: DataFrame, lon: str = "lon") -> DataFrame:
    """Longitudes to (0, 360]; exactly 0 becomes 360. Rows are not sorted, sort at the sink."""
    return df.withColumn(lon, F.when(F.col(lon) > 0, F.col(lon)).otherwise(F.lit(360.0) + F.col(lon)))


def drop_outliers(df: DataFrame, value: Column, limit: float) -> DataFrame:
    return df.filter(F.abs(value) < limit)


def outlier_report(df: DataFrame, value: Column, limit: float) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("before"), F.count(F.when(F.abs(value) < limit, 1)).alias("after"))


def regime(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows strictly inside every interval; keys are column names or SQL expressions."""
    for e, (lo, hi) in bounds.items():
        df = df.filter((F.expr(e) > lo) & (F.expr(e) < hi))
    return df


def time_slice(df: DataFrame, first: str, last: str, time: str = "time") -> DataFrame:
    """Rows from the first day to the end of the last day."""
    t = F.col(time)
    return df.filter((t >= ntz(F.lit(first))) & (t < ntz(F.date_add(F.lit(last).cast("date"), 1))))


def in_year(df: DataFrame, year: int, time: str = "time") -> DataFrame:
    """A year filter written as a range, so that it reaches the scan."""
    t = F.col(time)
    return df.filter((t >= ntz(F.lit(f"{year}-01-01"))) & (t < ntz(F.lit(f"{year + 1}-01-01"))))


def in_month(df: DataFrame, month: int, time: str = "time") -> DataFrame:
    return df.filter(F.month(time) == month)


def by_group(df: DataFrame, codes: list[int], code: str = "pcode") -> DataFrame:
    return df.filter(F.col(code).isin(list(codes)))


def label_as(code: str, codes: list[int], inside: str, outside: str) -> Column:
    return F.when(F.col(code).isin(list(codes)), F.lit(inside)).otherwise(F.lit(outside))


def angle_cos(df: DataFrame, a: str, b: str, height: str, name: str = "cos_angle") -> DataFrame:
    """Cosine of the angle between two directions in degrees, and the height projected by it."""
    c = F.cos(F.radians(F.col(a) - F.col(b)))
    return df.withColumns({name: c, f"{height}_along": F.col(height) * c})


# Feature sets of the named choices.
FEATURE_SETS = {
    "U_To_Ta_q": ["U", "tsea", "tair", "qair"], "U_To_Ta_rh": ["U", "tsea", "tair", "rh"],
    "U_Tdiff_rh": ["U", "tair - tsea", "rh"],
}


def assemble(df: DataFrame, ikeys: list[str] | str, okeys: list[str], bkeys: list[str] = (), w: str | None = None) -> DataFrame:
    """Add array columns `x`, `y`, `bulk` and the weight `w`."""
    ikeys = FEATURE_SETS[ikeys] if isinstance(ikeys, str) else list(ikeys)

    def pack(names):
        return F.array(*[F.expr(n).cast("double") for n in names])

    cols = {"x": pack(ikeys), "y": pack(okeys), "w": F.col(w).cast("double") if w else F.lit(1.0)}
    if bkeys:
        cols["bulk"] = pack(bkeys)
    return df.withColumns(cols)


def residual_target(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Add `<y>_res` = measured minus bulk."""
    return df.withColumns({f"{y}_res": F.col(y) - F.col(b) for y, b in pairs.items()})


def step_weight(col: Column, threshold: float = 18.0, above: float = 100.0, below: float = 1.0) -> Column:
    return F.when(col > threshold, F.lit(above)).otherwise(F.lit(below))


def with_weight(df: DataFrame, weight: Callable[[Column], Column], col: str, name: str = "weight") -> DataFrame:
    return df.withColumn(name, weight(F.col(col)))


def far_mask(df: DataFrame, a: Column, b: Column, limit: float = 40.0) -> DataFrame:
    """Rows where two estimates disagree by more than a limit."""
    return df.filter(F.abs(a - b) > limit)


def fill_missing(df: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    """Fill existing columns; add those that do not exist yet."""
    have = set(df.columns)
    fill = F.lit(float(value))
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), fill) if c in have else fill for c in cols})


def update_where(df: DataFrame, cond: Column, col: str, value: Column) -> DataFrame:
    return df.withColumn(col, F.when(cond, value).otherwise(F.col(col)))


def region_box(df: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    return df.filter(F.col("lon").between(*lon) & F.col("lat").between(*lat))


def ustar(df: DataFrame, tx: str, ty: str, rho: Column | float = 1.2) -> DataFrame:
    """Friction velocity from the two stresses, and the cross/along ratio."""
    rho = rho if isinstance(rho, Column) else F.lit(float(rho))
    return df.withColumns({"ustar": F.sqrt(F.hypot(F.col(tx), F.col(ty)) / rho),
                           "cross_ratio": F.try_divide(F.col(ty), F.col(tx))})


def speed(u: str, v: str) -> Column:
    return F.hypot(F.col(u), F.col(v))


def cols_like(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose whole name matches a regular expression."""
    return df.select(df.colRegex(f"`{pattern}`"))
