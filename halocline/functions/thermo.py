"""Moist-air, sea-water and surface-layer formulas as pure Column functions.

Temperatures in degC, pressures in mb (hPa) unless named `_pa`, humidity in % or as stated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed values (published coefficients).
BUCK_WATER = (6.1121, 17.502, 240.97, 1.0007, 3.46e-6)     # Buck 1981, over water
BUCK_ICE = (6.1115, 22.452, 272.55, 1.0003, 4.18e-6)       # Buck 1981, over ice
SEA_FACTOR = 0.98                                          # vapour pressure over sea water
MOL_DRY, MOL_VAPOUR, GAS = 0.028964, 0.018016, 8.314       # kg/mol, kg/mol, J/mol/K
GAS_DRY = 287.058                                          # J/kg/K
GRAVITY = (9.7803267715, 0.0052790414, 0.0000232718, 0.0000001262, 0.0000000007)
LATENT = (2.5008991412e6, -2.3691806479e3, 2.6776439436e-1, -8.1027544602e-3, -2.0799346624e-5)
FREEZING = (-0.0575, 0.00171052, -0.0002154996)


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def _buck(t: Column, p: Column, k: tuple) -> Column:
    return k[0] * F.exp(ratio(k[1] * t, k[2] + t)) * (k[3] + k[4] * p)


def ratio(a, b) -> Column:
    """Division that gives NULL, not an error, where the divisor is zero."""
    return F.try_divide(_c(a), _c(b))


def _polynomial(x: Column, coefs) -> Column:
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + c
    return out


def qsat(t, p_mb) -> Column:
    """Saturation vapour pressure, mb."""
    return _buck(_c(t), _c(p_mb), BUCK_WATER)


def qsea(sst, p_mb) -> Column:
    """Saturation specific humidity at the sea surface, g/kg."""
    e = SEA_FACTOR * qsat(sst, p_mb)
    return ratio(622.0 * e, _c(p_mb) - 0.378 * e)


def vapour_pressure(q, p_mb) -> Column:
    return ratio(_c(p_mb) * _c(q), 0.622 + 0.378 * _c(q))


def rhcalc(t, p_mb, q) -> Column:
    """Relative humidity in % from specific humidity in kg/kg."""
    return ratio(100.0 * vapour_pressure(q, p_mb), qsat(t, p_mb))


def qair(t, p_mb, rh) -> Column:
    """Struct (q g/kg, e mb) from relative humidity."""
    e = _c(rh) / 100.0 * qsat(t, p_mb)
    return F.struct(ratio(621.97 * e, _c(p_mb) - 0.378 * e).alias("q"), e.alias("e"))


def rhoa(t, p_mb, rh) -> Column:
    """Moist-air density, kg/m3."""
    vapour = _c(rh) * qsat(t, p_mb)
    dry = 100.0 * _c(p_mb) - vapour
    return ratio(MOL_DRY * dry + MOL_VAPOUR * vapour, GAS * (_c(t) + 273.15))


def rhod(t, p_mb) -> Column:
    """Dry-air density, kg/m3."""
    return ratio(100.0 * _c(p_mb), GAS_DRY * (_c(t) + 273.15))


def grv(lat) -> Column:
    """Gravity at a latitude, m/s2."""
    s2 = F.sin(F.radians(_c(lat))) * F.sin(F.radians(_c(lat)))
    return GRAVITY[0] * _polynomial(s2, (1.0, *GRAVITY[1:]))


def le_water(t, sal) -> Column:
    """Struct of latent heats (pure, sea), kJ/kg."""
    pure = _polynomial(_c(t), LATENT) / 1000.0
    return F.struct(pure.alias("pure"), (pure * (1.0 - 0.001 * _c(sal))).alias("sea"))


def uv2spd_dir(u, v) -> Column:
    return F.struct(F.hypot(_c(u), _c(v)).alias("spd"), F.degrees(F.atan2(_c(v), _c(u))).alias("dir"))


def spd_dir2uv(spd, direction) -> Column:
    back = F.radians(_c(direction) + 180.0)
    return F.struct((-_c(spd) * F.cos(back)).alias("u"), (-_c(spd) * F.sin(back)).alias("v"))


# --- surface-layer stability -------------------------------------------------------------

_ROOT3 = math.sqrt(3.0)


def _free_convection(z: Column, slope: float) -> Column:
    y = F.pow(1.0 - slope * z, F.lit(0.3333))
    return (1.5 * F.log((1.0 + y + y * y) / 3.0) - _ROOT3 * F.atan((1.0 + 2.0 * y) / _ROOT3)
            + math.pi / _ROOT3)


def _blend(z: Column, near: Column, far: Column) -> Column:
    f = z * z / (1.0 + z * z)
    return (1.0 - f) * near + f * far


def _unstable_part(z: Column) -> Column:
    """The argument of the unstable branch, held at zero where the branch is not taken."""
    return F.least(z, F.lit(0.0))


def psit_26(zeta) -> Column:
    """Temperature stability function of z/L."""
    z = _c(zeta)
    s = F.greatest(z, F.lit(0.0))
    stable = -(F.pow(1.0 + 0.6667 * s, F.lit(1.5)) + 0.6667 * (s - 14.28) * F.exp(-F.least(F.lit(50.0), 0.35 * s)) + 8.525)
    n = _unstable_part(z)
    near = 2.0 * F.log((1.0 + F.sqrt(1.0 - 15.0 * n)) / 2.0)
    return F.when(z < 0, _blend(n, near, _free_convection(n, 34.15))).when(z >= 0, stable)


def _psiu(zeta, a: float, near_slope: float, far_slope: float) -> Column:
    z = _c(zeta)
    b, c, d = 0.75, 5.0, 0.35
    s = F.greatest(z, F.lit(0.0))
    stable = -(a * s + b * (s - c / d) * F.exp(-F.least(F.lit(50.0), d * s)) + b * c / d)
    n = _unstable_part(z)
    x = F.pow(1.0 - near_slope * n, F.lit(0.25))
    near = 2.0 * F.log((1.0 + x) / 2.0) + F.log((1.0 + x * x) / 2.0) - 2.0 * F.atan(x) + math.pi / 2.0
    return F.when(z < 0, _blend(n, near, _free_convection(n, far_slope))).when(z >= 0, stable)


def psiu_26(zeta) -> Column:
    """Velocity stability function of z/L."""
    return _psiu(zeta, 0.7, 15.0, 10.15)


def psiu_40(zeta) -> Column:
    return _psiu(zeta, 1.0, 18.0, 10.0)


# --- saturation with ice and salt ----------------------------------------------------------

def freeze_pt(ss) -> Column:
    """Freezing point of sea water of a salinity, degC."""
    s = _c(ss)
    return FREEZING[0] * s + FREEZING[1] * F.pow(s, F.lit(1.5)) + FREEZING[2] * s * s


def bucksat(t, p_mb, tf) -> Column:
    """Saturation vapour pressure, over ice below the freezing point `tf`."""
    t, p = _c(t), _c(p_mb)
    return F.when(t < _c(tf), _buck(t, p, BUCK_ICE)).otherwise(_buck(t, p, BUCK_WATER))


def qsat26sea(t, p_mb, ss, tf) -> Column:
    """Specific humidity at the surface of water of a salinity, g/kg."""
    e = (1.0 - 0.02 * _c(ss) / 35.0) * bucksat(t, p_mb, tf)
    return ratio(622.0 * e, _c(p_mb) - 0.378 * e)


def qsat26air(t, p_mb, rh) -> Column:
    """Struct (q g/kg, e mb) of air; relative humidity is over ice below 0 degC."""
    e = 0.01 * _c(rh) * bucksat(t, p_mb, 0.0)
    return F.struct(ratio(622.0 * e, _c(p_mb) - 0.378 * e).alias("q"), e.alias("e"))


def rh26(t, p_mb, q, tf) -> Column:
    return ratio(100.0 * vapour_pressure(q, p_mb), bucksat(t, p_mb, tf))


# --- other closed forms --------------------------------------------------------------------

# One-atmosphere equation of state of sea water (UNESCO 1980).
RHO_PURE = (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
RHO_S = (8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9)
RHO_S32 = (-5.72466e-3, 1.0227e-4, -1.6546e-6)
RHO_S2 = 4.8314e-4


def rho0(salt, temp) -> Column:
    """Density of sea water at surface pressure, kg/m3."""
    s, t = _c(salt), _c(temp)
    return (_polynomial(t, RHO_PURE) + _polynomial(t, RHO_S) * s
            + _polynomial(t, RHO_S32) * F.pow(s, F.lit(1.5)) + RHO_S2 * s * s)


def log_ratio(z0, z1, z2) -> Column:
    """Ratio of logarithmic wind profiles at two heights above roughness `z0`."""
    return ratio(F.log(ratio(z1, z0)), F.log(ratio(z2, z0)))


def normal_pdf(x, mu, sd) -> Column:
    d = ratio(_c(x) - _c(mu), sd)
    return ratio(F.exp(-0.5 * d * d), _c(sd) * math.sqrt(2.0 * math.pi))


def with_rh(df, t: str = "tair", p_pa: str | None = "p", q: str = "qair", constant_mb: float = 1010.0):
    """Add `rh`; without a pressure column a constant pressure is used."""
    p = F.col(p_pa) / 100.0 if p_pa else F.lit(constant_mb)
    return df.withColumn("rh", rhcalc(t, p, q))


# --- sun and albedo --------------------------------------------------------------------------

SOLAR = 1380.0


def sun(sw, yday, lon, lat) -> Column:
    """Struct (altitude deg, solar_max W/m2, transmission); zeros while the sun is down."""
    sw, d, la = _c(sw), _c(yday), F.radians(_c(lat))
    hour = math.pi * 2.0 * (d - F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d))) + F.radians(_c(lon))
    decl = F.radians(23.45 * F.cos(2.0 * math.pi * (d - 173.0) / 365.25))
    s = F.sin(la) * F.sin(decl) - F.cos(la) * F.cos(decl) * F.cos(hour)
    up = s >= 0
    trans = F.least(F.lit(2.0), F.try_divide(sw, SOLAR * s))
    return F.struct(F.when(up, F.degrees(F.asin(s))).otherwise(F.lit(0.0)).alias("altitude"),
                    F.when(up, SOLAR * s).otherwise(F.lit(0.0)).alias("solar_max"),
                    F.when(up, trans).otherwise(F.lit(0.0)).alias("transmission"), up.alias("up"))


def albedo_rule(transmission: float, altitude: float) -> float:
    """Sea-surface albedo by a published direct-beam fit (Briegleb et al. 1986) mixed with a
    diffuse albedo of 0.06 as the sky gets cloudier."""
    mu = math.sin(math.radians(altitude))
    direct = 0.026 / (mu**1.7 + 0.065) + 0.15 * (mu - 0.1) * (mu - 0.5) * (mu - 1.0)
    clear = min(max(transmission, 0.0), 1.0)
    return round(clear * direct + (1.0 - clear) * 0.06, 3)


def albedo_table(spark, rule=albedo_rule):
    """The 21 x 46 table (transmission by 0.05, altitude by 2 deg) from a rule or a fit."""
    rows = [(i, j, float(rule(0.05 * i, 2.0 * j))) for i in range(21) for j in range(46)]
    return spark.createDataFrame(rows, "ti int, aj int, albedo double")


def with_albedo(df, sw: str, yday: str, lon: str, lat: str, table=None):
    """Add `albedo`, `transmission`, `solar_max`, `altitude` from the nearest table cell.

    The table has 966 rows by construction; a caller's own table must have that shape.
    """
    table = albedo_table(df.sparkSession) if table is None else table
    s = df.withColumn("_sun", sun(sw, yday, lon, lat))
    cell = s.withColumn("ti", F.least(F.lit(20), F.rint(F.col("_sun.transmission") / 0.05).cast("int"))) \
            .withColumn("aj", F.rint(F.col("_sun.altitude") / 2.0).cast("int"))
    out = cell.join(F.broadcast(table), ["ti", "aj"], "left")
    return out.select(*df.columns, F.when(F.col("_sun.up"), F.col("albedo")).otherwise(F.lit(0.0)).alias("albedo"),
                      F.col("_sun.transmission").alias("transmission"), F.col("_sun.solar_max").alias("solar_max"),
                      F.col("_sun.altitude").alias("altitude"))
