"""Flux-shaped views over the driver tables, as SQL both engines run.

Every view covers its whole table.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_U = "(2.5E1*value/(value+5.0E1))"
_TSEA = "(1.0E1 + (event_id % 200)/1.0E1)"
_TAIR = "(7.0E0 + (event_id % 200)/1.0E1 + (user_id % 60)/1.0E1)"
_RH = "(6.0E1 + (event_id % 401)/1.0E1)"
_P = "(1.0E5 + (event_id % 30)*1.0E2)"
_HSB = f"(-1.2E0*{_U}*({_TSEA}-{_TAIR}))"
_HLB = f"(-3.0E-1*{_U}*(1.1E2-{_RH}))"

# Point observations. U is missing now and then; codes are the ten cruise codes.
OBS = f"""
SELECT event_id, ts AS time,
  CAST(CASE user_id % 10 WHEN 0 THEN 67 WHEN 1 THEN 68 WHEN 2 THEN 69 WHEN 3 THEN 77 WHEN 4 THEN 71
       WHEN 5 THEN 72 WHEN 6 THEN 73 WHEN 7 THEN 78 WHEN 8 THEN 83 ELSE 87 END AS INT) AS pcode,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE {_U} END AS U,
  {_TSEA} AS tsea, {_TAIR} AS tair, {_RH} AS rh, {_P} AS p,
  6.22E-1*({_RH}/1.0E2*6.1121E0*exp(1.7502E1*{_TAIR}/(2.4097E2+{_TAIR})))/({_P}/1.0E2
     - 3.78E-1*({_RH}/1.0E2*6.1121E0*exp(1.7502E1*{_TAIR}/(2.4097E2+{_TAIR})))) AS qair,
  1.5E1 + event_id % 4 AS zu, 1.4E1 + event_id % 3 AS zt, 1.4E1 + event_id % 3 AS zq,
  -6.0E1 + user_id % 120 AS lat, -1.8E2 + (user_id*7) % 360 AS lon, 0E0 + (event_id*37) % 360 AS wdir,
  (1.0E0 + event_id % 5)/3.0E0 AS weight,
  CAST(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS INT) AS qc,
  1.5E-3*{_U}*{_U} AS taubx, 0E0 AS tauby, {_HSB} AS hsb, {_HLB} AS hlb,
  1.5E-3*{_U}*{_U} + ((event_id*7919) % 1001 - 500)/5.0E3 AS taucx,
  ((event_id*6113) % 1001 - 500)/1.0E4 AS taucy,
  {_HSB} + ((event_id*3571) % 1001 - 500)/5.0E1 AS hsc,
  {_HLB} + ((event_id*2917) % 1001 - 500)/2.0E1 AS hlc,
  1.45E-3*{_U}*{_U} + ((event_id*104729) % 1001 - 500)/1.0E4 AS pred_mean,
  (5.0E-2 + 2.0E-3*{_U})*(5.0E-2 + 2.0E-3*{_U}) AS pred_var
FROM {{events}}"""

# One profile of 20 levels, -100 m to -5 m, per event.
_PROF = """
SELECT e.event_id AS pid, e.ts AS ts, CAST(k AS INT) AS lev, -1.0E2 + 5.0E0*k AS z,
  4.0E0 + (e.event_id % 90)/1.0E1 + 6.0E0*k*k/3.61E2 AS temp,
  3.4E1 - k/2.0E1 - (e.event_id % 7)/1.0E2 AS salt,
  CAST((e.event_id % 40)/1.0E1 AS INT) AS ensem, e.value AS q
FROM {events} e """
PROF_SPARK = _PROF + "LATERAL VIEW explode(sequence(0,19)) v AS k"
PROF_DUCK = _PROF.replace("CAST((e.event_id % 40)/1.0E1 AS INT)", "CAST(floor((e.event_id % 40)/1.0E1) AS INT)") \
    + "CROSS JOIN range(20) v(k)"

# Model cases over several years, one row per order.
CASES = """
SELECT o_orderkey AS row_id, o_orderdate AS ts, CAST(o_orderkey % 5 AS INT) AS ensem,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Bulk' ELSE 'ANN' END AS flux,
  CASE WHEN o_custkey % 2 = 0 THEN 'kepsilon' ELSE 'kpp' END AS method,
  CAST(CASE WHEN o_custkey % 3 = 0 THEN 10 ELSE 60 END AS INT) AS dt,
  -1.0E1 - o_totalprice/9.7E3 AS mld, 4.0E0 + o_totalprice/4.9E4 AS sst,
  (o_orderkey % 401) - 2.0E2 AS q
FROM {orders}"""

# Gridded field: 6-hourly mean of the event values, spread over 25 latitudes and 36 longitudes.
_GRID = """
SELECT h.ts AS ts, -6.0E1 + 5.0E0*i AS lat, 1.0E1*j AS lon,
  h.v + (-6.0E1 + 5.0E0*i)/1.0E2 + j/4.0E1 AS phs0,
  2.0E0*h.v - (-6.0E1 + 5.0E0*i)/5.0E1 + i*j/1.0E2 AS plp0,
  CASE WHEN (i + j) % 10 = 0 THEN NULL ELSE 1.0E1 + h.v/1.0E1 + i/5.0E0 END AS sst,
  CAST(CASE WHEN (i + j) % 10 = 0 THEN 0 ELSE 1 END AS INT) AS wet
FROM (SELECT {slot} AS ts, avg(value) AS v FROM {events} GROUP BY {slot}) h """
_SLOT_DUCK = "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01 00:00:00')"
_SLOT_SPARK = ("(TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 6 * CAST(floor("
               "timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 6) AS INT)))")
GRID_SPARK = _GRID.replace("{slot}", _SLOT_SPARK) \
    + "LATERAL VIEW explode(sequence(0,24)) a AS i LATERAL VIEW explode(sequence(0,35)) b AS j"
GRID_DUCK = _GRID.replace("{slot}", _SLOT_DUCK) + "CROSS JOIN range(25) a(i) CROSS JOIN range(36) b(j)"

# Scattered positions on which a grid is wanted, one per customer.
POINTS = """
SELECT c_custkey AS point_id, -6.2E1 + (c_custkey*13 % 1240)/1.0E1 AS lat,
  (c_custkey*7 % 3600)/1.0E1 AS lon, c_acctbal/1.0E3 AS air
FROM {customer}"""

# Station state: hourly means of the observations.
_STATION = """
SELECT {slot} AS time, avg(tsea) AS sst, avg(U*cos(radians(wdir))) AS ux, avg(U*sin(radians(wdir))) AS uy,
  avg(tair) AS t, avg(p) AS p, avg(qair) AS q, avg(taubx) AS taux, avg(taucy) AS tauy,
  avg(hsb + hlb) AS heat, 1.0E2 + avg(U) AS swr, -5.0E1 + avg(U) AS lwr, avg(taucx) AS x
FROM ({obs_sql}) o GROUP BY {slot}"""
STATION_SPARK = _STATION.replace("{slot}", "CAST(date_trunc('hour', time) AS TIMESTAMP_NTZ)").replace("{obs_sql}", OBS)
STATION_DUCK = _STATION.replace("{slot}", "date_trunc('hour', time)").replace("{obs_sql}", OBS)

CRUISE_ROWS = [(77, "metz", "Metz"), (67, "calwater", "N. Pac./Atl."), (72, "hiwings", "N. Pac./Atl."),
               (78, "neaqs", "N. Pac./Atl."), (73, "capricorn", "Southern Ocean"), (71, "gasex", "Southern Ocean"),
               (68, "dynamo", "Tropics"), (83, "stratus", "Tropics"), (69, "epic", "Tropics"), (87, "whots", "Tropics")]
CRUISE_DUCK = "SELECT * FROM (VALUES " + ", ".join(
    f"({c}, '{n}', '{r}')" for c, n, r in CRUISE_ROWS) + ") AS v(pcode, name, region)"

_SPARK = {"obs": OBS, "prof": PROF_SPARK, "cases": CASES, "grid": GRID_SPARK, "points": POINTS,
          "station": STATION_SPARK}
_DUCK = {"obs": OBS, "prof": PROF_DUCK, "cases": CASES, "grid": GRID_DUCK, "points": POINTS,
         "station": STATION_DUCK, "cruise": CRUISE_DUCK}


def _wide(sf_dir: str, table: str) -> str:
    path = os.path.join(sf_dir, f"{table}.parquet")
    return path if "://" in sf_dir or glob.glob(path) else os.path.join(sf_dir, table)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(_wide(sf_dir, name))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _SPARK[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def using(*names: str, extra: str = "") -> str:
    """`WITH` clause that gives an oracle the same views."""
    parts = [f"{n} AS ({_DUCK[n].format(**{t: t for t in TABLES})})" for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"
