"""Comparing model cases and ensembles by day, month and year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from halocline.functions.clock import floor_time
from halocline.operators.metrics import SPLITS_4


def join_on_time(a: DataFrame, b: DataFrame, time: str = "datetime") -> DataFrame:
    return a.join(b, time, "inner")


def case_delta(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Differences a - b on common keys; keys found in one case only drop out."""
    left = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in cols])
    right = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols])
    return left.join(right, keys).select(*keys, *[(F.col(f"_a_{c}") - F.col(f"_b_{c}")).alias(c) for c in cols])


# Cruises with their codes and the months with wave data.
CRUISES = [
    ("metz", 77, [
        "199301", "199302", "199303", "199304", "199305", "199306", "199307", "199308", "199309", "199612", "199801", "199905",
        "199906", "199907", "199908", "199909", "199910", "199911", "199912"]),
    ("calwater", 67, ["201501", "201502"]),
    ("hiwings", 72, ["201309", "201310", "201311"]),
    ("capricorn", 73, ["201603", "201604"]),
    ("dynamo", 68, ["201109", "201110", "201111", "201112"]),
    ("stratus", 83, ["200110", "200412", "200510", "200610", "200710", "200711", "200810", "200811", "200812", "201001"]),
    ("epic", 69, [
        "199911", "199912", "200004", "200005", "200006", "200007", "200008", "200009", "200010", "200011", "200103", "200104",
        "200105", "200106", "200107", "200108", "200109", "200110", "200111", "200112", "200203", "200204", "200205", "200206",
        "200207", "200208", "200209", "200210", "200211", "200311", "200410", "200411"]),
    ("whots", 87, ["200907", "201107", "201206", "201307", "201407", "201507"]),
    ("neaqs", 78, ["200407", "200408"]),
    ("gasex", 71, ["200803", "200804"]),
]


def cruise_table(spark) -> DataFrame:
    region = {code: name for name, codes in SPLITS_4.items() for code in codes}
    rows = [(code, name, region[code], months) for name, code, months in CRUISES]
    return spark.createDataFrame(rows, "pcode int, name string, region string, months array<string>")


def with_cruise(df: DataFrame, code: str = "pcode", months: bool = False) -> DataFrame:
    """Add name and region of the cruise; the lookup has ten rows."""
    look = cruise_table(df.sparkSession).withColumnRenamed("pcode", code)
    return df.join(F.broadcast(look if months else look.drop("months")), code, "left")


def load_cases(spark, path: str, combos: list[dict]) -> DataFrame:
    """Read a case table laid out by its partition columns, only the wanted combinations.

    Each combination names some partition columns, so whole folders are pruned.
    """
    conds = [reduce(lambda x, y: x & y, [F.col(k) == v for k, v in c.items()]) for c in combos]
    return spark.read.parquet(path).filter(reduce(lambda x, y: x | y, conds))


def monthly(df: DataFrame, by: list[str], cols: list[str], time: str = "ts") -> DataFrame:
    return df.groupBy(*by, F.year(time).alias("year"), F.month(time).alias("month")).agg(*[F.avg(c).alias(c) for c in cols])


def ensemble_stats(df: DataFrame, cols: list[str], by: list[str] = ("ts",)) -> DataFrame:
    """Mean and population std across members at each time."""
    out = []
    for c in cols:
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*out)


def member_daily(df: DataFrame, cols: list[str], member: str = "ensem", time: str = "ts", freq: str = "day",
                 by: list[str] = ()) -> DataFrame:
    """Mean per member and day, for members whose times do not coincide."""
    return df.groupBy(*by, member, floor_time(time, freq).alias("day")).agg(*[F.avg(c).alias(c) for c in cols])


def stoch_metrics(ens: DataFrame, determ: DataFrame, by: list[str] = (), time: str = "ts") -> DataFrame:
    """Monthly drift (ensemble mean minus single run) and spread of mld and sst.

    Depths are compared by absolute value.
    """
    keys = [*by, "year", "month"]
    e = ensemble_stats(ens, ["mld", "sst"], [*by, time])
    e = monthly(e, list(by), ["mld_mean", "mld_std", "sst_mean", "sst_std"], time)
    d = monthly(determ, list(by), ["mld", "sst"], time)
    return e.join(d, keys).select(
        *keys, (F.abs("mld_mean") - F.abs("mld")).alias("mld_diff"), F.col("mld_std"),
        (F.col("sst_mean") - F.col("sst")).alias("sst_diff"), F.col("sst_std"))


def _matches(combo: dict) -> Column:
    return reduce(lambda x, y: x & y, [F.col(k) == v for k, v in combo.items()])


def case_distance(df: DataFrame, combo: dict, ref: dict, time: str = "ts") -> DataFrame:
    """Monthly distance of a case from a reference case: |mld|, sst and q.

    Both cases come out of the same scan and the same aggregate.
    """
    if ref.get("flux") != "Bulk":
        raise ValueError("the reference case must use the bulk formula")
    a, b = _matches(combo), _matches(ref)
    cols = ["mld", "sst", "q"]
    agg = [F.avg(F.when(cond, F.col(c))).alias(f"{tag}{c}") for tag, cond in (("a", a), ("b", b)) for c in cols]
    m = df.filter(a | b).groupBy(F.year(time).alias("year"), F.month(time).alias("month")).agg(*agg)
    m = m.filter(F.col("asst").isNotNull() & F.col("bsst").isNotNull())
    return m.select("year", "month", (F.abs("amld") - F.abs("bmld")).alias("mld_diff"),
                    (F.col("asst") - F.col("bsst")).alias("sst_diff"), (F.col("aq") - F.col("bq")).alias("q_diff"))


def case_distances(df: DataFrame, by: list[str], flux: str = "flux", ref: str = "Bulk", time: str = "ts") -> DataFrame:
    """The same for every combination of `by`: each flux minus the bulk flux of that combination."""
    m = monthly(df, [*by, flux], ["mld", "sst", "q"], time)
    keys = [*by, "year", "month"]
    base = m.filter(F.col(flux) == ref).drop(flux)
    base = base.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("mld", "sst", "q")])
    return m.filter(F.col(flux) != ref).join(base, keys).select(
        flux, *keys, (F.abs("mld") - F.abs("_mld")).alias("mld_diff"), (F.col("sst") - F.col("_sst")).alias("sst_diff"),
        (F.col("q") - F.col("_q")).alias("q_diff"))


def year_mean(dist: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Month matrix of the mean over years, one row per combination."""
    return dist.groupBy(*by).pivot("month", list(range(1, 13))).agg(F.avg(col)).select(
        *by, *[F.col(f"`{m}`").alias(f"m{m:02d}") for m in range(1, 13)])


def sign_agree(dist: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    """1 where the sign of the difference is the same in all years of a month."""
    s = F.signum(col)
    return dist.groupBy(*by, "month").agg(F.when(F.min(s) == F.max(s), 1).otherwise(0).alias("agree"))


def check_forcing(written: DataFrame, echoed: DataFrame, cols: dict[str, str], time: str = "ts") -> DataFrame:
    """Largest absolute difference between the flux written and the flux the model reports, per month."""
    e = echoed.select(time, *[F.col(b).alias(f"_{b}") for b in cols.values()])
    j = written.join(e, time)
    diffs = {a: F.abs(F.col(a) - F.col(f"_{b}")) for a, b in cols.items()}
    return j.groupBy(F.year(time).alias("year"), F.month(time).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), *[F.max(d).alias(f"{a}_max") for a, d in diffs.items()],
        *[(F.avg(a) - F.avg(f"_{b}")).alias(f"{a}_diff") for a, b in cols.items()])
