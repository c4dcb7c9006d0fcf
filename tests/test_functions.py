"""Golden constants and edges of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from halocline.functions import clock as C, hashing as H, thermo as T


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


GOLDEN = {
    "qsat": (lambda: T.qsat(25, 1015), 31.80374, 1e-5), "qsea": (lambda: T.qsea(18, 1013), 12.56146, 1e-5),
    "qair": (lambda: T.qair(10, 1010, 77)["q"], 5.86622, 1e-5), "rhcalc": (lambda: T.rhcalc(14, 1013, 0.0097121), 97.99491, 1e-5),
    "grv": (lambda: T.grv(45), 9.80620, 1e-5), "psit_26": (lambda: T.psit_26(1), -4.43757, 1e-5),
    "psiu_26": (lambda: T.psiu_26(1), -4.39257, 1e-5), "psiu_26_far": (lambda: T.psiu_26(26), -28.91527, 1e-4),
    "psiu_40": (lambda: T.psiu_40(1), -4.69257, 1e-5),
    # check value of the 1980 equation of state: S = 35, t = 5 degC, p = 0
    "rho0": (lambda: T.rho0(35, 5), 1027.67547, 1e-4),
    "freeze": (lambda: T.freeze_pt(35), -1.922, 1e-3),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, name):
    make, want, tol = GOLDEN[name]
    assert value(spark, make()) == pytest.approx(want, abs=tol)


def test_stability_is_zero_at_neutral_and_null_safe(spark):
    df = spark.createDataFrame([(0.0,), (-500.0,), (500.0,), (None,)], "z double")
    rows = df.select(T.psit_26("z").alias("t"), T.psiu_26("z").alias("u"), T.psiu_40("z").alias("v")).collect()
    assert abs(rows[0]["t"]) < 0.01 and abs(rows[0]["u"]) < 1e-9 and abs(rows[0]["v"]) < 1e-9
    assert all(math.isfinite(x) for r in rows[:3] for x in r) and rows[3]["t"] is None


def test_wind_round_trip(spark):
    df = spark.createDataFrame([(5.0, 30.0), (7.0, 250.0), (0.0, 0.0)], "s double, d double")
    back = df.withColumn("w", T.spd_dir2uv("s", "d")).withColumn("b", T.uv2spd_dir("w.u", "w.v")).select("s", "d", "b.*").collect()
    for r in back:
        assert r["spd"] == pytest.approx(r["s"], abs=1e-12)
        if r["s"]:
            assert math.cos(math.radians(r["dir"] - r["d"])) == pytest.approx(1.0)


def test_calendar(spark):
    df = spark.sql("SELECT 2012 AS y, 60.25D AS d UNION ALL SELECT 2011, 60.25D")
    got = {r["y"]: str(r["t"]) for r in df.select("y", C.yearday_to_time(F.col("y"), F.col("d")).alias("t")).collect()}
    assert got == {2012: "2012-02-29 06:00:00", 2011: "2011-03-01 06:00:00"}
    assert value(spark, C.decimal_day(F.lit("123"), F.lit("12"), F.lit("3030500"))) == pytest.approx(123 + (12 + (30 + 30.5 / 60) / 60) / 24)
    m, d = C.month_day(F.lit(2000), F.lit(366))
    assert (value(spark, m), value(spark, d)) == (12, 31)


def test_floor_time_before_1970_and_fractions(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 22:30:00.5' AS t")
    assert str(df.select(C.floor_time("t", "3 hours").alias("f")).first()["f"]) == "1969-12-31 21:00:00"
    assert str(df.select(C.floor_time("t", "month").alias("f")).first()["f"]) == "1969-12-01 00:00:00"


def test_hash_draws_do_not_depend_on_layout(spark):
    df = spark.range(2000)
    one = df.coalesce(1).select(H.hash_uniform(1, F.col("id")).alias("u"), H.hash_normal(2, F.col("id")).alias("n"))
    many = df.repartition(13).select(H.hash_uniform(1, F.col("id")).alias("u"), H.hash_normal(2, F.col("id")).alias("n"))
    stat = [F.avg("u"), F.min("u"), F.max("u"), F.avg("n"), F.stddev_pop("n")]
    a, b = one.agg(*stat).first(), many.agg(*stat).first()
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-12)
    assert a[0] == pytest.approx(0.5, abs=0.02) and 0 <= a[1] and a[2] < 1 and a[4] == pytest.approx(1, abs=0.05)


def test_albedo_needs_daylight(spark):
    df = spark.createDataFrame([(500.0, 172.5, 0.0, 0.0), (0.0, 172.0, 0.0, 0.0)], "sw double, jd double, lon double, lat double")
    noon, night = T.with_albedo(df, "sw", "jd", "lon", "lat").collect()
    assert noon["altitude"] > 60 and 0.02 < noon["albedo"] < 0.1
    assert night["altitude"] == 0 and night["albedo"] == 0 and night["transmission"] == 0
