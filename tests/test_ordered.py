"""Ordered scans: any number of chunks, ties, hot groups and empty edges give the same answer."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from halocline.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else rnd.choice(["a", "b", None])
        # a third of all rows share one position
        t = 500.0 if rnd.random() < 0.33 else float(rnd.randrange(1000))
        data.append((i, g, t, rnd.uniform(-1, 1)))
    data.append((9999, "single", 1.0, 2.0))
    return spark.createDataFrame(data, "id long, g string, t double, v double").repartition(5).cache()


def plain(rows):
    w = W.partitionBy("g").orderBy("t", "id")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    return {r["id"]: r for r in rows.select("id", F.sum("v").over(run).alias("s"), F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
                                           (F.row_number().over(w) - 1).alias("i")).collect()}


@pytest.mark.parametrize("chunks", [1, 2, 7, 64])
def test_scan_equals_plain_window(rows, chunks):
    want = plain(rows)
    got = O.scan(rows, ["g"], "t", "id", {"s": F.col("v")}, before=["v"], after=["v"], chunks=chunks).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["id"]]
        assert r["s"] == pytest.approx(w["s"], abs=1e-9)
        assert (r["prev_v"], r["next_v"]) == (w["p"], w["n"])


@pytest.mark.parametrize("chunks", [1, 5, 32])
def test_row_index_is_dense(rows, chunks):
    want = plain(rows)
    for r in O.row_index(rows, ["g"], "t", "id", chunks=chunks).collect():
        assert r["i"] == want[r["id"]]["i"]


def test_chunks_split_a_hot_position(rows):
    sizes = [r["count"] for r in O.cut(rows, "t", "id", 16).groupBy(O.CHUNK).count().collect()]
    assert max(sizes) < 3000 / 4


def test_daily_keys_and_thousands_of_chunks(spark):
    """Each of 365 days holds several of 2000 quantiles; one day holds a third of all rows, and many rows have no day."""
    df = spark.range(60000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 100 WHEN id % 17 = 0 THEN NULL ELSE id % 365 END AS day", "id * 0.5 AS v")
    rows = O.cut(df, "day", "id", 2000).cache()
    sizes = [r["count"] for r in rows.groupBy(O.CHUNK).count().collect()]
    assert 1000 < len(sizes) <= 2 * 2000 and max(sizes) < 5 * 60000 / 2000
    ends = rows.groupBy(O.CHUNK).agg(F.min(F.struct("day", "id")).alias("a"), F.max(F.struct("day", "id")).alias("b"))
    w = W.orderBy(O.CHUNK)
    assert ends.withColumn("p", F.lag("b").over(w)).filter("p >= a").count() == 0  # chunks follow (day, id)
    got = O.scan(rows, [], "day", "id", {"i": F.lit(1)}, inclusive=False)
    want = df.withColumn("w", F.row_number().over(W.orderBy("day", "id")) - 1)
    assert got.join(want.select("id", "w"), "id").filter("i != w").count() == 0
    assert "CASE WHEN" not in O.cut(df, "day", "id", 2000).drop("day")._jdf.queryExecution().optimizedPlan().toString().replace("CASE WHEN ((id", "")


def test_the_largest_missing_and_equal_ties(spark):
    df = spark.createDataFrame([(None, None, i) for i in range(50)] + [(1.0, float(i // 10), i) for i in range(50)], "t double, tie double, id int")
    rows = O.cut(df, "t", "tie", 20)
    ends = rows.groupBy(O.CHUNK).agg(F.min(F.struct("t", "tie")).alias("a"), F.max(F.struct("t", "tie")).alias("b"), F.count("*").alias("n")).orderBy(O.CHUNK).collect()
    assert ends[0]["n"] == 50 and all(x["b"] < y["a"] for x, y in zip(ends[1:], ends[2:])) and len(ends) > 4


def test_totals_and_exclusive(rows):
    got = O.scan(rows, [], "t", "id", {"n": F.lit(1)}, inclusive=False, totals=True, chunks=9)
    assert got.agg(F.max("n"), F.min("n_total"), F.max("n_total")).first()[:] == (3000, 3001, 3001)


def test_halo_blocks_lend_the_right_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "i")
    b = O.halo_blocks(df, [], "i", 10, 3, 2).groupBy("_block").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.sum(F.col("_own").cast("int")).alias("own"))
    got = {r["_block"]: (r["a"], r["b"], r["own"]) for r in b.collect()}
    assert got[0] == (0, 11, 10) and got[4] == (37, 51, 10) and got[9] == (87, 99, 10)


def test_times_as_order(spark):
    df = spark.sql("SELECT id, TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, id) AS t FROM range(50)")
    got = O.scan(df, [], "t", after=["t"], chunks=6).filter("next_t IS NULL").collect()
    assert [r["id"] for r in got] == [49]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_are_exact(spark, n):
    """The hot group has nearly all rows and few distinct values; one group has no value."""
    from halocline.operators.series import exact_quantiles
    rnd = random.Random(n)
    data = [("hot", float(rnd.choice([10, 10, 10, 60, rnd.randrange(500)]))) for _ in range(n)] + [("a", 1.0), ("a", 5.0), (None, 2.0), ("none", None)]
    got = {r.g: (r.lower, r.median, r.upper) for r in exact_quantiles(spark.createDataFrame(data, "g string, v double"), "v", {"lower": 0.25, "median": 0.5, "upper": 0.9}, ["g"]).collect()}
    for g in ("hot", "a", None, "none"):
        v = sorted(x for k, x in data if k == g and x is not None)
        want = tuple(next(x for i, x in enumerate(v) if i + 1 >= q * len(v)) if v else None for q in (0.25, 0.5, 0.9))
        assert got[g] == want
