"""Chains, streaming, and what the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from checks import models as N
from checks.views import view
from halocline import session
from halocline.operators import bulk as B, metrics as M, quality as Q, series as S
from halocline.plans import forcing, waves
from halocline.sources import text as R
from halocline.streaming import ingest as I


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_stay_in_the_jvm_and_read_few_columns(spark, sf):
    o = Q.complete_cases(view(spark, sf, "obs"), ["U"])
    p = plan(M.evaluate_over_splits(o, M.SPLITS_4, "pred_mean", "taucx", "taubx", "weight"))
    assert "Python" not in p and "BroadcastHashJoin" in p and p.count("Exchange hashpartitioning") == 1
    assert "event_type" not in p and "props" not in p


def test_no_series_goes_through_one_partition(spark, sf):
    o = view(spark, sf, "obs").select("event_id", "time", "pcode", "lat", "lon", "taucx")
    for df in (S.stage_label(o, ["pcode"], "time", "event_id"), S.rolling_mean(o, "taucx", 24, "time", "event_id")):
        for line in plan(df).split("\n"):
            if "Window " in line:
                assert "_chunk" in line or "_block" in line, line


def test_bulk_has_no_shuffle(spark, sf):
    p = plan(B.bulk36(view(spark, sf, "obs")))
    assert "Exchange" not in p and p.count("ArrowEvalPython") == 1


def test_shared_folder_is_the_one_the_session_names(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert session.scratch(spark).startswith(session.shared_dir(spark))
    assert session.cut_lineage(spark.range(5)).count() == 5


def station(spark, sf):
    return R.with_station_state(view(spark, sf, "station").withColumnRenamed("time", "datetime"))


def test_forcing_members_average_to_the_mean(spark, sf, tmp_path):
    models = {"SH": N.SH, "LH": N.LH, "M": N.M}
    path = str(tmp_path / "out")
    out = forcing.build_forcing(station(spark, sf), models, "2024-01-03", "2024-01-09", members=5, seed=2, path=path)
    assert out.count() == 5 * 56
    text = spark.read.text(path).select("member", F.split("value", "\t").alias("t")).select("member", F.col("t")[0].alias("d"), F.col("t")[1].cast("double").alias("v"))
    assert {r["member"] for r in text.select("member").distinct().collect()} == {"ann_mean", "ann_ensem_mean", "bulk", *[f"ann_ensem{i}" for i in range(1, 6)]}
    members = text.filter("member RLIKE '^ann_ensem[0-9]'").groupBy("d").agg(F.avg("v").alias("a"))
    both = members.join(text.filter("member = 'ann_ensem_mean'"), "d")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("v")))).first()[0] < 1e-6
    with pytest.raises(ValueError, match="unknown flux"):
        forcing.build_forcing(station(spark, sf), models, "2024-01-03", "2024-01-04", "salt")


def test_waves_only_in_cruise_months(spark):
    grid = spark.sql("""SELECT ts, CAST(a.id AS DOUBLE) AS lat, CAST(b.id AS DOUBLE) AS lon, 2D AS phs0
        FROM (SELECT explode(array(TIMESTAMP_NTZ'2015-01-01', TIMESTAMP_NTZ'2015-02-01', TIMESTAMP_NTZ'2015-06-01')) AS ts)
        CROSS JOIN range(2) a CROSS JOIN range(2) b""")
    obs = spark.sql("""SELECT 1 AS i, TIMESTAMP_NTZ'2015-01-10' AS time, 0.5D AS lat, 0.5D AS lon UNION ALL
        SELECT 2, TIMESTAMP_NTZ'2015-04-10', 0.5D, 0.5D UNION ALL SELECT 3, TIMESTAMP_NTZ'1990-01-01', 0.5D, 0.5D""")
    got = {r["i"]: r["phs0"] for r in waves.add_waves(obs, grid, ["phs0"], only_cruise_months=True).collect()}
    assert got == pytest.approx({1: 2.0, 2: 0.0})


def test_stream_gives_the_batch_answer(spark, sf, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    o = view(spark, sf, "obs").select("event_id", "U", "tsea", "tair", "rh", "p", "zu", "zt", "zq", "lat", "qc")

    def loader(df):
        return B.bulk36(Q.qc_ok(Q.complete_cases(df, ["U"]))).select("event_id", "tau", "hs", "hl")

    def push(df):
        df.write.mode("append").parquet(src)
        I.ingest(I.arriving_files(spark, src, o.schema, 1), loader, out, ck)

    push(o.filter("event_id < 400"))
    push(o.filter("event_id >= 400"))
    got, want = spark.read.parquet(out), loader(o)
    assert got.count() == want.count()
    assert got.join(want.withColumnsRenamed({c: f"w_{c}" for c in ("tau", "hs", "hl")}), "event_id").agg(
        F.max(F.abs(F.col("tau") - F.col("w_tau")) + F.abs(F.col("hl") - F.col("w_hl")))).first()[0] == 0
