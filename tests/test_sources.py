"""Hand-made text and ragged input."""

import pytest
from pyspark.sql import functions as F

from halocline.sources import sinks as W, tables as L, text as R


def put(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_series_with_slashes_blanks_and_gaps(spark, tmp_path):
    p = put(tmp_path / "a.dat", ["2010/01/01 00:00:00   1.5  -0.25", "", "2010/01/01 07:00:00\t2.5\tnan", "junk"])
    rows = R.read_series(spark, p, ["u", "v"]).orderBy("datetime").collect()
    assert [(str(r["datetime"]), r["u"], r["v"]) for r in rows] == [("2010-01-01 00:00:00", 1.5, -0.25), ("2010-01-01 07:00:00", 2.5, None)]


def test_joined_series_keep_common_times(spark, tmp_path):
    put(tmp_path / "a.dat", [f"2010-01-01 0{h}:00:00 {h}.0" for h in range(4)])
    put(tmp_path / "b.dat", [f"2010-01-01 0{h}:00:00 {h}.5" for h in (1, 3, 5)])
    rows = R.read_vars(spark, str(tmp_path), [("a.dat", ["a"]), ("b.dat", ["b"])], R.DASHES).orderBy("datetime").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1.0, 1.5), (3.0, 3.5)]


def dump(seconds, temps):
    out = []
    for t, ts in zip(seconds, temps):
        out += [f"{t} {-3 + i}.0 0 0 {v} 35 0 0 {t}.5 {t}.25 {-t - i} 0" for i, v in enumerate(ts)] + [""]
    return out


def test_profile_dump_drops_the_trailer(spark, tmp_path):
    p = put(tmp_path / "out", dump([0, 3600], [[1, 2, 3], [4, 5, 6]]) + ["# 2 steps", "done 1 2 3"])
    df = R.read_profiles(spark, p, "2012-03-21")
    assert df.count() == 6 and str(df.agg(F.max("ts")).first()[0]) == "2012-03-21 01:00:00"
    s = R.profile_scalars(df).orderBy("ts").collect()
    assert [(r["taux"], r["Q"]) for r in s] == [(0.5, 0.0), (3600.5, -3600.0)]      # from the first depth


def test_months_keep_their_own_days(spark, tmp_path):
    put(tmp_path / "out_1_ensem1", dump([0, 30 * 86400, 31 * 86400], [[1], [2], [3]]))
    put(tmp_path / "out_2_ensem1", dump([0, 28 * 86400], [[4], [5]]))
    df = R.read_monthly(spark, str(tmp_path / "out_*"), 2011, r"out_(\d+)_ensem", r"ensem(\d+)")
    assert sorted((str(r["ts"])[:10], r["temp"], r["ensem"]) for r in df.collect()) == [
        ("2011-01-01", 1.0, 1), ("2011-01-31", 2.0, 1), ("2011-02-01", 4.0, 1)]


def test_ensemble_mean_is_no_member(spark, tmp_path):
    for name in ("out_ensem1", "out_ensem2", "out_ensem_mean"):
        put(tmp_path / name, dump([0], [[1]]))
    df = R.read_ensemble(spark, str(tmp_path / "out_ensem*"), "2012-01-01")
    assert sorted(r["ensem"] for r in df.collect()) == [1, 2]


def test_profile_blocks_over_many_splits(spark, tmp_path):
    lines = []
    for d in range(1, 29):
        n = 2 + d % 3
        lines += [f"2012-01-{d:02d} 00:00:00 {n} 2"] + [f"{-10 * (n - i)}.0 {d + i / 10}" for i in range(n)]
    p = put(tmp_path / "prof.dat", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        df = R.read_profile_blocks(spark, p)
        got = sorted((r["ts"].day, r["z"], r["value"]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted((d, -10.0 * (2 + d % 3 - i), d + i / 10) for d in range(1, 29) for i in range(2 + d % 3))
    assert got == want


def test_profile_blocks_longer_than_splits_and_odd_lines(spark, tmp_path):
    """Blocks over many splits, several files, blank lines, lines before any header, and Arrow batches of a few rows."""
    want = []
    for f in range(3):
        lines = ["-1.0 99.0", ""] if f == 1 else []
        for d in (1, 2, 3):
            lines += [f"  2012/0{f + 1}/0{d} 00:00:00  {60 if d == 2 else 1}\t2 "] + [f"\t{-i}.5   {d}.25" for i in range(60 if d == 2 else 1)] + ["only three tokens", "x 1.0"]
            want += [(f + 1, d, -i - 0.5 if i else 0.5, d + 0.25) for i in range(60 if d == 2 else 1)] + [(f + 1, d, None, 1.0)]
        put(tmp_path / "in" / f"p{f}.dat", lines) if (tmp_path / "in").exists() or not (tmp_path / "in").mkdir() else None
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [(r["ts"].month, r["ts"].day, r["z"], r["value"]) for r in R.read_profile_blocks(spark, str(tmp_path / "in")).collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    order = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_ragged_arrays(spark):
    df = spark.createDataFrame([("f1", [1.0] * 5, [2.0] * 5, [3.0] * 5, [9.0] * 3, [7.0], [0.0, 0.0, 1.0, 0.0, 0.0])],
                               "file string, a array<double>, b array<double>, c array<double>, d array<double>, e array<double>, qc array<double>")
    rows = L.explode_aligned(df, "qc").orderBy("element").collect()
    assert len(rows) == 5 and rows[2]["qc"] == 1.0 and rows[0]["a"] == 1.0 and rows[0]["d"] is None
    assert {r["variable"] for r in L.leftovers(df, "qc").collect()} == {"d", "e"}
    tie = spark.createDataFrame([("f", [1.0], [1.0, 2.0])], "file string, a array<double>, b array<double>")
    assert L.explode_aligned(tie).count() == 1          # the length seen first wins a tie


def test_forcing_text_layout(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2011-01-01 03:00:00' AS datetime, 1.5D AS a, -0.123456789D AS b")
    W.write_series(df, str(tmp_path / "f"), ["a", "b"])
    assert spark.read.text(str(tmp_path / "f")).first()["value"] == "2011-01-01 03:00:00\t1.50000000\t-0.12345679"


def test_compact_is_four_bytes(spark, tmp_path):
    W.save_compact(spark.sql("SELECT 1L AS k, 0.1D AS x"), str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert dict(back.dtypes) == {"k": "bigint", "x": "float"}


def test_loaders_flip_only_what_must_be_flipped(spark):
    cruise = spark.createDataFrame([(1, 77, 8.0, 20.0, 18.0, 9.0, 1010.0, 75.0, 30.0, 15.0, 10.0, 10.0, 0.0, 0.0, 0.1, 0.0, 12.0, 90.0)],
        "time int, pcode int, U double, tsnk double, ta double, qa double, dummy1 double, dummy2 double, dir double, zu double, zt double, zq double, "
        "lon double, lat double, taucx double, taucy double, hsc double, hlc double")
    r = L.load_cruise(cruise).first()
    assert (r["hsc"], r["hlc"], r["p"]) == (-12.0, -90.0, 101000.0) and r["qair"] == pytest.approx(0.009) and r["hlb"] < 0 < r["taubx"]
    assert L.load_cruise(cruise.withColumn("ta", F.lit(float("nan")))).count() == 0


def test_dumps_are_packed_and_members_need_no_sort(spark, tmp_path):
    """Text on disk is a fraction of its lines; folders by member are written as lines come."""
    from checks import q_sources as S
    from checks.registry import QUERIES
    from halocline.session import written
    ev = spark.range(400).selectExpr("id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id % 7 AS user_id", "id / 3.0D AS value")
    ev.write.parquet(str(tmp_path / "events.parquet"))
    for name, rows in (("s10_read_ensemble", 400 * 20), ("s8_profile_scalars", 400)):
        assert QUERIES[name](spark, str(tmp_path)).count() == rows
        where = written(spark)[-1]
        files = spark.read.text(where).inputFiles()
        assert files and all(f.endswith(".gz") for f in files)
    assert spark.conf.get(S.WRITERS) == "0"
