"""Source and sink queries (S3-S18): text and tables are written from the views, then read back."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import using, view
from halocline.functions.clock import floor_time, ntz
from halocline.operators import quality as Q
from halocline.session import scratch
from halocline.sources import sinks as W, tables as L, text as R


def station(spark, sf):
    return view(spark, sf, "station").withColumnRenamed("time", "datetime")


@query("s3_harmonise", using("obs") + """SELECT event_id, U AS wspd, qair*1e3 AS q, -hsc AS hs, tsea + 273.15e0 AS sst
  FROM obs WHERE U IS NOT NULL""", keys="event_id")
def s3(spark, sf):
    return Q.harmonise(view(spark, sf, "obs"), {
        "event_id": "event_id", "wspd": "U", "q": {"from": "qair", "scale": 1e3}, "hs": {"from": "hsc", "sign": -1},
        "sst": {"from": "tsea", "add": 273.15}}, ["U", "qair", "hsc"])


@query("s4_read_series", using("station") + "SELECT time AS datetime, round(x, 8) AS x, round(q, 8) AS q FROM station", keys="datetime", digits=8)
def s4(spark, sf):
    path = scratch(spark, "series")
    W.write_series(station(spark, sf), path, ["x", "q"])
    return R.read_series(spark, path, ["x", "q"], R.DASHES)


@query("s16_write_series_gaps", using("obs") + "SELECT time_bucket(INTERVAL 1 SECOND, time) AS datetime, round(U, 8) AS u FROM obs", keys="datetime", digits=8)
def s16(spark, sf):
    path = scratch(spark, "series")
    W.write_series(view(spark, sf, "obs").select(F.col("time").alias("datetime"), F.col("U").alias("u")), path, ["u"])
    return R.read_series(spark, path, ["u"], R.DASHES)


FILES = [("sst.dat", ["sst"]), ("u10.dat", ["ux", "uy"]), ("hum.dat", ["q"])]


@query("s5_read_vars", using("station") + "SELECT time AS datetime, round(sst,8) AS sst, round(ux,8) AS ux, round(uy,8) AS uy, round(q,8) AS q FROM station WHERE heat < -20", keys="datetime", digits=8)
def s5(spark, sf):
    folder = scratch(spark, "vars")
    st = station(spark, sf)
    for name, cols in FILES:
        W.write_series(st.filter("heat < -20") if name == "hum.dat" else st, f"{folder}/{name}", cols)
    return R.read_vars(spark, folder, FILES, R.DASHES)


def write_station(spark, sf, only=None):
    folder = scratch(spark, "station")
    st = station(spark, sf)
    for name, cols in R.STATION_FILES:
        if only is None or name in only:
            W.write_series(st, f"{folder}/{name}", cols)
    return folder


S8 = "s8 AS (SELECT time, round(COLUMNS(* EXCLUDE (time)), 8) FROM station)"
RH = "1e2*((p/1e2)*q/(0.622e0+0.378e0*q))/(6.1121e0*exp(17.502e0*t/(240.97e0+t))*(1.0007e0+p/1e2*3.46e-6))"


@query("s6_read_station", using("station", extra=S8) + f"""SELECT time AS datetime, sst, ux, uy, t, p, q, taux, tauy, heat, swr, lwr,
  sqrt(ux*ux+uy*uy) AS U, ux/sqrt(ux*ux+uy*uy) AS cos, uy/sqrt(ux*ux+uy*uy) AS sin, {RH} AS rh FROM s8""", keys="datetime", digits=8)
def s6(spark, sf):
    folder = write_station(spark, sf)
    return R.read_station(spark, folder, R.DASHES)


@query("s7_read_fluxes", using("station", extra=S8) + "SELECT time AS datetime, heat AS Q, taux, tauy FROM s8", keys="datetime", digits=8)
def s7(spark, sf):
    folder = write_station(spark, sf, ["heatflux.dat", "momentumflux.dat"])
    return R.read_fluxes(spark, f"{folder}/heatflux.dat", f"{folder}/momentumflux.dat", R.DASHES)


def dump_line(seconds, cols):
    return F.concat_ws(" ", seconds, *[c.cast("string") for c in cols])


def profile_lines(start):
    """Twelve tokens per level: seconds, depth, velocities, state, and the per-time scalars."""
    sec = F.timestamp_diff("SECOND", start, F.col("ts")).cast("string")
    zero = F.lit(0.0)
    return dump_line(sec, [F.col("z"), zero, zero, F.col("temp"), F.col("salt"), zero, zero, F.col("temp") / 10,
                           F.col("salt") / 10, F.col("q"), zero])


JUNK = [" ", "finished in 12 s", "# end"]


def prof_s(spark, sf):
    return view(spark, sf, "prof").withColumn("ts", floor_time("ts", "1 second"))


def with_trailer(spark, lines):
    return lines.unionByName(spark.createDataFrame([(j,) for j in JUNK], "value string"))


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_dump(lines, path, *by):
    """Packed text, one folder per value of `by`: written as the lines come, without sorting them, in files of bounded length."""
    conf = lines.sparkSession.conf
    before = conf.get(WRITERS)
    conf.set(WRITERS, "64")
    try:
        lines.write.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 2_000_000}).partitionBy(*by).text(path)
    finally:
        conf.set(WRITERS, before)


@query("s8_read_profiles", using("prof") + """SELECT date_trunc('second', ts) AS ts, z, temp, salt, q AS heat FROM prof""", keys="ts", digits=7)
def s8(spark, sf):
    path = scratch(spark, "dump")
    lines = prof_s(spark, sf).select(profile_lines(ntz(F.lit("2024-01-01"))).alias("value"))
    write_dump(with_trailer(spark, lines), path)
    return R.read_profiles(spark, path, "2024-01-01").select("ts", "z", "temp", "salt", F.col("Q").alias("heat"))


@query("s8_profile_scalars", using("prof") + """SELECT TIMESTAMP '2024-01-01' + to_seconds(pid*10) AS ts, min_by(temp, z)/1e1 AS taux,
  min_by(salt, z)/1e1 AS tauy, min_by(q, z) AS Q FROM prof GROUP BY pid""", keys="ts", digits=6)
def s8b(spark, sf):
    path, start = scratch(spark, "dump"), ntz(F.lit("2024-01-01"))
    p = view(spark, sf, "prof").withColumn("ts", F.timestamp_add("SECOND", (F.col("pid") * 10).cast("int"), start))
    write_dump(p.select(profile_lines(start).alias("value")), path)
    return R.profile_scalars(R.read_profiles(spark, path, "2024-01-01"))


# Case rows as single-level profiles, a folder a year, each month file running past its month.
YEAR = """y AS (SELECT row_id, ts + to_seconds(row_id % 86400) AS ts, -1e0*row_id AS z, sst AS temp FROM cases)"""


@query("s9_read_monthly", using("cases", extra=YEAR) + "SELECT ts, z, temp FROM y", keys="ts", digits=6)
def s9(spark, sf):
    path = scratch(spark, "months")
    c = view(spark, sf, "cases").withColumn("ts", F.timestamp_add("SECOND", (F.col("row_id") % 86400).cast("int"), F.col("ts")))
    c = c.select("ts", (-F.col("row_id").cast("double")).alias("z"), F.col("sst").alias("temp"), F.lit(35.0).alias("salt"), "q")
    month, day = F.month("ts"), F.dayofmonth("ts")
    spill = F.when((day <= 3) & (month > 1), F.array(month, month - 1)).otherwise(F.array(month))
    c = c.withColumn("y", F.year("ts")).withColumn("m", F.explode(spill))
    start = F.make_date(F.col("y"), F.col("m"), F.lit(1)).cast("timestamp_ntz")
    lines = c.select("y", F.concat(F.lit("out_"), F.col("m").cast("string")).alias("name"), profile_lines(start).alias("value"))
    lines.write.partitionBy("y", "name").text(path)
    return R.read_monthly(spark, f"{path}/y=*/name=out_*", year_pattern=r"y=(\d{4})").select("ts", "z", "temp")


@query("s10_read_ensemble", using("prof") + "SELECT ensem + 1 AS ensem, date_trunc('second', ts) AS ts, z, temp FROM prof", keys="ensem, ts", digits=6)
def s10(spark, sf):
    path = scratch(spark, "members")
    p = prof_s(spark, sf)
    lines = p.select(F.concat(F.lit("out_1_ensem"), (F.col("ensem") + 1).cast("string")).alias("name"),
                     profile_lines(ntz(F.lit("2024-01-01"))).alias("value"))
    both = F.explode(F.array("name", F.lit("out_ensem_mean_1"))).alias("name")  # each line is made once, for its member and the decoy
    write_dump(lines.select(both, "value"), path, "name")
    return R.read_ensemble(spark, f"{path}/name=out_*", "2024-01-01").select("ensem", "ts", "z", "temp")


@query("s11_save_compact", using("obs") + "SELECT event_id, U::FLOAT::DOUBLE AS U, p::FLOAT::DOUBLE AS p FROM obs", keys="event_id", digits=4)
def s11(spark, sf):
    path = scratch(spark, "compact")
    W.save_compact(view(spark, sf, "obs").select("event_id", "U", "p"), path)
    return spark.read.parquet(path)


@query("s12_profile_blocks", using("prof") + "SELECT date_trunc('second', ts) AS ts, z, temp AS value FROM prof", keys="ts", digits=6)
def s12(spark, sf):
    path = scratch(spark, "blocks")
    body = F.sort_array(F.collect_list(F.struct("z", "temp")))
    blocks = prof_s(spark, sf).groupBy("pid", "ts").agg(body.alias("b"))
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.size("b").cast("string"), F.lit(" 2"))
    rest = F.transform("b", lambda r: F.concat_ws(" ", r["z"].cast("string"), r["temp"].cast("string")))
    blocks.select(F.concat_ws("\n", head, F.concat_ws("\n", rest)).alias("value")).write.text(path)
    return R.read_profile_blocks(spark, path)


@query("s13_explode_aligned", using("obs") + """, f AS (SELECT pcode, row_number() OVER (PARTITION BY pcode, event_id // 4096 ORDER BY event_id) - 1 AS element,
     event_id // 4096 AS d, tsea AS a, rh AS b FROM obs)
  SELECT pcode, d, CAST(element AS INT) AS element, a, b, NULL::DOUBLE AS c FROM f""", keys="pcode, d, element", digits=7)
def s13(spark, sf):
    """One file for each cruise and 4096 event numbers, so that no array grows with the table."""
    o = view(spark, sf, "obs").withColumn("d", F.expr("event_id div 4096"))
    files = o.groupBy("pcode", "d").agg(F.sort_array(F.collect_list(F.struct("event_id", "tsea", "rh"))).alias("l"))
    files = files.select("pcode", "d", F.col("l.tsea").alias("a"), F.col("l.rh").alias("b"),
                         F.concat("l.tsea", F.array(F.lit(0.0))).alias("c"))
    return L.explode_aligned(files, "a").select("pcode", "d", "element", "a", "b", "c")


@query("s13_buoy_loader", using("obs") + """SELECT event_id, U, tair, tsea, rh, p, -taucx*1.2e0 AS taucx, -hsc*1.2e0*1e3 AS hsc, taubx, -hsb AS hsb, -hlb AS hlb
  FROM obs WHERE U IS NOT NULL AND qc = 0""", keys="event_id", digits=6)
def s13b(spark, sf):
    o = view(spark, sf, "obs").select(
        "event_id", F.col("U").alias("Ue"), F.col("tair").alias("Tair"), F.col("tsea").alias("Tsea"), F.col("rh").alias("RH"),
        (F.col("p") / 100).alias("Pair"), "zq", "zt", "zu", F.col("taucx").alias("UW"), F.col("taucy").alias("VW"), F.col("hsc").alias("WT"),
        F.lit(1e3).alias("cpa"), F.lit(1.2).alias("rhoair"), F.col("taubx").alias("stress"), F.col("hsb").alias("shf"),
        F.col("hlb").alias("lhf"), F.year("time").alias("yyyy"), F.dayofyear("time").alias("yday"), F.col("qc").alias("Sbytes"))
    return L.load_buoy(o, ["event_id"]).select("event_id", "U", "tair", "tsea", "rh", "p", "taucx", "hsc", "taubx", "hsb", "hlb")


@query("s14_union_files", using("obs") + """SELECT event_id, 'a' AS campaign, U, NULL::DOUBLE AS hlc FROM obs WHERE pcode = 77
  UNION ALL SELECT event_id, 'b', U, hlc FROM obs WHERE pcode <> 77""", keys="event_id, campaign")
def s14(spark, sf):
    o = view(spark, sf, "obs")
    a = o.filter("pcode = 77").select("event_id", F.lit("a").alias("campaign"), "U")
    return L.union_files([a, o.filter("pcode <> 77").select("event_id", F.lit("b").alias("campaign"), "U", "hlc")])


@query("s15_assemble_fields", using("grid") + """, d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, lat, lon, avg(phs0) AS phs0, avg(plp0) AS plp0,
     max(wet) FILTER (hour(ts) = 0) AS wet FROM grid GROUP BY ALL)
  SELECT ts, lat, lon, phs0, plp0, wet FROM d WHERE wet IS NOT NULL""", keys="ts, wet", digits=7)
def s15(spark, sf):
    g = view(spark, sf, "grid")
    return L.assemble_fields({"wet": g.filter("hour(ts) = 0").select("ts", "lat", "lon", "wet"), "phs0": g.select("ts", "lat", "lon", "phs0"),
                              "plp0": g.select("ts", "lat", "lon", "plp0")}, ["phs0", "plp0"], "day")


@query("s17_write_forcing", using("station") + """, e AS (SELECT m::INT AS ensem, time, heat*m/1e2 AS eps FROM station CROSS JOIN range(1, 4) t(m)),
  a AS (SELECT 'ann_ensem' || ensem AS member, time, x*1e2 + eps AS v FROM station JOIN e USING (time)
   UNION ALL SELECT 'ann_mean', time, x*1e2 FROM station UNION ALL SELECT 'bulk', time, heat FROM station
   UNION ALL SELECT 'ann_ensem_mean', time, x*1e2 + heat*2/1e2 FROM station)
  SELECT member, time AS datetime, round(v, 8) AS v FROM a""", keys="member, datetime", digits=8)
def s17(spark, sf):
    path = scratch(spark, "forcing")
    st = station(spark, sf).withColumn("mean", F.col("x") * 100)
    e = st.withColumn("ensem", F.explode(F.sequence(F.lit(1), F.lit(3)))).select("ensem", "datetime", (F.col("heat") * F.col("ensem") / 100).alias("eps"))
    W.write_forcing(e, st.select("datetime", "mean", "heat"), path, ["mean"], ["eps"], ["heat"])
    lines = spark.read.text(path).select("member", F.split("value", "\t").alias("t"))
    return lines.select("member", F.to_timestamp_ntz(F.col("t")[0], F.lit(R.DASHES)).alias("datetime"), F.col("t")[1].cast("double").alias("v"))


@query("s18_write_training", using("obs") + """SELECT event_id, taucx, weight, 'bulk36' AS bulkalg, CAST(1 AS INT) AS weighting, CAST(0 AS INT) AS wave
  FROM obs""", keys="event_id, bulkalg, weighting, wave")
def s18(spark, sf):
    path = scratch(spark, "training")
    W.write_training(view(spark, sf, "obs").select("event_id", "taucx", "weight"), path, "bulk36", 1, 0)
    return spark.read.parquet(path)
