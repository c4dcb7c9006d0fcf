"""Text sources: whitespace series, profile dumps, block profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from halocline.functions.clock import from_micros, micros, ntz
from halocline.functions.thermo import rhcalc
from halocline.operators.quality import wind_parts
from halocline.schema import PROFILE_COLUMNS, finite
from halocline.session import scratch

SLASHES = "yyyy/MM/dd HH:mm:ss"
DASHES = "yyyy-MM-dd HH:mm:ss"


def _tokens(col: str = "value") -> Column:
    return F.split(F.trim(F.col(col)), r"\s+")


def _with_tokens(lines: DataFrame, *keep: str) -> DataFrame:
    """Lines as tokens in `t`, split once a line: the optimizer would put the split in place of every use of a plain column."""
    return lines.select(*keep, F.explode(F.array(_tokens())).alias("t"))


def _number(c: Column) -> Column:
    return finite(c.try_cast("double"))


def read_series(spark: SparkSession, path: str, cols: list[str], fmt: str = SLASHES, time: str = "datetime") -> DataFrame:
    """Lines `date time v1 v2 ...`; lines with too few tokens are skipped."""
    t = _with_tokens(spark.read.text(path)).filter(F.size("t") >= len(cols) + 2)
    stamp = F.to_timestamp_ntz(F.concat_ws(" ", F.col("t")[0], F.col("t")[1]), F.lit(fmt))
    return t.select(stamp.alias(time), *[_number(F.col("t")[i + 2]).alias(c) for i, c in enumerate(cols)])


def read_vars(spark: SparkSession, folder: str, files: list[tuple[str, list[str]]], fmt: str = SLASHES) -> DataFrame:
    """Several series joined on equal times, in list order. All joins share one key."""
    frames = [read_series(spark, f"{folder}/{name}", cols, fmt) for name, cols in files]
    return reduce(lambda a, b: a.join(b, "datetime"), frames)


# File names and columns of a station folder.
STATION_FILES = [
    ("sst.dat", ["sst"]), ("u10.dat", ["ux", "uy"]), ("airt.dat", ["t"]), ("airp.dat", ["p"]), ("hum.dat", ["q"]),
    ("momentumflux.dat", ["taux", "tauy"]), ("heatflux.dat", ["heat"]), ("swr.dat", ["swr"]), ("lwr.dat", ["lwr"]),
]


def read_station(spark: SparkSession, folder: str, fmt: str = SLASHES) -> DataFrame:
    """Nine station files on common times, with wind speed, direction cosines and relative humidity."""
    return with_station_state(read_vars(spark, folder, STATION_FILES, fmt))


def with_station_state(df: DataFrame) -> DataFrame:
    return wind_parts(df).withColumn("rh", rhcalc("t", F.col("p") / 100.0, "q"))


def read_fluxes(spark: SparkSession, heat: str, momentum: str, fmt: str = SLASHES) -> DataFrame:
    """A heat-flux and a momentum-flux file on common times."""
    h, m = read_series(spark, heat, ["Q"], fmt), read_series(spark, momentum, ["taux", "tauy"], fmt)
    return h.join(m, "datetime").select("datetime", "Q", "taux", "tauy")


def _dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of profile dumps: 12 tokens per line, anything else (trailer, blanks) is left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    t = _with_tokens(lines, "_file").filter(F.size("t") == len(PROFILE_COLUMNS))
    names = ["seconds", *PROFILE_COLUMNS[1:]]
    rows = t.select("_file", *[_number(F.col("t")[i]).alias(c) for i, c in enumerate(names)])
    return rows.filter(F.col("seconds").isNotNull() & F.col("z").isNotNull())


def _stamped(rows: DataFrame, start: Column) -> DataFrame:
    ts = from_micros(micros(start) + F.round(F.col("seconds") * 1e6).cast("bigint"))
    return rows.withColumn("ts", ts).drop("seconds")


def read_profiles(spark: SparkSession, path: str | list[str], start: str) -> DataFrame:
    """One profile dump: time is seconds since `start`."""
    return _stamped(_dump(spark, path), ntz(F.lit(start))).select(*PROFILE_COLUMNS)


def profile_scalars(profiles: DataFrame, by: list[str] = ("ts",)) -> DataFrame:
    """Stress and heat flux per time, taken from the first (lowest) depth."""
    return profiles.groupBy(*by).agg(*[F.min_by(c, "z").alias(c) for c in ("taux", "tauy", "Q")])


def read_monthly(spark: SparkSession, path: str | list[str], year: int | None = None, month_pattern: str = r"out_(\d+)",
                 member_pattern: str | None = None, year_pattern: str | None = None) -> DataFrame:
    """Monthly restarts, each running past its month: keep the rows of the file's own month.

    Month (and member, and the year unless it is given) come from the file's path, all files
    of all years are read as one table.
    """
    if (year is None) == (year_pattern is None):
        raise ValueError("give the year or the pattern that finds it in the path")
    rows = _dump(spark, path)
    month = F.regexp_extract("_file", month_pattern, 1).try_cast("int")
    of = F.lit(year) if year_pattern is None else F.regexp_extract("_file", year_pattern, 1).try_cast("int")
    rows = rows.withColumns({"_month": month, "_year": of}).filter(F.col("_month").isNotNull() & F.col("_year").isNotNull())
    rows = _stamped(rows, F.make_date(F.col("_year"), F.col("_month"), F.lit(1)).cast("timestamp_ntz"))
    rows = rows.filter((F.month("ts") == F.col("_month")) & (F.year("ts") == F.col("_year")))
    member = []
    if member_pattern:
        member = [F.regexp_extract("_file", member_pattern, 1).cast("int").alias("ensem")]
        rows = rows.filter(F.regexp_extract("_file", member_pattern, 1) != "")
    return rows.select(*member, *PROFILE_COLUMNS)


def read_ensemble(spark: SparkSession, path: str | list[str], start: str, member_pattern: str = r"ensem(\d+)") -> DataFrame:
    """Member files stacked with an `ensem` column. Names without a number (means) are left out."""
    rows = _stamped(_dump(spark, path), ntz(F.lit(start)))
    m = F.regexp_extract("_file", member_pattern, 1)
    return rows.filter(m != "").select(m.cast("int").alias("ensem"), *PROFILE_COLUMNS)


HEADER = r"^\s*\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2}\s+\d+\s+\d+\s*$"


_BLOCKS = "file long, split long, head string, z string, value string, edge boolean"


def _blocks(batches):
    """Lines of whole splits in file order, as the two numbers of a data line with the header above it in the same split.

    Lines before a split's first header have none yet. A split's last header follows as an edge row.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def rows(file, split, head, z, value, edge):
        return pa.RecordBatch.from_arrays([pa.array(file, pa.int64()), pa.array(split, pa.int64()), head.cast(pa.string()), z.cast(pa.string()), value.cast(pa.string()),
                                           pa.array([edge] * len(file), pa.bool_())], names=["file", "split", "head", "z", "value", "edge"])

    here, last = None, None  # the split being read, and its last header
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(0), "")
        file, split = (np.asarray(batch.column(i), np.int64) for i in (1, 2))
        starts = np.append(0, np.flatnonzero((file[1:] != file[:-1]) | (split[1:] != split[:-1])) + 1)
        is_head = np.asarray(pc.match_substring_regex(text, HEADER))
        for low, high in zip(starts, np.append(starts[1:], len(file))):
            if here != (file[low], split[low]):
                if last is not None:
                    yield rows([here[0]], [here[1]], pa.array([last]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), True)
                here, last = (file[low], split[low]), None
            heads = np.flatnonzero(is_head[low:high]) + low
            names = pa.concat_arrays([pa.array([last], pa.string()), text.take(pa.array(heads)).cast(pa.string())])
            tokens = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(text.slice(low, high - low)))
            data = np.flatnonzero((np.asarray(pc.list_value_length(tokens)) == 2) & ~is_head[low:high])
            if len(data):
                flat = pc.list_flatten(tokens.take(pa.array(data)))
                above = np.searchsorted(heads, data + low)  # headers before each line; 0 is the one of an earlier batch
                yield rows(file[low + data], split[low + data], names.take(pa.array(above)), flat[::2], flat[1::2], False)
            if len(heads):
                last = names[-1].as_py()
    if last is not None:
        yield rows([here[0]], [here[1]], pa.array([last]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), True)


def read_profile_blocks(spark: SparkSession, path: str | list[str], fmt: str = DASHES) -> DataFrame:
    """Blocks `date time n m` followed by n lines `z value` -> (ts, z, value).

    The text is read once, split by split, and no line is moved: a line takes the header above it in its split. What is
    left are lines before a split's first header, which take the last header of the nearest earlier split of their file
    that has one, from a table with one row a split.
    """
    lines = spark.read.text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    where = scratch(spark, "profile-blocks")
    lines.mapInArrow(_blocks, _BLOCKS).write.parquet(where)
    parsed = spark.read.schema(_BLOCKS).parquet(where)
    orphans = parsed.filter("NOT edge AND head IS NULL").drop("head", "edge")
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    asked = orphans.select("file", "split").distinct().withColumn("head", F.lit(None).cast("string"))
    edges = parsed.filter("edge").select("file", "split", "head").unionByName(asked).groupBy("file", "split").agg(F.max("head").alias("head"))
    found = orphans.join(edges.select("file", "split", F.last("head", ignorenulls=True).over(before).alias("head")), ["file", "split"])
    rows = parsed.filter("NOT edge AND head IS NOT NULL").select("head", "z", "value").unionByName(found.filter("head IS NOT NULL").select("head", "z", "value"))
    t = F.split(F.trim("head"), r"\s+")
    stamp = F.to_timestamp_ntz(F.regexp_replace(F.concat_ws(" ", t[0], t[1]), "/", "-"), F.lit(fmt))
    return rows.select(stamp.alias("ts"), _number(F.col("z")).alias("z"), _number(F.col("value")).alias("value"))
