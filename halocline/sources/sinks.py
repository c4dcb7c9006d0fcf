"""Sinks: compact tables, forcing text, training sets, fitted cases."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from halocline.functions.clock import ntz


def save_compact(df: DataFrame, path: str) -> None:
    """Compressed parquet with 4-byte floats."""
    cols = [F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields]
    df.select(*cols).write.option("compression", "zstd").parquet(path)


def series_line(time: str, cols: list[str | Column]) -> Column:
    """`YYYY-MM-DD HH:MM:SS`, then values with eight decimals, separated by tabs; a missing value is `nan`."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    vals = [F.when(c.isNull(), F.lit("nan")).otherwise(F.format_string("%.8f", c)) for c in cols]
    return F.concat_ws("\t", F.date_format(ntz(time), "yyyy-MM-dd HH:mm:ss"), *vals)


def write_series(df: DataFrame, path: str, cols: list[str], time: str = "datetime") -> None:
    """Forcing text in time order; the range partitions of the sort become the part files."""
    df.select(time, series_line(time, cols).alias("value")).orderBy(time).select("value").write.text(path)


def write_forcing(members: DataFrame, state: DataFrame, path: str, mean: list[str], noise: list[str], bulk: list[str],
                  time: str = "datetime") -> None:
    """Ensemble members, predicted mean, mean of the finite ensemble and bulk as text, one folder each.

    `members` is (ensem, time, noise...), `state` is (time, mean..., bulk...).
    """
    both = members.join(state, time)
    one = both.select(F.concat(F.lit("ann_ensem"), F.col("ensem").cast("string")).alias("member"), time,
                      *[(F.col(m) + F.col(e)).alias(f"v{i}") for i, (m, e) in enumerate(zip(mean, noise))])
    avg = members.groupBy(time).agg(*[F.avg(e).alias(f"_e{i}") for i, e in enumerate(noise)]).join(state, time)
    avg = avg.select(F.lit("ann_ensem_mean").alias("member"), time,
                     *[(F.col(m) + F.col(f"_e{i}")).alias(f"v{i}") for i, m in enumerate(mean)])
    det = state.select(F.lit("ann_mean").alias("member"), time, *[F.col(m).alias(f"v{i}") for i, m in enumerate(mean)])
    blk = state.select(F.lit("bulk").alias("member"), time, *[F.col(b).alias(f"v{i}") for i, b in enumerate(bulk)])
    rows = one.unionByName(avg).unionByName(det).unionByName(blk)
    line = series_line(time, [f"v{i}" for i in range(len(mean))])
    (rows.repartitionByRange("member", time).sortWithinPartitions("member", time)
     .select("member", line.alias("value")).write.partitionBy("member").text(path))


def write_training(df: DataFrame, path: str, bulkalg: str, weight: int, wave: int) -> None:
    """Training set laid out by the choices that made it."""
    tagged = df.withColumns({"bulkalg": F.lit(bulkalg), "weighting": F.lit(weight), "wave": F.lit(wave)})
    tagged.write.mode("append").partitionBy("bulkalg", "weighting", "wave").parquet(path)


def save_case(spark: SparkSession, model, path: str, name: str) -> None:
    """Configuration and weights of a fitted model; both are small and independent of the data."""
    spark.createDataFrame([(name, json.dumps(model.config()))], "name string, config string") \
        .coalesce(1).write.mode("append").partitionBy("name").parquet(f"{path}/config")
    spark.createDataFrame([(name, *r) for r in model.rows()],
                          "name string, head string, layer int, i int, j int, w double") \
        .coalesce(1).write.mode("append").partitionBy("name").parquet(f"{path}/weights")


def open_case(spark: SparkSession, path: str, name: str):
    """Read a fitted model back."""
    from halocline.operators.network import FluxModel
    config = json.loads(spark.read.parquet(f"{path}/config").filter(F.col("name") == name).first()["config"])
    weights = spark.read.parquet(f"{path}/weights").filter(F.col("name") == name).drop("name").collect()
    return FluxModel.restore(config, [tuple(r) for r in weights])
