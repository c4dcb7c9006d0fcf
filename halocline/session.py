"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on; safe to call on an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # HotSpot never compiles methods above 8000 bytes: long expressions run many times faster outside whole-stage code than interpreted in it.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the one named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = getattr(spark, "_halocline_dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="halocline-")
        spark._halocline_dir = made
    return made


def scratch(spark: SparkSession, name: str = "run") -> str:
    """A new folder name under the shared folder, for tables written between stages."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark._halocline_tables = [*written(spark), path]
    return path


def written(spark: SparkSession) -> list[str]:
    """Folders named by `scratch` in this session that were not released, oldest first."""
    return getattr(spark, "_halocline_tables", [])


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables written between stages, once nothing that is still to be computed reads them."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    spark._halocline_tables = [p for p in written(spark) if p not in set(paths)]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
