"""Loading of tables and shared session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of the directory, pruned to ``columns`` when any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written files.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and all runs on this
    machine, as in tests, a temporary folder of it is used; on a cluster a missing folder is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written between jobs."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return named or tempfile.mkdtemp(prefix="tidewater-")


def to_ms(seconds: str | Column) -> Column:
    """Whole milliseconds of a DOUBLE column of seconds; NULL for NULL, NaN and values beyond BIGINT."""
    col = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(~F.isnan(col) & (F.abs(col) < 9.0e15), F.round(col * 1000)).try_cast("bigint")
