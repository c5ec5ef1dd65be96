"""Session helpers: table loading, shared scratch tables, hot-key-safe group joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; columns are pruned by what the caller selects."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where that is unset, a local folder serves a local session, as in tests; on a cluster it is an error, as executors
    would write to disks of their own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lotsman-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage and survives the loss of executors; the files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lotsman/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def salt(by: Column | str, salts: int) -> Column:
    """A salt in ``[0, salts)`` that depends only on ``by``, so a repeated task gives the same rows."""
    return F.pmod(F.xxhash64(F.lit(77), by), F.lit(salts)).cast("int")


def group_min_count(rows: DataFrame, key: str, by: str, salts: int = 64) -> DataFrame:
    """(key, salt, least, copies) for every (key, salt) that occurs, ``least`` and ``copies`` over the whole key.

    Two levels: a key that holds a third of all rows is reduced map-side, then by ``salts`` tasks, then as
    ``salts`` rows; no task sees all rows of a key.
    """
    part = rows.groupBy(key, salt(by, salts).alias("_salt")).agg(F.min(by).alias("_least"), F.count(F.lit(1)).alias("_n"))
    whole = part.groupBy(key).agg(F.min("_least").alias("least"), F.sum("_n").alias("copies"))
    return part.select(key, "_salt").join(whole, key)

