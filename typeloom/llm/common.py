"""What the operators share: the cluster's shared folder, row keys, stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set: a temporary one on local masters, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="typeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table is deleted by discard(), or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/typeloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, where = _located(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._typeloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, what is still to be computed included."""
    for table in tables:
        files, where = _located(table.sparkSession, table._typeloom_path)
        files.delete(where, True)


def row_key(*cols: str) -> Column:
    """A 128-bit key of a row's identity; rows equal in these columns, nulls included, share it."""
    whole = [F.col(c).cast("string") for c in cols]
    return F.unhex(F.md5(F.concat(*(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in whole))))


def require(df: DataFrame, *names: str) -> None:
    """Fail early, with the columns' names, where a table lacks what an operator reads."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
