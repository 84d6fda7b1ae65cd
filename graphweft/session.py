"""Session helpers: written intermediate tables, parallelism."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent and the session runs in one process (tests), a temporary folder is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-graphweft-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's tables below the shared one."""
    return f"{shared_folder(spark)}/graphweft-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it again.

    Cuts the lineage and survives the loss of executors; nothing is kept on one machine only.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df))


def written_path(df: DataFrame) -> str:
    """As ``written``, but the path of the table, for reading many of them in one scan."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared file system; such as are not there are passed over."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table_ in tables:
        removed(table_.sparkSession, *{f.rpartition("/")[0] for f in table_.inputFiles()[:1]})


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; results that were not yet read are lost."""
    removed(spark, own_folder(spark))


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
