"""Tables in the folder that driver and executors share, where a plan must not be run again or a lineage be cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local master, which is one process, may go without."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {SETTING} to a folder that the executors of {master} share")
    own = tempfile.mkdtemp(prefix="assayspark-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set(SETTING, f"file://{own}")
    return f"file://{own}"


def own_path(spark: SparkSession, name: str) -> str:
    """A new path of this application's in the shared folder."""
    return f"{folder(spark)}/assayspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once and survives lost executors."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has kept; frames that read it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/assayspark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
