"""Session defaults and the shared-folder helpers every operator uses to cut lineage."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "quillarn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one ``spark.checkpoint.dir`` names. Where that is unset, a local session (one
    machine, as in tests) gets a temporary folder, and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "quillarn-shared")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: later plans start there, and an executor's loss
    costs only the tasks it was running. The table is deleted when the driver's JVM ends, or before by ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillarn/{what}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillarn_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table behind a ``cut`` no plan needs any longer."""
    path = getattr(df, "_quillarn_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    """The partitions a shuffle makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
