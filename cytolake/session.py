"""Session settings for local runs; on a cluster, the cluster's own settings hold."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str | None = None, name: str = "cytolake", memory: str = "8g") -> SparkSession:
    n = str(cores or os.cpu_count() or 1)
    return (
        SparkSession.builder.master(f"local[{n}]").appName(name)
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. In local mode alone a temporary one will do."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir is unset: steps need a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: a step of a loop, without lineage and with true sizes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cytolake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def spent(*steps: DataFrame) -> None:
    """Deletes the files of written steps that nothing reads any more."""
    for df in steps:
        path = getattr(df, "_step", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
