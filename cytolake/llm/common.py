"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: The white space of every operator here: [\x20\x09-\x0D].
SPACE = "[\\x20\\x09-\\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def without_space(text: Column) -> Column:
    return F.array_join(F.split(text, SPACE + "+"), "")


def count_of(text: Column, pattern: str) -> Column:
    """Matches of a pattern of one character."""
    return (F.size(F.split(text, pattern)) - 1).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet to the cluster's shared folder and read back: no lineage, and true sizes for the planner.

    Loops need the true sizes: a checkpoint keeps the size estimate of its plan, a product over joins that grows with
    every round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cytolake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def spent(*steps: DataFrame) -> None:
    """Deletes the files of steps, as ``cut`` gave them, that nothing reads any more: what came of them is written too."""
    for df in steps:
        path = getattr(df, "_step", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_cytolake_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "cytolake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(path)
    sc._cytolake_shipped = True


def renamed(df: DataFrame, key: str) -> DataFrame:
    """The row as one struct column beside its key, so that no column of it can clash."""
    return df.select(F.col(key).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def position(df: DataFrame, group: list[str], order: Column, name: str, buckets: int = 256) -> DataFrame:
    """Adds the gapless 0-based position of each row within its group, as ``name``.

    Rows fall into ``buckets`` by ``order`` (a long hash); the counts of (group, bucket) give each bucket its first
    position, and a window numbers rows within the bucket only. No task holds a whole group.
    """
    df = df.withColumn("_o", order).withColumn("_b", F.pmod(F.shiftright("_o", 40), F.lit(buckets)).cast("int"))
    from pyspark.sql import Window as W

    sizes = df.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    firsts = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = W.partitionBy(*group, "_b").orderBy("_o")
    df = df.withColumn("_rn", F.row_number().over(within).cast("long") - 1)
    same = [df[c].eqNullSafe(firsts[c]) for c in [*group, "_b"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    kept = [df[c] for c in df.columns if c not in ("_o", "_b", "_rn")]
    return df.join(firsts, on).select(*kept, (df["_rn"] + firsts["_first"]).alias(name))


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])
