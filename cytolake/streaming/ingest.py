"""Resumable ingestion: files of rows that arrive in a folder are added to a table once, whatever is run again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import need


def ingest_new(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: str) -> None:
    """Reads Parquet files of ``source`` that were not read before and appends the rows whose key ``target`` lacks.

    The stream's checkpoint skips files that are done; the anti-join makes a repeated batch add nothing. Of rows that
    share a key within a batch one stays; rows without a key are left out.
    """
    if key not in schema.names:
        raise ValueError(f"no column {key}; there are {', '.join(schema.names)}")

    def add(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        fresh = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            have = session.read.parquet(target)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            need(have, key)
            fresh = fresh.join(have.select(key), key, "left_anti")
        fresh.select(*schema.names).write.mode("append").parquet(target)

    rows = spark.readStream.schema(schema).parquet(source)
    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
