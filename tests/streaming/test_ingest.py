import pytest
from pyspark.sql import types as T

from cytolake.streaming.ingest import ingest_new

SCHEMA = T.StructType([T.StructField("run", T.StringType()), T.StructField("size", T.LongType())])


def test_rows_are_added_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        ingest_new(spark, source, SCHEMA, target, str(tmp_path / checkpoint), "run")
        return sorted(tuple(r) for r in spark.read.parquet(target).collect())

    put([("a", 1), ("a", 1), (None, 5)])
    assert run("c") == [("a", 1)]
    put([("a", 1), ("b", 2)])
    assert run("c") == [("a", 1), ("b", 2)]
    assert run("c") == run("fresh checkpoint") == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        ingest_new(spark, source, SCHEMA, target, str(tmp_path / "c"), "none")
