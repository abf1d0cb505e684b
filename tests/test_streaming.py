import pytest
from pyspark.sql import functions as F

from tessera import streaming
from tessera.sources.literal import TableBuilder, of


def test_stream_takes_each_row_once(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    for lot in range(2):
        spark.range(lot * 5, lot * 5 + 5).select("id", F.timestamp_seconds(F.col("id") * 60).alias("at")).write.mode("append").parquet(source)
        stream = streaming.table(spark, source, spark.read.parquet(source).schema)
        streaming.run_available(stream.filter("id % 2 = 0"), out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8]
    rows = spark.read.parquet(source)
    got = streaming.windowed(rows, "at", "5 minutes", "1 minute", n=F.count(F.lit(1)))
    assert [r.n for r in got.orderBy("start").collect()] == [5, 5]


def test_literals(spark):
    built = TableBuilder("a", "b").row(1, "x").row(2.5, None).build(spark)
    assert built.dtypes == [("a", "double"), ("b", "string")] and built.count() == 2
    for bad in (lambda: TableBuilder("a").row(1, 2), lambda: TableBuilder("a").row(1).columns("b"), lambda: of(spark, [None], "a int")):
        with pytest.raises(ValueError):
            bad()
