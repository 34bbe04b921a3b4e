from pyspark.sql import functions as F

from foliant.session import spread


def test_spread(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(2000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("text")).coalesce(1).write.parquet(at)
    narrow = spark.read.parquet(at)
    wide = spread(narrow, least_bytes=1000)
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and wide.count() == 2000
    assert spread(narrow) is narrow  # small
    grouped = narrow.groupBy("id").count()
    assert spread(grouped, least_bytes=0) is grouped
    enough = narrow.repartition(8)
    assert spread(enough, least_bytes=0) is enough
