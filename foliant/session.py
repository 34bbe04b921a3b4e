"""Sessions and tables."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit any size: adaptive plans split skewed joins, the clock is UTC, right-hand keys win in map_concat.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def session(cpus: str | int = "*", app: str = "foliant", **more: str) -> SparkSession:
    """A local session with SETTINGS; on a cluster the submitted configuration has master and memory."""
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cpus}]")
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder; the path goes to Spark's reader as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, spark.checkpoint.dir, deleted when the program ends; in local mode without that setting
    one in the machine's temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/foliant-scratch"
    path = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def gone() -> None:
        if spark.sparkContext._jsc is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(gone)
    return path


def spread(df: DataFrame, least_bytes: int = 4 << 20) -> DataFrame:
    """df over as many partitions as there are cores, where a plain scan has fewer: a step that takes long for each row then keeps all
    cores busy, at the price of one exchange of what it reads. A scan with enough partitions, a small one, and what has been
    exchanged before stay as they are.
    """
    plan = df._jdf.queryExecution()
    if "Adaptive" in plan.executedPlan().getClass().getSimpleName() or int(str(plan.optimizedPlan().stats().sizeInBytes())) < least_bytes:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df
