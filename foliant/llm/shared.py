"""Tables that operators write between their steps, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

#: White space of the corpus contracts, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"

_made: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, which is for local mode only, one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/foliant-shared"
    return found.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; release() or the end of the program deletes it."""
    if not _made:
        atexit.register(release)
    path = f"{shared_dir(spark)}/foliant-{name}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file, complete or not there at all."""
    jvm = spark._jvm
    to, by = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(by, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(by, to):
        raise OSError(f"{path} can't be written")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    source = files.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def created() -> list[str]:
    """The workspaces that release() will delete."""
    return list(_made)


def named(spark: SparkSession, table: str) -> str:
    """table, which release() is to take out of the catalog."""
    _tables[table] = spark
    return table


def release() -> None:
    """Deletes all that operators have written so far. DataFrames that they returned can't be used after it."""
    for table, spark in list(_tables.items()):
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        del _tables[table]
    for path, spark in list(_made.items()):
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
        del _made[path]


def written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """df as a Parquet table at path, read back: a lost executor costs no more than the task that it ran."""
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes, as columns h1 and h2."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(0x5BD1E995), *cols).alias("h2")]


def column(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def placed(order: str = "order", *more: str) -> Column:
    """A struct that sorts as order does, null after all others, and then as `more` do."""
    return F.struct(F.col(order).isNull().alias("none"), order, *more)


def batches(ids: DataFrame, name: str, n: int, sample: int = 1000) -> list:
    """Upper bounds, without the last, that cut the values of a column into at most n ranges of about the same number of rows. Values
    may be of any type that can be sorted; nulls have a say in no bound. Of values other than integers about `sample`, picked by
    their hashes, tell the bounds, which balance the ranges and have no say in what comes out."""
    if n <= 1:
        return []
    if isinstance(ids.schema[name].dataType, IntegralType):
        return sorted(set(ids.agg(F.percentile_approx(name, [i / n for i in range(1, n)], 1000)).first()[0] or []))
    some = ids.where(F.col(name).isNotNull())
    share = min(1.0, sample / max(1, some.count()))
    values = sorted(r[0] for r in some.where(F.pmod(F.xxhash64(name), F.lit(1 << 40)) < int(share * (1 << 40))).select(name).distinct().collect())
    return sorted({values[i * len(values) // n] for i in range(1, n)}) if values else []


def batch_of(value: Column, cuts: list) -> Column:
    """The number of the range from batches() that a value lies in; null is in the last."""
    return sum((F.coalesce(value > F.lit(c), F.lit(True)).cast("int") for c in cuts), F.lit(0))


def map_arrow(df: DataFrame, run, schema: str | StructType, most: str = "16m") -> DataFrame:
    """mapInArrow with batches of bounded bytes: by rows alone, 10,000 long texts could be one batch. A setting of the session's own stays."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    return df.mapInArrow(run, schema)
