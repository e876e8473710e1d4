"""Tables that cut lineage: written to the folder the cluster shares, read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="skein-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def settled(df: DataFrame) -> DataFrame:
    """df, written and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *columns: str, size: int = 4 << 20) -> DataFrame:
    """df by the columns in partitions of about `size` bytes of what Spark takes it to have, so that a task's share doesn't grow with it."""
    spark = df.sparkSession
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of tables from memory Spark says 2^63
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(known // size + 1, 10_000) if known < 1 << 50 else 0), *columns)
