"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quireflow-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It cuts the lineage and lets several consumers use one evaluation; the files outlive any executor.
    They go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quireflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which finished shuffles nothing refers to any more, so that their files go.

    Called after the few exchanges that are as large as the input.
    """
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(spark: SparkSession, table: str) -> None:
    """Drop a table of the shared folder and its files."""
    with contextlib.suppress(Exception):
        spark.sql(f"drop table if exists {table}")
    remove(spark, f"{shared_dir(spark)}/{table}")


def remove_table(spark: SparkSession, table: str) -> None:
    """Drop a table of the shared folder, and its files, when the application ends."""
    atexit.register(drop, spark, table)


def fresh(columns: list[str], name: str) -> str:
    """``name``, or that with underscores in front until it is none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, even where ``use`` needs it inside lambdas."""
    return F.transform(F.array(value), use)[0]
