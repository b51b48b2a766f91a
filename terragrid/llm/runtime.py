"""Shared-folder tables and small helpers for the operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) is one made here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("terragrid.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="terragrid-shared-")
        spark.conf.set("terragrid.shared.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/terragrid/{what}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of a few megabytes while a job runs, so that executors hold little beside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame, what: str = "table", row_group: int = 128 << 20) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: what reads it survives the loss of any executor, and two
    readers see the same rows even if the input order is not repeatable.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    with small_batches(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", row_group).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more: what was made of them is written itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(table._folder)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def fan(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts; one scan, one number."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even if body names it often."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
