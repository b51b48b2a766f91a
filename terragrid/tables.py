"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on one machine, where none is named, a folder made here."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("terragrid.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="terragrid-shared-")
        spark.conf.set("terragrid.shared.dir", named)
    return named.rstrip("/")


def settle(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` and read it back: loops have plans of one round, and lost executors cost no earlier round."""
    path = f"{shared_dir(df.sparkSession)}/terragrid/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
