"""The stack's sums on a stream: they are a commutative monoid, so update mode suffices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Grid
from ..operators.stack import merge_sums, source_sums


def stream_sums(points: DataFrame, grid: Grid) -> DataFrame:
    """Running sums of a streaming DataFrame of points (output mode update or complete)."""
    return source_sums(points, grid)


def windowed_counts(events: DataFrame, ts: str, key: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window; data later than ``late`` is dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def _numbers(spark, path: str) -> list[int]:
    """The n of folders n=... below a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(n.removeprefix("n=")) for n in names)


def _delete(spark, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_sums(spark, path: str) -> DataFrame:
    """The sums so far: the last base and the batches after it."""
    base = _numbers(spark, f"{path}/base")[-1:]
    parts = [f"{path}/base/n={n}" for n in base] + [f"{path}/delta/n={n}" for n in _numbers(spark, f"{path}/delta") if not base or n > base[0]]
    return merge_sums(*(spark.read.parquet(p) for p in parts))


def compact_sums(spark, path: str, n: int) -> None:
    """Put all batches up to ``n`` into a new base; what it replaces goes once it is whole."""
    read_sums(spark, path).write.mode("overwrite").parquet(f"{path}/base/n={n}")
    for kind in ("base", "delta"):
        for old in _numbers(spark, f"{path}/{kind}"):
            if old < n or (kind == "delta" and old == n):
                _delete(spark, f"{path}/{kind}/n={old}")


def keep_sums(points: DataFrame, grid: Grid, path: str, checkpoint: str, compact: int = 16, **trigger):
    """Starts a query that writes each batch's sums below ``path``, and a new base every ``compact`` batches.

    A batch that runs again overwrites its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n in _numbers(spark, f"{path}/base")[-1:]:
            return
        source_sums(batch, grid).write.mode("overwrite").parquet(f"{path}/delta/n={n}")
        if n % compact == compact - 1:
            compact_sums(spark, path, n)

    query = points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(**trigger) if trigger else query).start()
