"""Sinks other than the batch deliverables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import _path, exists


def append_metrics(kpis: DataFrame, folder: str, seconds: float, changed: int = 0, note: str = "") -> None:
    """A row of the cycle's counts with its time."""
    kpis.select(F.current_timestamp().alias("ts"), "*", F.lit(changed).alias("changed"), F.lit(float(seconds)).alias("seconds"), F.lit(note).alias("note")).write.mode("append").parquet(folder)


def audit_lines(requests: DataFrame) -> DataFrame:
    """The audit log's lines: time, client, path and status, tab-separated. The client is the first of the
    real-ip header, the first forwarded address, and the peer."""
    client = F.coalesce(F.nullif("real_ip", F.lit("")), F.nullif(F.trim(F.split("forwarded", ",")[0]), F.lit("")), "peer")
    return requests.select(F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), client, "path", F.col("status").cast("string")).alias("value"))


def audit_stream(requests: DataFrame, folder: str, checkpoint: str):
    """Append the audit lines of a stream of requests to a folder of text files."""
    return audit_lines(requests).writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seed(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a store to a new place, unless there is one already; whether it was copied."""
    if exists(spark, target):
        return False
    (a, p), (b, q) = _path(spark, source), _path(spark, target)
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark._jsc.hadoopConfiguration())


def cached(spark: SparkSession, folder: str, compute: Callable[[], DataFrame], seconds: float, now: float | None = None) -> DataFrame:
    """An aggregate kept in a folder: computed again once it is older than ``seconds``."""
    fs, done = _path(spark, f"{folder}/_SUCCESS")
    now = time.time() if now is None else now
    if not fs.exists(done) or now - fs.getFileStatus(done).getModificationTime() / 1000 > seconds:
        compute().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
