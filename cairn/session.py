"""Session settings and table access shared by every module."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def session(name: str = "cairn", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores. Rows that compress well lie in a few row groups, each read by one task, whatever is computed from them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(2 * cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only where the session has
    none and runs in one local JVM (tests, the benchmark) is a temporary folder set as checkpoint folder."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "cairn-checkpoints"))
    return spark.sparkContext.getCheckpointDir()


_made: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: cuts the lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _made.append(file.get())
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: what ``cut`` does, for rows that compress well."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of checkpoints, for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int) -> None:
    """Delete the checkpoints and stored tables made since ``mark()``; what was computed from them must be written by now."""
    for path in _made[since:]:
        delete(spark, path)
    del _made[since:]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob of any file system that the session knows has a match."""
    fs, p = _path(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def bounded(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows of ``row_bytes`` fit ``limit``, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster on which it isn't installed."""
    import shutil
    from pathlib import Path

    import cairn

    root = Path(cairn.__file__).parent.parent
    base = os.path.join(tempfile.mkdtemp(), "cairn")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "cairn"))
