"""Session factory and the shared scratch tables that cut lineage."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "sedimenta") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    os.environ.setdefault("TZ", "UTC")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SEDIMENTA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests, a laptop) a
    temporary folder is made; executors on other machines would write to their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            return jvm.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sedimenta-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame, name: str = "t", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, not a recomputation.
    ``codec``: how it is compressed, if not as the session says.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_at = path
    return back


def unsettle(*settled: DataFrame) -> None:
    """Remove the files of settled tables that no plan will read any more; other DataFrames are left alone."""
    for df in settled:
        path = getattr(df, "_settled_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A digest of the files of a table: their paths, lengths and times of change. What is derived from the table and stored under it is never stale."""
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    told = []
    for f in sorted(table(spark, sf_dir, name).inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))
        s = at.getFileSystem(hadoop).getFileStatus(at)
        told.append(f"{f}:{s.getLen()}:{s.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:16]
