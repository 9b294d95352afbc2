"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidewatch", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEWATCH_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with the machine, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tidewatch-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Bytecode of a method beyond which HotSpot only interprets it.
COMPILED_BYTES = "8000"


def compiled(spark: SparkSession) -> None:
    """Have wide steps split up rather than generated as one method too large to be compiled, where the session has no choice of its own."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)


def stage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that several passes read (quantiles, fits): computed once,
    columnar, and still there when executors are lost. With ``release`` the driver
    collects its garbage then, upon which Spark deletes the shuffle files of the steps
    before: a query of several large steps needs the disk of one at a time.
    """
    compiled(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if release:
        release_shuffles(out.sparkSession)
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that no frame at hand can read again."""
    gc.collect()
    spark._jvm.System.gc()

