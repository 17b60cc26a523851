"""Session settings that the library relies on, and the shared work folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", app: str = "millrace", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests on one machine) is a new
    temporary folder set, once for the session. On a cluster such a folder
    would be out of the executors' sight, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str, compression: str = "zstd", folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (or one below it) and read it back.

    Cuts lineage durably: a lost executor costs a re-read, never a recompute.
    """
    spark = df.sparkSession
    path = f"{folder or work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, label: str):
    """A folder below the shared one, deleted at the end of the block.

    What leaves the block must be written elsewhere before.
    """
    folder = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark's cleaner deletes the shuffle files of finished steps.

    Worth its fraction of a second after a step that shuffled much and whose result is written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first numbered form of it that is no column of ``df``."""
    taken, found, k = {c.lower() for c in df.columns}, name, 0
    while found.lower() in taken:
        k += 1
        found = f"{name}_{k}"
    return found
