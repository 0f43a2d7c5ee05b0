"""Session helpers: a tuned local session, UTC pinning and lineage cuts."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "watchpost") -> SparkSession:
    """A session for tests and the bench.  On a cluster, pass your own instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WATCHPOST_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.worker.reuse", "true")
        .getOrCreate()
    )


def pin_utc(spark: SparkSession) -> SparkSession:
    """Event time is UTC throughout; patrol rosters convert explicitly."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def timers(spark: SparkSession) -> None:
    """State with timers, time to live or an initial state needs a store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def shared_folder(spark: SparkSession) -> str:
    """Folder for cut lineage: the cluster's ``spark.checkpoint.dir`` when it names
    one.  Only a local session (tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared:
        return shared
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="watchpost-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    Used where a table feeds several branches and between the rounds of iterative
    operators, so a lost executor costs one re-read and never a replay of earlier
    work.  A written table is computed once (a checkpoint computes twice) and has
    sizes the optimizer can plan joins with.  ``by`` lays it out in a folder per value.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
