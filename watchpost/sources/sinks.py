"""Keyed upserts, append logs and report outputs on Parquet."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def merge_latest(base: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Insert or replace by key: of all rows of a key the newest ``version`` stays."""
    both = base.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*").select(*both.columns)


def merge_additive(base: DataFrame, increment: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """``amount = amount + x`` upsert."""
    return base.unionByName(increment).groupBy(*keys).agg(F.sum(amount).alias(amount))


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def upsert(path: str, incoming: DataFrame, keys: Sequence[str], version: str, partition_by: Sequence[str]) -> None:
    """Merge ``incoming`` into a partitioned Parquet table.

    Only partitions the batch touches are read and rewritten; a key must not
    change partition.  The merged rows are cut first, so the table is never read
    by the job that overwrites it, and a retried batch gives the same table.
    """
    spark = incoming.sparkSession
    if exists(spark, path):
        touched = incoming.select(*partition_by).distinct()
        old = spark.read.parquet(path).join(touched, list(partition_by), "left_semi")
        incoming = merge_latest(old, incoming, keys, version)
    else:
        incoming = merge_latest(incoming.limit(0), incoming, keys, version)
    merged = cut(incoming)
    if merged.isEmpty():
        return
    (merged.repartition(*partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def append_audit(path: str, actor: str, action: str, rows: DataFrame) -> None:
    """Append-only audit log; ``rows`` has ``at_us`` and ``detail``."""
    rows.select("at_us", F.lit(actor).alias("actor"), F.lit(action).alias("action"), "detail").write.mode("append").parquet(path)


def list_audit(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("at_us")).limit(limit)


def evidence_dir(ts, camera_id, event_id) -> Column:
    """``YYYY/MM/DD/camera/event`` of a package."""
    return F.concat_ws("/", F.date_format(ts, "yyyy/MM/dd"), camera_id, event_id.cast("string"))


def write_evidence_index(rows: DataFrame, path: str) -> None:
    """Evidence rows laid out by day and camera."""
    rows.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date", "camera_id").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Evaluation rows as Parquet and as JSON lines."""
    out = cut(metrics)
    out.write.mode("overwrite").parquet(f"{path}/parquet")
    out.write.mode("overwrite").json(f"{path}/json")
