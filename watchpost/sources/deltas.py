"""Keyed tables that merge on read: a batch writes its own rows and rewrites nothing.

Under a table's folder, ``deltas/batch_no=N`` holds what batch N brought, ``base/bucket=B/gen=G``
the merged rows of a bucket of keys as of batch G, and ``marks`` which generation of a bucket
counts.  Readers take the newest generation of each bucket and the deltas after the last
compaction; of all rows of a key the newest version counts.  A compaction rewrites only
buckets that deltas touch.  A batch or compaction that runs again writes the same folders, and
a compaction counts only once its marks are written, so a lost job leaves nothing half done.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .sinks import exists, merge_latest

BUCKETS = 64


def _bucket(keys: Sequence[str], buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_delta(path: str, incoming: DataFrame, batch_no: int) -> None:
    """Store the rows of one batch; an empty batch stores nothing."""
    incoming.write.mode("overwrite").parquet(f"{path}/deltas/batch_no={batch_no:012d}")


def _marks(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """bucket and its newest gen (a row a bucket, so of fixed size), and the last batch they hold."""
    if not exists(spark, f"{path}/marks"):
        return None, -1
    marks = spark.read.parquet(f"{path}/marks")
    upto = marks.agg(F.max("upto")).first()[0]
    return marks.groupBy("bucket").agg(F.max("gen").alias("gen")), -1 if upto is None else upto


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of the base and of the deltas that count, the first with their bucket."""
    live, upto = _marks(spark, path)
    base = None if live is None else spark.read.parquet(f"{path}/base").join(F.broadcast(live), ["bucket", "gen"]).drop("gen")
    deltas = spark.read.parquet(f"{path}/deltas").where(F.col("batch_no") > upto).drop("batch_no") if exists(spark, f"{path}/deltas") else None
    return base, deltas


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], version: str) -> DataFrame | None:
    """One row per key, that of the newest version; None where nothing was stored yet."""
    base, deltas = _parts(spark, path)
    base = None if base is None else base.drop("bucket")
    if base is None or deltas is None:
        only = deltas if base is None else base
        return None if only is None else merge_latest(only.limit(0), only, keys, version)
    return merge_latest(base, deltas, keys, version)


def read_keys(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str], version: str, buckets: int = BUCKETS) -> DataFrame | None:
    """The newest row of each of the ``wanted`` keys; of the base only their buckets are read."""
    base, deltas = _parts(spark, path)
    own = cut(wanted.select(*keys).distinct())
    if base is not None:
        touched = own.select(_bucket(keys, buckets).alias("bucket")).distinct()  # at most ``buckets`` rows
        base = base.join(F.broadcast(touched), "bucket", "left_semi").drop("bucket").join(own, list(keys), "left_semi")
    deltas = None if deltas is None else deltas.join(own, list(keys), "left_semi")
    if base is None or deltas is None:
        only = deltas if base is None else base
        return None if only is None else merge_latest(only.limit(0), only, keys, version)
    return merge_latest(base, deltas, keys, version)


def compact(spark: SparkSession, path: str, keys: Sequence[str], version: str, upto: int, buckets: int = BUCKETS) -> None:
    """Fold the deltas up to batch ``upto`` into the buckets they touch."""
    base, deltas = _parts(spark, path)
    if deltas is None:
        return
    live, before = _marks(spark, path)
    fresh = spark.read.parquet(f"{path}/deltas").where(F.col("batch_no").between(before + 1, upto)).drop("batch_no").withColumn("bucket", _bucket(keys, buckets))
    touched = cut(fresh.select("bucket").distinct())
    old = fresh.limit(0) if base is None else base.join(F.broadcast(touched), "bucket", "left_semi")
    merged = merge_latest(old, fresh, [*keys, "bucket"], version).withColumn("gen", F.lit(upto).cast("long"))
    # a bucket may be split over tasks: what matters is that it is read by itself
    merged.repartition("bucket", F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(8))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket", "gen").parquet(f"{path}/base")
    touched.select("bucket", F.lit(upto).cast("long").alias("gen"), F.lit(upto).cast("long").alias("upto")).coalesce(1).write.mode("append").parquet(f"{path}/marks")
