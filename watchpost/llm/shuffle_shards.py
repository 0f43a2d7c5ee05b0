"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash.  Pass two
loads one bucket at a time, puts it in a fixed order, shuffles it (Fisher-Yates, seeded by
the bucket) and writes it.  The buckets one after another are a uniform permutation of all
rows; shard ``s`` of ``n`` takes the places from ceil(s * rows / n), so counts differ by at
most one (law ``rows``).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_folder, pick

#: Bucket tables up to this many rows (16 bytes each) are broadcast, larger ones are joined.
BROADCAST_BUCKETS = 200_000


def _shuffled(table: pa.Table, seed: int) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    order = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(table.num_rows)
    return table.take(pa.array(order)).append_column("at", pa.array(np.arange(table.num_rows, dtype=np.int64)))


def shuffle_to_shards(df: DataFrame, folder: str, n_shards: int = 16, seed: int = 2024, bucket_bytes: int = 16 << 20,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``doc_id, text, shard, slot`` as Parquet, one folder a shard, and return it as a DataFrame.

    Buckets hold about ``bucket_bytes`` of text.  Null ids and texts are kept as they are;
    rows of equal id share a bucket and are told apart by their texts.  Other columns are ignored.
    """
    spark = df.sparkSession
    rows = pick(df, doc_id=id_col, text=text_col)
    total, volume = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(4 * at_once, -(-volume // bucket_bytes))
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(n_buckets)))
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # a row a bucket: the running sum is small against the data
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select("bucket", before.alias("before"))
    if n_buckets <= BROADCAST_BUCKETS:
        places = F.broadcast(places)
    scattered = (bucketed.join(places, "bucket").repartition(max(at_once, min(n_buckets, 8 * at_once)), "bucket")
                 .sortWithinPartitions("bucket", "doc_id", "text"))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _shuffled(pa.Table.from_batches(held), seed).combine_chunks().to_batches()
                held.clear()
        for batch in batches:
            ids = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and held[-1].column("bucket")[0].as_py() != int(ids[a]):
                    yield from give()
                held.append(batch.slice(a, b - a))
        yield from give()

    shuffled = scattered.mapInArrow(second_pass, "bucket long, doc_id long, text string, before long, at long")
    place = F.col("before") + F.col("at")
    shard = F.expr(f"CAST((before + at) * {n_shards} DIV {max(total, 1)} AS INT)")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) DIV {n_shards}L")
    out = (shuffled.withColumn("shard", shard).withColumn("slot", place - first).select("doc_id", "text", "slot", "shard"))
    out.write.partitionBy("shard").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)


def shard_rows(df: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Shards written and read back: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    written = shuffle_to_shards(df, folder or fresh_folder(df.sparkSession, "shards"), **options)
    text = F.coalesce(F.col("text"), F.lit(""))
    return written.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
                          F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))
