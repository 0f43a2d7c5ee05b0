"""Small helpers the text operators share: names, words, Arrow batches, tables."""
from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

_KEEP = bytes(range(48, 58)) + bytes(range(97, 123))
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank;
#: bytes of other characters stay, so the words of a UTF-8 text are what split() gives.
WORD_TABLE = bytes(c if c >= 128 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased."""
    return text.translate(WORD_TABLE).split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: others cannot clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    have, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in have:
        name += "_"
    return name


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``fn(batch)`` for every Arrow batch of ``df``; it returns a batch or None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a text column, None for null."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def flat(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and where each row starts (n + 1 places); null is empty."""
    column = batch.column(name).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), np.zeros(len(starts), np.int64)
    return np.frombuffer(data, np.uint8, starts[-1] - starts[0], starts[0]), starts - starts[0]


def portions(batch: pa.RecordBatch, name: str = "text", limit: int = 4 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` text bytes (or one row) and ``rows`` rows, to bound scratch memory."""
    _, starts = flat(batch, name)
    row = 0
    while row < batch.num_rows:
        upto = min(row + rows, max(row + 1, int(np.searchsorted(starts, starts[row] + limit, "right")) - 1))
        yield batch.slice(row, upto - row)
        row = upto


def give_back() -> None:
    """Freed memory returns to the system: a reused worker would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def held_out(column) -> F.Column:
    """Rows no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def id_order(column, key: str) -> list:
    """Sort keys that put null ids first and settle equal ids by ``key``."""
    return [F.col(column).asc_nulls_first(), F.col(key)]
