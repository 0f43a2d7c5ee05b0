"""Token-ID output: Arrow files of fixed-size-list batches with zero-copy random access.

Each part is one Arrow IPC file of equal-length sequences.  Column ``ids`` is a
fixed-size list of ``seq_len`` ids (16 bits where the vocabulary fits), column ``mask``
a fixed-size list of booleans, false only on the padding of a part's last sequence.
Every batch but the last holds ``batch_seqs`` sequences, so sequence ``i`` lies in batch
``i // batch_seqs`` at a fixed offset: a mapped file gives it without a copy.  A second
file, ``docs``, says where each document starts.  Parts follow the order of doc_id.

A task writes under a name of its own attempt and renames at its end, so a lost
executor or a second attempt leaves the same complete file.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_folder, id_order, pick
from .tokens import default_path, encoder

MANIFEST = "part int, n_docs long, n_tokens long"


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI (file, hdfs, s3, gs) or an absolute path."""
    return pafs.FileSystem.from_uri(folder)


def part_path(root: str, part: int, what: str) -> str:
    return f"{root}/part-{part:06d}.{what}.arrow"


class _Sequences:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, dtype, seq_len: int, batch_seqs: int):
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.kind, self.seq_len, self.room = kind, seq_len, seq_len * batch_seqs
        self.dtype, self.waiting, self.held = dtype, [], 0
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.room:
            flat = np.concatenate(self.waiting)
            for at in range(0, len(flat) - self.room + 1, self.room):
                self._write(flat[at:at + self.room], self.room)
            rest = flat[len(flat) - len(flat) % self.room:].copy()
            self.waiting, self.held = [rest], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        n = len(ids) // self.seq_len
        mask = np.arange(len(ids)) < real
        self.out.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.seq_len),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))
        assert n * self.seq_len == len(ids)

    def close(self) -> None:
        if self.held:
            ids = np.zeros(-(-self.held // self.seq_len) * self.seq_len, self.dtype)
            ids[:self.held] = np.concatenate(self.waiting)
            self._write(ids, self.held)
        self.out.close()


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, end_id: int = 2, seq_len: int = 2048,
                      batch_seqs: int = 128) -> DataFrame:
    """Write the ids of all texts in ascending id order; returns the manifest, one row a part.

    Null texts count as empty and give only ``end_id``; null ids come first; rows of equal
    id follow each other in the order of their texts; other columns are ignored.
    """
    path, root_uri = tokenizer or default_path(), folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, code = TaskContext.get(), encoder(path)
        fs, root = store(root_uri)
        fs.create_dir(root, recursive=True)
        part, tag = task.partitionId(), uuid.uuid4().hex
        names = {w: part_path(root, part, w) for w in ("ids", "docs")}
        place, docs_schema = 0, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = 0
        with fs.open_output_stream(f"{names['ids']}.{tag}") as a, fs.open_output_stream(f"{names['docs']}.{tag}") as b:
            seqs, docs = _Sequences(a, code.dtype, seq_len, batch_seqs), pa.ipc.new_file(b, docs_schema)
            end = np.array([end_id], code.dtype)
            for batch in batches:
                lengths = np.zeros(batch.num_rows, np.int64)
                for at in range(0, batch.num_rows, 500):
                    for i, ids in enumerate(code.encode(batch.column("text").slice(at, 500).to_pylist())):
                        seqs.add(ids)
                        seqs.add(end)
                        lengths[at + i] = len(ids) + 1
                starts = place + np.cumsum(lengths) - lengths
                place += int(lengths.sum())
                n_docs += batch.num_rows
                docs.write_batch(pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(lengths)], schema=docs_schema))
            seqs.close()
            docs.close()
        for name in names.values():
            fs.move(f"{name}.{tag}", name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()),
                                          "n_tokens": pa.array([place], pa.int64())})

    rows = pick(df, doc_id=id_col, text=text_col)
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*id_order("doc_id", "text"))
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return df.sparkSession.read.schema(MANIFEST).parquet(manifest)


class TokenFile:
    """Random access to one part: ``ids(start, n)``, and ``sequence(i)`` as zero-copy views."""

    def __init__(self, fs, root: str, part: int):
        name = part_path(root, part, "ids")
        source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        self.file = pa.ipc.open_file(source)
        kind = self.file.schema.field("ids").type
        self.seq_len, self.dtype = kind.list_size, np.dtype(kind.value_type.to_pandas_dtype())
        self.first = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.views: dict[int, np.ndarray] = {}

    def _batch(self, k: int) -> np.ndarray:
        if k not in self.views:
            self.views = {k: np.asarray(self.file.get_batch(k).column("ids").flatten())}
        return self.views[k]

    def sequence(self, i: int) -> np.ndarray:
        at = i % self.first * self.seq_len
        return self._batch(i // self.first)[at:at + self.seq_len]

    def mask(self, i: int) -> np.ndarray:
        column = self.file.get_batch(i // self.first).column("mask")
        return column[i % self.first].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        room, found = self.first * self.seq_len, []
        while n > 0:
            k, at = divmod(start, room)
            got = self._batch(k)[at:at + n]
            found.append(got)
            start, n = start + len(got), n - len(got)
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, self.dtype)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (over all parts), n_tokens, ids_crc32."""
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for batch in batches:
            for part, before in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist()):
                tokens = TokenFile(fs, root, part)
                with fs.open_input_file(part_path(root, part, "docs")) as source:
                    docs = pa.ipc.open_file(source)
                    for k in range(docs.num_record_batches):
                        d = docs.get_batch(k)
                        starts, lengths = d.column("start").to_numpy(), d.column("n_tokens").to_numpy()
                        crc = [zlib.crc32(tokens.ids(a, n).astype("<u4").tobytes()) for a, n in zip(starts.tolist(), lengths.tolist())]
                        yield pa.RecordBatch.from_pydict({"doc_id": d.column("doc_id"), "start": pa.array(starts + before),
                                                          "n_tokens": d.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    # one row a file: the running sum over files is small at any size
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.withColumn("before", before).where("n_docs > 0")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartitionByRange(n, "part").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(df: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the files to ``folder`` (default: a new shared one) and return what they hold per document."""
    folder = folder or fresh_folder(df.sparkSession, "tokens")
    return read_token_files(write_token_files(df, folder, **options), folder)
