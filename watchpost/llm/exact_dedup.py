"""Exact deduplication with Patricia-trie owners.

Texts are dealt to owner partitions by length and content hash.  An owner inserts whole
byte strings into a compressed radix trie (one per length), whose terminal nodes keep the
id to stay, the number of rows and how many of them have that id.

Before the shuffle every task builds tries of its own rows, so a text that a third of all
rows share reaches its owner once per task.  A task trie over its budget gives up its
largest subtree as partial rows, which the owner merges.  Owners read their rows in the
order of length and text (Spark's sort spills), so everything off the current path is
complete and leaves the trie subtree by subtree: the budget bounds memory, not the data.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, pick, texts

PARTIAL = "text binary, n_bytes long, h long, keep_id long, rows long, ties long"
OWNED = "n_bytes long, text_sha256 string, keep_id long, group_size long, ties long"


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if b.startswith(a[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    __slots__ = ("label", "below", "end")

    def __init__(self, label: bytes, end=None):
        self.label, self.below, self.end = label, {}, end


class PatriciaTrie:
    """Compressed radix trie over byte strings; ``merge`` folds the values of equal strings."""

    def __init__(self, merge):
        self.root, self.merge, self.size = _Node(b""), merge, 0

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                node.below[key[at]] = _Node(key[at:], value)
                self.size += len(key) - at + 300
                return
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _shared(child.label, key, at)
            fork = _Node(child.label[:n])
            node.below[key[at]] = fork
            child.label = child.label[n:]
            fork.below[child.label[0]] = child
            self.size += 300
            node, at = fork, at + n
        node.end = value if node.end is None else self.merge(node.end, value)

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.end is not None:
                yield key, node.end
            stack.extend((child, key) for child in node.below.values())

    @staticmethod
    def _weight(node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + 300
            stack.extend(x.below.values())
        return total

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All strings; the trie is empty afterwards."""
        root, self.root, self.size = self.root, _Node(b""), 0
        yield from self._walk(root, b"")

    def spill_largest(self) -> Iterator[tuple[bytes, object]]:
        """Give up the largest subtree below the first fork."""
        parent, prefix = self.root, b""
        while len(parent.below) == 1 and parent.end is None and next(iter(parent.below.values())).below:
            parent = next(iter(parent.below.values()))
            prefix += parent.label
        first, child = max(parent.below.items(), key=lambda x: self._weight(x[1]))
        del parent.below[first]
        self.size -= self._weight(child)
        yield from self._walk(child, prefix)

    def spill_off_path(self, key: bytes) -> Iterator[tuple[bytes, object]]:
        """Give up every subtree that does not lead to ``key``."""
        node, at, prefix = self.root, 0, b""
        while node is not None:
            on = node.below.get(key[at]) if at < len(key) else None
            if on is not None and not key.startswith(on.label, at):
                on = None
            for first in [f for f, child in node.below.items() if child is not on]:
                child = node.below.pop(first)
                self.size -= self._weight(child)
                yield from self._walk(child, prefix)
            if on is None:
                return
            prefix, at, node = prefix + on.label, at + len(on.label), on


def _keep(largest: bool):
    def merge(a, b):
        (x, n, t), (y, m, u) = a, b
        if x == y:
            return x, n + m, t + u
        if y is None or (x is not None and (x > y) == largest):
            return x, n + m, t
        return y, n + m, u
    return merge


def _partial(found: list) -> pa.RecordBatch:
    keys = [k for k, _ in found]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array([len(k) for k in keys], pa.int64()),
         pa.array([int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little", signed=True) for k in keys], pa.int64()),
         *[pa.array([v[i] for _, v in found], pa.int64()) for i in range(3)]],
        names=["text", "n_bytes", "h", "keep_id", "rows", "ties"])


def _owned(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([len(k) for k, _ in found], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in found], pa.string()),
         *[pa.array([v[i] for _, v in found], pa.int64()) for i in range(3)]],
        names=["n_bytes", "text_sha256", "keep_id", "group_size", "ties"])


def _in_batches(items, make, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item[0]) + 100
        if size >= limit:
            yield make(held)
            held, size = [], 0
    if held:
        yield make(held)


def owners(df: DataFrame, keep: str = "smallest", budget_bytes: int = 48 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different text: n_bytes, text_sha256, keep_id, group_size, ties (rows that have keep_id).

    Null texts count as empty.  A null id stays only where no row of the group has one.
    """
    merge = _keep(keep == "largest")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(merge)
        for batch in batches:
            for ident, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                trie.insert(text or b"", (ident, 1, 1))
                if trie.size > budget_bytes:
                    yield from _in_batches(trie.spill_largest(), _partial)
        yield from _in_batches(trie.items(), _partial)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, length = PatriciaTrie(merge), -1

        def rows() -> Iterator[tuple[bytes, tuple]]:
            nonlocal length
            for batch in batches:
                for key, n, *value in zip(*(batch.column(c).to_pylist() for c in ("text", "n_bytes", "keep_id", "rows", "ties"))):
                    if n != length:
                        yield from trie.items()
                        length = n
                    trie.insert(key, tuple(value))
                    if trie.size > budget_bytes:
                        yield from trie.spill_off_path(key)
            yield from trie.items()
        yield from _in_batches(rows(), _owned)

    rows = pick(df, doc_id=id_col, text=text_col)
    dealt = rows.mapInArrow(local, PARTIAL).repartition("n_bytes", "h").sortWithinPartitions("n_bytes", "text")
    return dealt.mapInArrow(own, OWNED)


def exact_groups(df: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest (``keep="largest"``: largest) id stays; of rows
    equal in id too, one.  An empty table gives an empty result.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    found = rows.join(owners(df, keep, id_col=id_col, text_col=text_col, **options), ["n_bytes", "text_sha256"])
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    one = F.row_number().over(Window.partitionBy("n_bytes", "text_sha256", "doc_id").orderBy(F.lit(1))) == 1
    tied = stays & (F.col("ties") > 1)
    marked = found.where(~tied).withColumn("kept", stays).unionByName(found.where(tied).withColumn("kept", one))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(df: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay, one for each different text, with all their columns.

    Null texts count as empty; a null id stays only where its group has no other; of rows
    equal in id and text any one stays.  An empty table gives an empty one.  Columns of any
    name pass through.
    """
    n_bytes, digest, ident, ties = (free_name(df, c) for c in ("n_bytes", "sha256", "keep_id", "ties"))
    own = owners(df, keep, id_col=id_col, text_col=text_col, **options).select(
        F.col("n_bytes").alias(n_bytes), F.col("text_sha256").alias(digest), F.col("keep_id").alias(ident), F.col("ties").alias(ties))
    text = F.coalesce(df[text_col], F.lit(""))
    same = (F.octet_length(text).cast("long") == own[n_bytes]) & (F.sha2(text.cast("binary"), 256) == own[digest]) & df[id_col].eqNullSafe(own[ident])
    found = df.join(own, same)
    once = found.where(F.col(ties) > 1).dropDuplicates([n_bytes, digest])
    return found.where(F.col(ties) == 1).unionByName(once).select(*[F.col(f"`{c}`") for c in df.columns])
