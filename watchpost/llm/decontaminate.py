"""Benchmark decontamination by suffix arrays of the training text.

Every Arrow batch of documents is one shard.  Its words become numbers in the benchmark's
own vocabulary (a word that no item has breaks every match), and the suffixes that lie in
a run of known words as long as the shortest window are sorted into a suffix array by
prefix doubling.  All benchmark suffixes are then binary-searched in the shard at once:
the interval of an item's window gives every document position where it stands, and each
match is followed to its full length.  A shard needs nothing from other shards, so there
is no shuffle and a lost executor costs its own shards only.

The benchmark is a query set: it is met in blocks of at most ``block_bytes`` of text, one
pass over the documents each, so what a task holds never grows with it.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, portions, texts, words

_STATE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.BinaryType()),
                       T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
                       T.StructField("longest", T.LongType()), T.StructField("longest_at", T.LongType()),
                       T.StructField("longest_item", T.StringType())])
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.binary()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())),
                    ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string())])


class Items:
    """A block of benchmark items as numbers: one array of all words, each item ended by -2."""

    def __init__(self, rows: list[tuple[str | None, bytes | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        flat, starts, sizes, owner, self.ids = [], [], [], [], []
        for ident, text in rows:
            own = words(text or b"")
            if not own:
                continue
            k, at = len(self.ids), len(flat)
            self.ids.append(ident)
            size = min(n, len(own))
            for i in range(len(own) - size + 1):
                starts.append(at + i)
                sizes.append(size)
                owner.append(k)
            flat.extend(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own)
            flat.append(-2)
        self.flat = np.array(flat + [-2], np.int64)
        self.starts, self.sizes, self.owner = (np.array(x, np.int64) for x in (starts, sizes, owner))
        self.shortest = int(self.sizes.min()) if len(starts) else 0


def suffix_array(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts of the suffixes within runs (ids >= 0) of at least ``shortest`` words; where runs end."""
    known = np.concatenate([[False], ids >= 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    first, last = edge[::2], edge[1::2]
    long = last - first >= shortest
    first, last = first[long], last[long]
    end = np.zeros(len(ids) + 1, np.int64)
    if not len(first):
        return np.zeros(0, np.int64), end
    size = last - first
    suffixes = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    end[suffixes] = np.repeat(last, size)
    rank = np.zeros(len(ids) + 1, np.int64)
    rank[suffixes] = ids[suffixes] + 1
    width, longest = 1, int(size.max())
    order = suffixes[np.argsort(rank[suffixes], kind="stable")]
    while width < longest:
        after = np.minimum(order + width, len(ids))
        second = np.where(after < end[order], rank[after], 0)
        one, spread = rank[order], int(second.max()) + 1
        key = one * spread + second
        again = np.argsort(key, kind="stable")
        order, key = order[again], key[again]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order] = np.cumsum(fresh)
        if fresh.all():
            break
        width *= 2
    return order, end


def _search(ids, order, end, test, starts, sizes, upper: bool) -> np.ndarray:
    """Binary search of ``test[start:start + size]`` for all starts at once: the first suffix that is
    not smaller, or (``upper``) the first that is larger and does not begin with it."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    while (busy := np.flatnonzero(low < high)).size:
        mid = (low[busy] + high[busy]) // 2
        at, want, size = order[mid], starts[busy], sizes[busy]
        stop = end[at]
        right = np.full(len(busy), upper)  # equal so far
        open_, depth = np.arange(len(busy)), 0
        while open_.size:
            open_ = open_[depth < size[open_]]
            p = at[open_] + depth
            here = np.where(p < stop[open_], ids[np.minimum(p, len(ids) - 1)], -1)
            there = test[want[open_] + depth]
            right[open_[here != there]] = (here < there)[here != there]
            open_ = open_[here == there]
            depth += 1
        low[busy] = np.where(right, mid + 1, low[busy])
        high[busy] = np.where(right, high[busy], mid)
    return low


def _expand(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which interval, place) for all places of intervals ``first .. first + size``."""
    which = np.repeat(np.arange(len(first)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def match_shard(doc_words: list[list[bytes]], items: Items) -> list[tuple]:
    """Per document: hit spans (starts and ends of words), items found, longest match (words, place, item)."""
    get, counts = items.vocabulary.get, [len(w) for w in doc_words]
    begin = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
    ids = np.full(int(begin[-1]), -1, np.int64)
    for at, own in zip(begin.tolist(), doc_words):
        ids[at:at + len(own)] = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
    nothing = (np.zeros((0, 2), np.int64), [], 0, None, None)
    out = [nothing] * len(doc_words)
    order, end = suffix_array(ids, items.shortest) if items.shortest else (np.zeros(0, np.int64), None)
    if not len(order):
        return out
    low = _search(ids, order, end, items.flat, items.starts, items.sizes, False)
    high = _search(ids, order, end, items.flat, items.starts, items.sizes, True)
    window, at = _expand(low, high - low)
    if not len(window):
        return out
    place, size = order[at], items.sizes[window]
    # follow every match beyond its window, as far as document and item agree
    length = size.copy()
    open_ = np.arange(len(window))
    while open_.size:
        p, t = place[open_] + length[open_], items.starts[window[open_]] + length[open_]
        same = (p < end[place[open_]]) & (ids[np.minimum(p, len(ids) - 1)] == items.flat[t])
        open_ = open_[same]
        length[open_] += 1
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, place, 1)
    np.add.at(step, place + size, -1)
    hit = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    edge = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
    doc = np.searchsorted(begin, place, "right") - 1
    span_doc = np.searchsorted(begin, edge[:, 0], "right") - 1
    found = np.unique(doc * len(items.ids) + items.owner[window])
    best = np.lexsort((place, -length, doc))
    best = best[np.concatenate([[True], np.diff(doc[best]) > 0])]
    for d in np.unique(doc).tolist():
        a, b = np.searchsorted(span_doc, [d, d + 1])
        i, j = np.searchsorted(found, [d * len(items.ids), (d + 1) * len(items.ids)])
        top = best[np.searchsorted(doc[best], d)]
        out[d] = (edge[a:b] - begin[d], [items.ids[k] for k in (found[i:j] - d * len(items.ids)).tolist()],
                  int(length[top]), int(place[top] - begin[d]), items.ids[items.owner[window[top]]])
    return out


def _merged(spans: np.ndarray) -> np.ndarray:
    """Union of spans, in order."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1)


def benchmark_blocks(benchmark: DataFrame, n: int, item_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    """The benchmark in blocks of at most ``block_bytes`` (a longer item is a block of its own)."""
    rows = pick(benchmark, item=item_col, text=text_col).select(F.col("item").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))
    while True:
        block = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
        largest = block.groupBy("block").agg(F.sum(size).alias("size"), F.countDistinct("item", "text").alias("n")).where("n > 1").agg(F.max("size")).first()[0]
        if largest is None or largest <= block_bytes:
            break
        count *= 2
    for k in range(count):
        found = block.where(F.col("block") == k).dropDuplicates(["item", "text"]).collect()
        yield Items([(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in found], n)


def find_matches(docs: DataFrame, benchmark: DataFrame, result: str, n: int = 10, item_col: str = "item_id", bench_text: str = "text",
                 text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with a struct column ``result``: n_words, spans of hit words (pairs of 64-bit places),
    n_items and items that occur, and the longest verbatim match: its words, place and item."""
    spark = docs.sparkSession
    schema = T.StructType([*docs.schema.fields, T.StructField(result, _STATE)])
    for items in benchmark_blocks(benchmark, n, item_col, bench_text, block_bytes):
        shared = spark.sparkContext.broadcast(items)  # at most block_bytes of text
        first = result not in docs.columns

        def search(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in portions(whole, text_col, 4 << 20):  # words as objects take some twelve times the bytes of their text
                    own = [words(t or b"") for t in texts(batch, text_col)]
                    before = [None] * len(own) if first else batch.column(result).to_pylist()
                    rows = []
                    for n_words, (spans, found, longest, at, item), old in zip(map(len, own), match_shard(own, shared.value), before):
                        row = {"n_words": n_words, "spans": spans, "n_items": len(set(found)), "items": sorted({i for i in found if i is not None}),
                               "longest": longest, "longest_at": at, "longest_item": item}
                        if old:
                            row["spans"] = _merged(np.concatenate([np.frombuffer(old["spans"], np.int64).reshape(-1, 2), spans]))
                            both = sorted({*old["items"], *row["items"]})
                            no_id = (len(old["items"]) < old["n_items"]) or len(row["items"]) < row["n_items"]
                            row |= {"items": both, "n_items": len(both) + no_id}
                            if old["longest"] >= longest:
                                row |= {k: old[k] for k in ("longest", "longest_at", "longest_item")}
                        row["spans"] = np.ascontiguousarray(row["spans"], np.int64).tobytes()
                        rows.append(row)
                    columns = [batch.column(c) for c in batch.schema.names if c != result]
                    names = [c for c in batch.schema.names if c != result]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _ARROW)], names=[*names, result])
        docs = docs.mapInArrow(search, schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and the longest match.

    Null and empty texts have no words.  Items without words have no window; an item id that
    repeats counts once; items with a null id count as one and are not in the digest.  Rows of
    equal id are rows of their own; other columns are ignored.
    """
    found = find_matches(pick(docs, doc_id=id_col, text=text_col), benchmark, "found", **options).select("doc_id", "found")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("found").to_pylist()
            hits = [int(np.diff(np.frombuffer(r["spans"], np.int64).reshape(-1, 2), axis=1).sum()) for r in rows]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array([r["n_words"] for r in rows], pa.int64()), "n_hit": pa.array(hits, pa.int64()),
                "n_items": pa.array([r["n_items"] for r in rows], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in rows]),
                "contaminated": pa.array([h > 0 for h in hits]), "longest": pa.array([r["longest"] for r in rows], pa.int64()),
                "longest_at": pa.array([r["longest_at"] for r in rows], pa.int64()), "longest_item": pa.array([r["longest_item"] for r in rows], pa.string())})
    return found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
                                    "longest long, longest_at long, longest_item string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark window stands, with all their columns."""
    result = "__found"
    while result in docs.columns:
        result += "_"
    found = find_matches(docs, benchmark, result, **options)
    return found.where(F.octet_length(F.col(result)["spans"]) == 0).drop(result)
