"""Packing of token pieces into sequences by a configuration linear program.

A configuration says how many pieces of each length one sequence holds.  The covering
program over the histogram of lengths (minimise the sequences, cover every length) is
solved by multiplicative weights: each round a knapsack over the room of a sequence prices
the configuration of most weight, and the lengths that it covers lose weight.  Its
solution is rounded down, best-fit packs the small rest, and all of it is a *plan* of
configurations with multiplicities, whose size depends on the room of a sequence and not
on the number of documents.  Only the histogram (at most ``room`` rows) reaches the driver;
pieces find their places by their rank within their length.
"""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written
from .tokens import default_path, encoder

PIECES = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, local long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(df: DataFrame, room: int = 1024, end_id: int = 2, tokenizer: str | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every text: at most ``room`` ids; of a cut document only the first may be shorter.

    ``part`` and ``local`` number the pieces of one length within a task; the result must
    be written before use so that these stay fixed.
    """
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(room + 1, np.int64)
        end = np.array([end_id], code.dtype)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                few = batch.slice(at, 500)
                doc, piece, start, length, crc = [], [], [], [], []
                for d, ids in zip(few.column("doc_id").to_pylist(), code.encode(few.column("text").to_pylist())):
                    raw = np.concatenate([ids, end]).astype("<u4").tobytes()
                    n = len(raw) // 4
                    a, k = 0, 0
                    while a < n:
                        size = (n - 1) % room + 1 if a == 0 else room
                        doc.append(d)
                        piece.append(k)
                        start.append(a)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * a:4 * (a + size)]))
                        a, k = a + size, k + 1
                size = np.array(length)
                order = np.argsort(size, kind="stable")
                run = size[order]
                first = np.searchsorted(run, run)
                local = np.empty(len(size), np.int64)
                local[order] = seen[run] + np.arange(len(run)) - first
                seen += np.bincount(size, minlength=room + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part, np.int32)), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(local)],
                    names=["part", "doc_id", "piece", "start", "length", "ids_crc32", "local"])
    return pick(df, doc_id=id_col, text=text_col).mapInArrow(cut, PIECES)


def price(lengths: np.ndarray, value: np.ndarray, room: int, most: np.ndarray) -> dict[int, int]:
    """Knapsack: the multiset of lengths of most value within ``room`` (by dynamic programming)."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(lengths, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        n = upto[c]
        if n:
            gain = best[c - lengths[:n]] + value[:n]
            k = int(gain.argmax())
            if gain[k] > best[c - 1]:
                best[c], last[c] = gain[k], k
                continue
        best[c] = best[c - 1]
    config, c = defaultdict(int), room
    while c > 0:
        if last[c] < 0:
            c -= 1
            continue
        length = int(lengths[last[c]])
        if config[length] < most[last[c]]:  # no more of a length than there are
            config[length] += 1
        c -= length
    return {k: v for k, v in config.items() if v}


def solve(histogram: dict[int, int], room: int, rounds: int = 500, step: float = 0.25) -> list[tuple[tuple[tuple[int, int], ...], float]]:
    """Fractional use of configurations by multiplicative weights."""
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[int(x)] for x in lengths], float)
    if not len(lengths):
        return []
    covered, used = np.zeros(len(lengths)), defaultdict(float)
    index = {int(x): i for i, x in enumerate(lengths)}
    for _ in range(rounds):
        weight = np.exp(-(covered - covered.min()) / step) / need
        config = price(lengths, weight, room, need)
        if not config:
            break
        which = np.array([index[x] for x in config])
        count = np.array(list(config.values()), float)
        amount = (need[which] / count).min() * step
        covered[which] += amount * count / need[which]
        used[tuple(sorted(config.items()))] += amount
    # what is covered more than once is of no use: scale by the mean cover
    scale = max(1e-12, float((covered * need * lengths).sum() / (need * lengths).sum()))
    return [(c, x / scale) for c, x in used.items()]


def best_fit(histogram: dict[int, int], room: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on counts: equal bins are kept together, so the work follows the kinds of bins."""
    open_bins: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = min((r for r, kinds in open_bins.items() if r >= length and kinds), default=None)
            if free is None:
                fit = room // length
                full, more = divmod(left, fit)
                for count, n in ((fit, full), (more, 1 if more else 0)):
                    if count and n:
                        open_bins[room - count * length][((length, count),)] += n
                break
            kind, n = open_bins[free].popitem()
            take = min(n, left)
            if n > take:
                open_bins[free][kind] += n - take
            have = dict(kind)
            have[length] = have.get(length, 0) + 1
            open_bins[free - length][tuple(sorted(have.items()))] += take
            left -= take
            if not open_bins[free]:
                del open_bins[free]
    return [(kind, n) for kinds in open_bins.values() for kind, n in kinds.items() if n]


def make_plan(histogram: dict[int, int], room: int, **options) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations with multiplicities that hold exactly the pieces of the histogram.

    Best-fit alone is a plan too; the one with fewer sequences is returned.
    """
    left = dict(histogram)
    plan = []
    for config, x in sorted(solve(histogram, room, **options), key=lambda c: -c[1]):
        n = min([int(x), *(left[length] // count for length, count in config)])
        if n:
            plan.append((config, n))
            for length, count in config:
                left[length] -= n * count
    plan += best_fit({k: v for k, v in left.items() if v}, room)
    plain = best_fit(histogram, room)
    return min(plan, plain, key=lambda p: sum(n for _, n in p))


def _segments(plan) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, in order of rank: first rank, pieces a sequence, first sequence, first offset."""
    out, sequence = defaultdict(list), 0
    ranks: dict[int, int] = defaultdict(int)
    for config, n in plan:
        offset = 0
        for length, count in config:
            out[length].append((ranks[length], count, sequence, offset))
            ranks[length] += count * n
            offset += length * count
        sequence += n
    return {k: tuple(np.array(c) for c in zip(*v)) for k, v in out.items()}


def pack(df: DataFrame, room: int = 1024, **options) -> DataFrame:
    """Every piece of every document with its sequence and offset; sequences are filled from 0 without gaps.

    Null and empty texts are one piece of the end id; null ids and equal ids are kept as they
    are, a row each.  An empty table gives an empty result.  Other columns are ignored.
    """
    cut = written(pieces(df, room, **options), "pieces")
    sizes = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = _segments(make_plan(histogram, room))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = sizes.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(places, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                first, count, base, start = segments[size]
                k = np.searchsorted(first, rank[at], "right") - 1
                inside = rank[at] - first[k]
                sequence[at] = base[k] + inside // count[k]
                offset[at] = start[k] + inside % count[k] * size
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece"), batch.column("start"), batch.column("length").cast(pa.int64()),
                 batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return ranked.mapInArrow(place, PLACED)
