"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Goal: every byte covered by a ``LENGTH``-byte string that also starts in a document of a
smaller id.  Sorting all suffixes would move many times the corpus, so suffixes are sorted
at *anchors*: a window of LENGTH bytes is represented by the leftmost of its k-grams with
the least hash.  Equal windows have their anchor at the same place, so the windows of one
anchor are one entry: the suffix from the anchor on, and the bytes before it.

1.  Anchors that cannot matter are dropped: tasks send the hashes of their anchor grams
    (four bytes each, by hash bucket) and learn which stand in a second document.
2.  Tasks sort the entries left into runs and front-code them (length of the prefix shared
    with the entry before, then the rest).  Of entries equal in full within a task only the
    smallest document goes on; the others are settled already, so what a third of all
    documents share is sent once a task.
3.  Runs are exchanged by bucket of their anchor gram and merged by a loser tree that knows
    the common prefixes: a match compares stored prefix lengths first and bytes only beyond
    what both sides are known to share.  The merged order comes with its prefix array.
4.  For each distance of a window's start from its anchor, entries equal on the right
    (prefix array) and on the left (the same over reversed left parts) are one class, and
    all but its smallest document lose that window.  The test is on bytes, never on hashes.

Documents meet their results by a hash of id and text.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, pick, texts

LENGTH, GRAM = 50, 20
GRAMS = LENGTH - GRAM + 1
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20
_NO_ID = (1 << 63) - 1


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """``best`` over every ``n`` neighbours, by doubling."""
    width = 1
    while 2 * width <= n:
        x = best(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return best(x[:-rest], x[rest:]) if rest else x


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never zero, of the GRAM bytes from every place on."""
    power = {w: np.uint64(pow(_BASE, w, 1 << 64)) for w in (1, 2, 4, 8)}
    h = data.astype(np.uint64) + np.uint64(1)
    of = {1: h}
    for w in (1, 2, 4, 8):
        of[2 * w] = of[w][:-w] * power[w] + of[w][w:]
        if w not in (4,):
            del of[w]
    h = of[16][:-4] * power[4] + of[4][16:16 + len(of[16]) - 4]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def _segments(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, gram hashes, least hash of each window or 0 where it leaves its document, anchors).

    Segments overlap by a window, so each window is seen once whatever a document's length.
    """
    ends = starts[1:]
    for a in range(0, len(data), _SEGMENT):
        b = min(a + _SEGMENT, len(data))
        region = data[a:b + LENGTH - 1]
        if len(region) < LENGTH:
            return
        h = _gram_hashes(region)
        least = _slide(h, GRAMS, np.minimum)
        place = np.arange(a, a + len(least))
        doc = np.searchsorted(ends, place[[0, -1]], "right")
        own = ends[doc[0]:doc[1] + 1]
        end = own[np.searchsorted(own, place, "right")] if len(own) > 1 else own[0]
        least = np.where(place + LENGTH <= end, least, np.uint64(0))
        padded = np.concatenate([np.zeros(GRAMS - 1, np.uint64), least, np.zeros(GRAMS - 1, np.uint64)])
        yield a, h, least, np.flatnonzero(_slide(padded, GRAMS, np.maximum) == h)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob: columns of a run compress far better than its rows would in the shuffle."""
    raw = b"".join(x for a in arrays for x in (a.nbytes.to_bytes(8, "little"), a.tobytes()))
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    blob = pa.Codec("zstd", 1).decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(blob[at:at + 8], "little")
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


_SENT = "bucket int, kind int, body binary"
WORK, LETTER = 0, 1  # what a reducer works on; what it only passes on to a document


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], names=["bucket", "kind", "body"])


def _letters(row: np.ndarray, item: np.ndarray, routes: list[int]) -> Iterator[pa.RecordBatch]:
    """Items of eight bytes for documents, packed by where the documents meet their letters."""
    if not len(row):
        return
    to = row % len(routes)
    order = np.lexsort((row, to))
    row, item, to = row[order], item[order], to[order]
    out = []
    for d in np.unique(to).tolist():
        i, j = np.searchsorted(to, [d, d + 1])
        edge = np.flatnonzero(np.concatenate([[True], row[i + 1:j] != row[i:j - 1]]))
        out.append((routes[d], LETTER, _pack(row[i:j][edge], np.diff(np.append(edge, j - i)).astype(np.uint32), item[i:j])))
    yield _rows(out)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document: row, items."""
    rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        for body in batch.column("body").to_pylist():
            row, count, item = _unpack(body, "<i8", "<u4", "<u8")
            rows.append(np.repeat(row, count))
            items.append(item)
    row, item = np.concatenate(rows), np.concatenate(items)
    order = np.argsort(row, kind="stable")
    row, item = row[order], item[order]
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    cuts = [*edge.tolist(), len(row)]
    for at in range(0, len(edge), 5_000):
        part = range(at, min(at + 5_000, len(edge)))
        yield pa.RecordBatch.from_arrays([pa.array(row[edge[at:at + 5_000]]), pa.array([item[cuts[k]:cuts[k + 1]].tobytes() for k in part], pa.binary())], names=["row", "items"])


def _routes(spark, n: int) -> list[int]:
    """For each of n partitions a key that Spark's hash partitioning sends there, so that none holds two buckets."""
    key = F.col("id").cast("int")
    found = spark.range(60 * n).groupBy(F.pmod(F.hash(key), F.lit(n)).alias("p")).agg(F.min(key).alias("k")).collect()
    at = {r["p"]: r["k"] for r in found}
    return [at.get(p, p) for p in range(n)]


# --- 1: anchors whose gram stands in a second document -------------------------------
def _send_grams(batches: Iterator[pa.RecordBatch], routes: list[int]) -> Iterator[pa.RecordBatch]:
    buckets = len(routes)
    for batch in batches:
        data, starts = flat(batch)
        row_of = batch.column("row").to_numpy()
        grams, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, h, _, anchor in _segments(data, starts):
            doc = np.searchsorted(starts, anchor + a, "right") - 1
            order = np.lexsort((h[anchor], doc))
            g, d = h[anchor][order], doc[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.zeros(0, bool)
            grams.append(g[new])
            docs.append(d[new])
        g, d = np.concatenate(grams), np.concatenate(docs)
        if not len(g):
            continue
        order = np.argsort(g, kind="stable")
        g, d = g[order], d[order]
        first = np.concatenate([[True], g[1:] != g[:-1]])
        group = np.cumsum(first) - 1
        r = row_of[d]
        low, high = np.minimum.reduceat(r, np.flatnonzero(first)), np.maximum.reduceat(r, np.flatnonzero(first))
        shared = (low != high)[group]
        yield from _letters(r[shared], _coded(*_split(g[shared], buckets)), routes)
        # one sign a batch that a shared gram exists, without a document; lone grams with theirs
        told = g[first & shared]
        lone = ~shared
        key, slot = _split(g[lone], buckets)
        order = np.lexsort((r[lone], slot))
        key, slot, owner = key[order], slot[order], r[lone][order]
        sign, sign_slot = _split(told, buckets)
        by = np.argsort(sign_slot, kind="stable")
        sign, sign_slot = sign[by], sign_slot[by]
        out = []
        for s in np.unique(np.concatenate([slot, sign_slot])).tolist():
            i, j = np.searchsorted(slot, [s, s + 1])
            p, q = np.searchsorted(sign_slot, [s, s + 1])
            edge = np.flatnonzero(np.concatenate([[True], owner[i + 1:j] != owner[i:j - 1]])) if j > i else np.zeros(0, np.int64)
            counts = np.diff(np.append(edge, j - i)).astype(np.uint32)
            out.append((routes[s], WORK, _pack(np.array([s]), owner[i:j][edge], counts, key[i:j].astype("<u4"), sign[p:q].astype("<u4"))))
        if out:
            yield _rows(out)


def _split(g: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of a gram hash that stand for it within its bucket, and the bucket.

    Two grams that fall together are taken for shared, which costs work and changes no result.
    """
    return g >> np.uint64(32), ((g & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _coded(key: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Bucket and the 32 bits within it as one number."""
    return slot.astype(np.uint64) << np.uint64(32) | key


def _shared_grams(batches: Iterator[pa.RecordBatch], routes: list[int]) -> Iterator[pa.RecordBatch]:
    """Letters that tell each document which of its grams stand in another."""
    keys, rows, signs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind == LETTER).any():
            yield batch.filter(pa.array(kind == LETTER))
        for body in batch.filter(pa.array(kind == WORK)).column("body").to_pylist():
            slot, owner, counts, key, sign = _unpack(body, "<i8", "<i8", "<u4", "<u4", "<u4")
            high = np.uint64(slot[0]) << np.uint64(32)
            keys.append(key | high)
            rows.append(np.repeat(owner, counts))
            signs.append(sign | high)
    key, row, sign = np.concatenate(keys), np.concatenate(rows), np.unique(np.concatenate(signs))
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    if not len(key):
        return
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    low, high = np.minimum.reduceat(row, first), np.maximum.reduceat(row, first)
    at = np.minimum(np.searchsorted(sign, key[first]), max(0, len(sign) - 1))
    shared = (low != high) | ((sign[at] == key[first]) if len(sign) else False)
    shared = np.repeat(shared, np.diff(np.append(first, len(key))))
    yield from _letters(row[shared], key[shared], routes)


# --- 2: entries, runs ---------------------------------------------------------------
def _entries(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, anchor, first and last window start, bucket) of every run of windows that may repeat."""
    data, starts = flat(batch)
    shared = [np.frombuffer(a, np.uint64) if a else np.zeros(0, np.uint64) for a in batch.column("items").to_pylist()]
    count = np.array([len(s) for s in shared])
    order_key = np.concatenate([np.zeros(0, np.uint64), *shared])
    order_doc = np.repeat(np.arange(len(shared)), count)
    by = np.lexsort((order_key, order_doc))
    order_key, begin = order_key[by], np.concatenate([[0], np.cumsum(count)])
    for a, h, least, anchor in _segments(data, starts):
        if not len(anchor):
            continue
        doc = np.searchsorted(starts, anchor + a, "right") - 1
        k, slot = _split(h[anchor], buckets)
        key = _coded(k, slot)
        may = np.zeros(len(anchor), bool)
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])).tolist()
        for i, j in zip(edges, [*edges[1:], len(doc)]):
            own = order_key[begin[doc[i]]:begin[doc[i] + 1]]
            if len(own):
                at = np.minimum(np.searchsorted(own, key[i:j]), len(own) - 1)
                may[i:j] = own[at] == key[i:j]
        if not may.any():
            continue
        # windows with a shared anchor among their grams, then the leftmost anchor of least hash
        mark = np.zeros(len(h) + 1, np.int64)
        mark[anchor[may] + 1] = 1
        seen = np.cumsum(mark)
        window = np.arange(len(least))
        window = window[(least != 0) & (seen[np.minimum(window + GRAMS, len(h))] > seen[window])]
        t = np.searchsorted(anchor, window)
        open_ = np.arange(len(window))
        while open_.size:
            wrong = h[anchor[t[open_]]] != least[window[open_]]
            open_ = open_[wrong]
            t[open_] += 1
        fits = may[t]
        window, t = window[fits], t[fits]
        if not len(window):
            continue
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (window[1:] != window[:-1] + 1)]))
        last = np.append(new[1:], len(window)) - 1
        q = anchor[t[new]]
        yield from zip(doc[t[new]].tolist(), (q + a).tolist(), (window[new] + a).tolist(), (window[last] + a).tolist(), slot[t[new]].tolist())


def _send_runs(batches: Iterator[pa.RecordBatch], routes: list[int], room: int = 40 << 20) -> Iterator[pa.RecordBatch]:
    buckets = len(routes)
    held: dict[tuple, tuple[int, int, list[int]]] = {}
    size, settled = 0, {}

    def give() -> Iterator[pa.RecordBatch]:
        nonlocal size
        row = np.repeat(np.fromiter(settled, np.int64, len(settled)), np.fromiter((len(x) // 2 for x in settled.values()), np.int64, len(settled)))
        yield from _letters(row, np.array([p for x in settled.values() for p in x], np.int32).view(np.uint64), routes)
        by: dict[int, list] = {}
        for (content, left, bucket, *_), (ident, row, places) in held.items():
            by.setdefault(bucket, []).append((content[left:], content[:left], ident, row, places))
        out, weight = [], 0
        for bucket, run in by.items():
            run.sort(key=lambda e: e[0])
            out.append((routes[bucket], WORK, _front_code(run)))
            weight += len(out[-1][2])
            if weight > 4 << 20:
                yield _rows(out)
                out, weight = [], 0
        if out:
            yield _rows(out)
        held.clear()
        settled.clear()
        size = 0
    for batch in batches:
        data, starts = flat(batch)
        raw, begin = data.tobytes(), starts.tolist()
        ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        for doc, q, low, high, bucket in _entries(batch, buckets):
            content, at = raw[low:high + LENGTH], q - begin[doc]
            key, ident, row = (content, q - low, bucket), ids[doc], rows[doc]
            old = held.get(key)
            if old is None:
                held[key] = (ident, row, [at])
                size += len(content) + 300
            elif old[1] == row:
                old[2].append(at)
            elif old[0] == ident:  # equal ids, other texts: neither is smaller, so both go on
                held[key + (row,)] = (ident, row, held.get(key + (row,), (0, 0, []))[2] + [at])
            else:
                loser, keep = ((ident, row, [at]), old) if ident > old[0] else (old, (ident, row, [at]))
                held[key] = keep
                spans = settled.setdefault(loser[1], [])
                for p in loser[2]:
                    spans += [p - (q - low), p - (q - low) + len(content)]
                size += 16 * len(loser[2])
        if size > room:
            yield from give()
    yield from give()


def _front_code(run: list) -> bytes:
    """A sorted run: shared prefix with the entry before, rest of the suffix, left part, document, places."""
    n = len(run)
    shared, before, rest = np.zeros(n, np.uint8), b"", []
    for i, (suffix, *_) in enumerate(run):
        m = _common(before, suffix, 0)
        shared[i] = m
        rest.append(suffix[m:])
        before = suffix
    ints = lambda values, kind: np.fromiter(values, kind, n)
    return _pack(shared, ints(map(len, rest), np.uint8), np.frombuffer(b"".join(rest), np.uint8), ints((len(e[1]) for e in run), np.uint8),
                 np.frombuffer(b"".join(e[1] for e in run), np.uint8), ints((e[2] for e in run), np.int64), ints((e[3] for e in run), np.int64),
                 ints((len(e[4]) for e in run), np.uint32), np.array([p for e in run for p in e[4]], np.uint32))


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be at least ``at``."""
    n = min(len(a), len(b))
    while at + 8 <= n and a[at:at + 8] == b[at:at + 8]:
        at += 8
    while at < n and a[at] == b[at]:
        at += 1
    return at


# --- 3: merge -----------------------------------------------------------------------
def merge_runs(runs: list[list[tuple[int, bytes]]]) -> Iterator[tuple[int, int, int]]:
    """Loser tree over front-coded runs, each a list of (shared with the entry before, suffix).

    Gives (run, place in it, prefix shared with the suffix given before) in sorted order.  Every
    side of a match carries the prefix that it shares with the last winner; the longer one wins
    unseen, and only equal ones look at bytes, from there on.
    """
    k = len(runs)
    at = [0] * k
    shared = [0 if run else -1 for run in runs]  # -1: exhausted, loses to all
    head = [run[0][1] if run else b"" for run in runs]

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes what it shares with the winner."""
        p, q = shared[x], shared[y]
        if p != q:
            return (x, y) if p > q else (y, x)
        if p < 0:
            return x, y
        a, b = head[x], head[y]
        m = _common(a, b, p)
        if m == len(a) or (m < len(b) and a[m] < b[m]):
            shared[y] = m
            return x, y
        shared[x] = m
        return y, x
    size = 1
    while size < k:
        size *= 2
    for _ in range(size - k):
        runs, at, shared, head = runs + [[]], at + [0], shared + [-1], head + [b""]
    loser, level = [0] * size, list(range(size))
    base = size
    while base > 1:
        base //= 2
        won = []
        for i in range(base):
            w, lost = play(level[2 * i], level[2 * i + 1])
            loser[base + i] = lost
            won.append(w)
        level = won
    winner = level[0]
    while shared[winner] >= 0:
        yield winner, at[winner], shared[winner]
        i = at[winner] = at[winner] + 1
        run = runs[winner]
        if i < len(run):
            shared[winner], head[winner] = run[i]
        else:
            shared[winner] = -1
        node = (winner + size) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


# --- 4: classes of equal windows ------------------------------------------------------
def lost_windows(shared: np.ndarray, sizes: np.ndarray, lefts: list[bytes], ids: np.ndarray) -> np.ndarray:
    """entries x distances: the window that starts so far before the anchor stands in a smaller document.

    Entries are in the order of their suffixes; ``shared`` is their prefix array, ``sizes`` their lengths.
    """
    n = len(sizes)
    lost = np.zeros((n, GRAMS), bool)
    left_size = np.array([len(x) for x in lefts])
    matrix = np.zeros((n, GRAMS), np.uint8)
    flat_left = np.frombuffer(b"".join(x[::-1] for x in lefts), np.uint8)
    row = np.repeat(np.arange(n), left_size)
    matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(left_size) - left_size, left_size)] = flat_left
    order = np.lexsort(matrix.T[::-1])
    differ = matrix[order][1:] != matrix[order][:-1]
    same = np.where(differ.any(1), differ.argmax(1), GRAMS)
    low = LENGTH - sizes
    for a in range(GRAMS):
        member = np.flatnonzero((low <= a) & (left_size >= a))
        if len(member) < 2:
            continue
        right = np.cumsum(shared < LENGTH - a)
        left = np.empty(n, np.int64)
        left[order] = np.concatenate([[0], np.cumsum(same < a)])
        key = right[member] * (n + 1) + left[member]
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        least = np.repeat(np.minimum.reduceat(ids[member][by], first), np.diff(np.append(first, len(by))))
        lost[member[by], a] = ids[member][by] > least
    return lost


def _merge(batches: Iterator[pa.RecordBatch], routes: list[int], chunk: int = 40_000) -> Iterator[pa.RecordBatch]:
    """Letters that tell each document which of its bytes go."""
    runs, extra = [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind == LETTER).any():
            yield batch.filter(pa.array(kind == LETTER))
        for body in batch.filter(pa.array(kind == WORK)).column("body").to_pylist():
            shared, size, rest, left_size, left, ids, rows, n_places, places = _unpack(body, "u1", "u1", "u1", "u1", "u1", "<i8", "<i8", "<u4", "<u4")
            raw, at, before, run = rest.tobytes(), 0, b"", []
            for m, n in zip(shared.tolist(), size.tolist()):
                before = before[:m] + raw[at:at + n]
                at += n
                run.append((m, before))
            runs.append(run)
            extra.append((left.tobytes(), np.concatenate([[0], np.cumsum(left_size, dtype=np.int64)]).tolist(), ids.tolist(), rows.tolist(), places,
                          np.concatenate([[0], np.cumsum(n_places, dtype=np.int64)]).tolist()))
    held: list[tuple[int, int, int]] = []
    group = 0  # where the last group of equal grams begins in held
    for entry in merge_runs(runs) if runs else ():
        if entry[2] < GRAM:
            if len(held) - group < 2:
                del held[group:]  # alone with its gram
            if len(held) >= chunk:
                yield from _settle(held, runs, extra, routes)
                held = []
            group = len(held)
        held.append(entry)
    if len(held) - group < 2:
        del held[group:]
    yield from _settle(held, runs, extra, routes)


def _settle(held, runs, extra, routes: list[int]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    shared = np.array([m for _, _, m in held])
    sizes = np.array([len(runs[r][i][1]) for r, i, _ in held])
    lefts = [extra[r][0][extra[r][1][i]:extra[r][1][i + 1]] for r, i, _ in held]
    ids = np.array([extra[r][2][i] for r, i, _ in held], np.int64)
    lost = lost_windows(shared, sizes, lefts, ids)
    edge = np.diff(np.pad(lost.view(np.int8), ((0, 0), (1, 1))), axis=1)
    entry, a = np.nonzero(edge == 1)  # distances a .. b - 1 of an entry are lost
    _, b = np.nonzero(edge == -1)
    if not len(entry):
        return
    where = [(extra[held[e][0]], held[e][1]) for e in entry.tolist()]
    count = np.array([x[5][i + 1] - x[5][i] for x, i in where])
    place = np.concatenate([x[4][x[5][i]:x[5][i + 1]] for x, i in where]).astype(np.int64)
    row = np.repeat(np.array([x[3][i] for x, i in where], np.int64), count)
    spans = np.stack([place - np.repeat(b, count) + 1, place - np.repeat(a, count) + LENGTH], 1).astype(np.int32)
    yield from _letters(row, np.ascontiguousarray(spans).view(np.uint64).reshape(-1), routes)


def merged_spans(found: bytes | None) -> np.ndarray:
    """Maximal runs of removed bytes from spans (pairs of 32-bit places) in any order."""
    spans = np.frombuffer(found or b"", np.int32).reshape(-1, 2)
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, row and ``spans``, the removed byte ranges of each row (32-bit pairs, unmerged)."""
    spark = df.sparkSession
    routes = _routes(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pick(df, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("row"))

    def exchange(sent: DataFrame, work) -> DataFrame:
        """What tasks send, by bucket; what reducers answer, by document."""
        told = sent.repartition("bucket").mapInArrow(lambda it: work(it, routes), _SENT)
        return told.repartition("bucket").mapInArrow(_gather, "row long, items binary")
    shared = exchange(rows.select("row", "text").mapInArrow(lambda it: _send_grams(it, routes), _SENT), _shared_grams)
    # both joins take the same rows by the same key, so the texts are shuffled once
    left = rows.join(shared, "row").withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    spans = exchange(left.mapInArrow(lambda it: _send_runs(it, routes), _SENT), _merge)
    return rows.join(spans.withColumnRenamed("items", "spans"), "row", "left")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty.  A null id counts as larger than every id; rows of equal id never
    remove from each other.  Other columns are ignored.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for text, blobs in zip(texts(batch), batch.column("spans").to_pylist()):
                text, spans = text or b"", merged_spans(blobs)
                at, parts = 0, []
                for a, b in spans.tolist():
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                kept.append(b"".join(parts))
                counts.append((len(text), len(text) - len(kept[-1]), len(spans)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)],
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    found = repeated_spans(df, id_col, text_col).select("doc_id", "text", "spans")
    return found.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
