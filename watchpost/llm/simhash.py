"""SimHash near-deduplication by covering with anchor points.

A field is a run of bits with a covering code: 23 bits with the Golay code (every word
within 3 of exactly one codeword) or 17 bits with the quadratic-residue code (within 3).
Codewords are the anchors.  A fingerprint is at home at its nearest anchor of a field, and
is copied to the anchors within covering radius plus ``spare`` bits that precede its home.
Two fingerprints that differ in at most ``spare`` bits of the field then meet at the
lesser of their homes: both lie within that distance of it.  Per anchor, homes are compared
with homes and copies.

``EXACT``: 64 bits in three fields (23, 23 and 17 bits) for links at 4 or fewer bits.  Such
a pair differs in at most 4 // 3 = 1 bit in some field, so one spare bit loses nothing.  With
``together=2`` an anchor is a pair of codewords of two fields (2 spare bits between them):
more anchors with fewer rows each, for corpora where an anchor of one field grows too large.

``SIMILAR`` finds candidates for a Jaccard similarity of 0.8 or more of the sets of 5-word
shingles, where 64 bits differ in about ten: 24 fields of further hash bits let pairs meet
and at most 35 of 128 bits of their own may differ.  ``near_copies`` decides them.

Equal fingerprints (with ``jaccard``: equal shingle sets) are one row.  A crowded anchor is
dealt in tiles of at most about ``tile_rows`` homes and copies; a tile returns a spanning
forest of its links, never all its pairs.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, texts, written
from .components import components

#: Length of a field, its code's generator polynomial and covering radius.
GOLAY = (23, 0b101011100011, 3)
RESIDUE = (17, 0b100111001, 3)


@dataclass(frozen=True)
class Scheme:
    """Words of 64 bits in a fingerprint, fields as (word, first bit, code), and what links."""

    words: int
    fields: tuple
    check: tuple[int, ...]  # words whose bits decide
    threshold: int
    spare: int
    size: int  # words in a shingle
    together: int = 1
    seed: int = 42
    jaccard: float = 0.0  # if set, shingles count once and links need this similarity of their sets


EXACT = Scheme(1, ((0, 0, GOLAY), (0, 23, GOLAY), (0, 46, RESIDUE)), (0,), 4, 1, 4)
EXACT_TWO = Scheme(1, EXACT.fields, (0,), 4, 2, 4, together=2)
SIMILAR = Scheme(14, tuple((w, b, GOLAY) for w in range(2, 14) for b in (0, 23)), (0, 1), 35, 1, 5, jaccard=0.8)

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingles(text: bytes | None, scheme: Scheme = EXACT) -> np.ndarray:
    """XXH64 of each of the text's shingles; with ``jaccard`` the different ones, sorted."""
    own, size, one = (text or b"").lower().split(), scheme.size, xxhash.xxh64_intdigest
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    if len(own) <= size:
        h = np.array([one(joined, scheme.seed)], np.uint64)
    else:
        end = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        start = [0, *(end[:-size] + 1).tolist()]
        h = np.array([one(joined[a:b], scheme.seed) for a, b in zip(start, end[size - 1:].tolist())], np.uint64)
    return np.unique(h) if scheme.jaccard else h


def fingerprint(text: bytes | None, scheme: Scheme = EXACT) -> np.ndarray:
    """Bits set in over half of the hashes of the text's shingles."""
    return _majority(shingles(text, scheme), scheme.words)


def _majority(h: np.ndarray, words: int) -> np.ndarray:
    """The bits; of more than a word, hashes are mixed anew for each word."""
    if not len(h):
        return np.zeros(words, np.uint64)
    lane = np.arange(8 * words) * 256
    seen = np.zeros(2048 * words, np.int64)
    for at in range(0, len(h), 1 << 12):
        part = h[at:at + (1 << 12)]
        if words > 1:
            part = _mixed(part, words)
        seen += np.bincount((part.astype("<u8").view(np.uint8).reshape(-1, len(lane)) + lane).ravel(), minlength=len(seen))
    bits = seen.reshape(-1, 256) @ _BITS
    return np.packbits((2 * bits > len(h)).ravel(), bitorder="little").view("<u8")


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    x = h[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=None)
def coset_table(length: int, generator: int, weight: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Syndrome of each bit; per syndrome the error patterns of up to ``weight`` bits; one lightest pattern each."""
    degree = generator.bit_length() - 1
    column, x = [], 1
    for _ in range(length):
        column.append(x)
        x <<= 1
        if x >> degree:
            x ^= generator
    column = np.array(column, np.int64)
    found: list[list[int]] = [[] for _ in range(1 << degree)]
    for w in range(weight + 1):
        for where in combinations(range(length), w):
            s = 0
            for i in where:
                s ^= int(column[i])
            found[s].append(sum(1 << i for i in where))
    lightest = np.array([f[0] if f else -1 for f in found], np.int64)
    return column, [np.array(f, np.int64) for f in found], lightest


def _syndromes(words: np.ndarray, column: np.ndarray) -> np.ndarray:
    s = np.zeros(len(words), np.int64)
    for i, c in enumerate(column.tolist()):
        s ^= np.where(words >> i & 1, c, 0)
    return s


def _near(values: np.ndarray, code: tuple, weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, codeword, distance) for all codewords within ``weight`` of each value, and each value's nearest."""
    column, patterns, lightest = coset_table(code[0], code[1], weight)
    s = _syndromes(values, column)
    counts = np.array([len(p) for p in patterns])
    flat, first = np.concatenate(patterns), np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(values)), counts[s])
    inside = np.arange(len(row)) - np.repeat(np.cumsum(counts[s]) - counts[s], counts[s])
    error = flat[np.repeat(first[s], counts[s]) + inside]
    return row, values[row] ^ error, np.bitwise_count(error).astype(np.int64), values ^ lightest[s]


def anchors(prints: np.ndarray, scheme: Scheme, fields: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per choice of (the first ``fields``) fields: (choice, row, anchor, at home) of fingerprints, a row each."""
    for choice, chosen in enumerate(combinations(scheme.fields[:fields], scheme.together)):
        n = len(prints)
        row, anchor, over, home = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for word, bit, code in chosen:
            value = ((prints[:, word] >> np.uint64(bit)) & np.uint64((1 << code[0]) - 1)).astype(np.int64)
            r, codeword, distance, nearest = _near(value, code, code[2] + scheme.spare)
            counts = np.bincount(r, minlength=n)
            took = counts[row]
            at = np.repeat((np.cumsum(counts) - counts)[row], took) + np.arange(took.sum()) - np.repeat(np.cumsum(took) - took, took)
            anchor = np.repeat(anchor, took) << code[0] | codeword[at]
            over = np.repeat(over, took) + np.maximum(0, distance[at] - code[2])
            row = np.repeat(row, took)
            home = home << code[0] | nearest
            fits = over <= scheme.spare
            row, anchor, over = row[fits], anchor[fits], over[fits]
        fits = anchor <= home[row]
        yield choice, row[fits], anchor[fits], anchor[fits] == home[row[fits]]


def _similar(sets: list[np.ndarray], jaccard: float):
    """test(i, near): which of the sets ``near`` have at least this similarity with set i."""
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first, mark = np.cumsum(size) - size, np.zeros(len(flat) + 1, bool)

    def test(i: int, near: np.ndarray) -> np.ndarray:
        own, n = flat[first[i]:first[i] + size[i]], size[near]
        mark[own] = True
        at = np.repeat(first[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(np.repeat(np.arange(len(near)), n), mark[flat[at]], len(near))
        mark[own] = False
        return both >= jaccard * (n + size[i] - both) - 1e-9
    return test


def _forest(bits: np.ndarray, n_homes: int, threshold: int, by: int = 256, test=None, label: np.ndarray | None = None,
            side: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """A spanning forest of the links of the first ``n_homes`` rows with all rows.

    ``test(row, rows)`` tells which rows within the bits are links.  Rows of one ``label``
    are known to be together, so a link only comes out if it joins two labels.  With
    ``side`` rows are compared with those of the other side alone.
    """
    label = np.arange(len(bits)) if label is None else label.copy()
    a, b = [], []
    for at in range(0, n_homes, by):
        block = slice(at, min(at + by, n_homes))
        linked = sum(np.bitwise_count(bits[block, k, None] ^ bits[None, :, k]).astype(np.int16) for k in range(bits.shape[1])) <= threshold
        linked[np.arange(len(linked)), at + np.arange(len(linked))] = False
        if not linked.any():
            continue
        linked &= label[block, None] != label[None, :]
        if side is not None:
            linked &= side[block, None] != side[None, :]
        for i in np.flatnonzero(linked.any(1)).tolist():
            near = np.flatnonzero(linked[i])
            own = label[at + i]
            near = near[label[near] != own]
            if test is not None and len(near):
                near = near[test(at + i, near)]
            roots, first = np.unique(label[near], return_index=True)
            if len(roots):
                a.extend([at + i] * len(roots))
                b.extend(near[first].tolist())
                label[np.isin(label, roots)] = own
    return a, b


def near_links(prints: DataFrame, scheme: Scheme = EXACT, tile_rows: int = 2048) -> DataFrame:
    """Links a < b between the nodes of ``prints`` (node, fp: distinct fingerprints), enough to connect all that is near."""
    check = [f"c{k}" for k in range(len(scheme.check))]
    bits = ", ".join(f"{c} long" for c in check)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                node = part.column("node").to_numpy()
                fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), "<u8").reshape(-1, scheme.words)
                for choice, row, anchor, home in anchors(fp, scheme):
                    yield pa.RecordBatch.from_pydict({"choice": pa.array(np.full(len(row), choice, np.int64)), "anchor": pa.array(anchor), "node": pa.array(node[row]),
                                                      **{c: pa.array(fp[row, w].view(np.int64)) for c, w in zip(check, scheme.check)}, "home": pa.array(home)})
    covered = prints.select("node", "fp").mapInArrow(cover, f"choice long, anchor long, node long, {bits}, home boolean")
    sizes = covered.groupBy("choice", "anchor").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("all_n"))
    side = lambda c: F.ceil(F.col(c) / tile_rows).cast("int")
    crowd = sizes.where(F.col("all_n") > tile_rows).select("choice", "anchor", side("homes").alias("i_n"), side("all_n").alias("j_n"))
    if scheme.together == 1:  # at most 4096 anchors a field: at most 2 MB in all
        crowd = F.broadcast(crowd)
    dealt = covered.join(crowd, ["choice", "anchor"], "left").withColumns({"i_n": F.greatest(F.coalesce("i_n", F.lit(1)), F.lit(1)), "j_n": F.coalesce("j_n", F.lit(1))})
    i, j = F.pmod(F.xxhash64("node"), F.col("i_n")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("j_n")).cast("int")
    # tile (i, j) compares homes of part i with all rows of part j; a home serves as both
    places = F.when(F.col("home"), F.array_distinct(F.concat(
        F.transform(F.sequence(F.lit(0), F.col("j_n") - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(True).alias("as_home"))),
        F.transform(F.sequence(F.lit(0), F.col("i_n") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), (k == i).alias("as_home")))))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("i_n") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(False).alias("as_home"))))
    tiles = dealt.withColumn("tile", F.explode(places)).select("choice", "anchor", "node", *check, "tile.i", "tile.j", F.col("tile.as_home").alias("home"))
    keys = ["choice", "anchor", "i", "j"]
    tiles = tiles.repartition(*keys).sortWithinPartitions(*keys, F.col("home").desc())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []  # rows of the last, maybe unfinished tile

        def work(rows: list[np.ndarray]) -> pa.RecordBatch:
            node, home, fp = rows[4], rows[5].astype(bool), np.stack(rows[6:], 1).view(np.uint64)
            change = np.zeros(len(node), bool)
            change[0] = True
            for k in rows[:4]:
                change[1:] |= k[1:] != k[:-1]
            cuts = np.append(np.flatnonzero(change), len(node))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                n_homes = int(home[s:e].sum())
                if n_homes and e - s > 1:
                    one, two = _forest(fp[s:e], n_homes, scheme.threshold)
                    a.append(node[s:e][one])
                    b.append(node[s:e][two])
            a, b = np.concatenate(a), np.concatenate(b)
            real = a != b
            return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)[real]), "b": pa.array(np.maximum(a, b)[real])})
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "node", "home", *check)]
            rows = [np.concatenate([x, y]) for x, y in zip(left, rows)] if left else rows
            if not len(rows[0]):
                continue
            last = np.ones(len(rows[0]), bool)
            for k in rows[:4]:
                last &= k == k[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            left = [r[cut:] for r in rows]
            if cut:
                yield work([r[:cut] for r in rows])
        if left:
            yield work(left)
    return tiles.mapInArrow(compare, "a long, b long")


def digest(b: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(b), "little", signed=True)


def _fingerprints(batch: pa.RecordBatch, scheme: Scheme, text_col: str = "text") -> tuple[pa.Array, pa.Array, pa.Array]:
    """Fingerprints as bytes, the nodes that stand for them or, with ``jaccard``, for the shingle sets, and the sets' bytes."""
    found = [shingles(t, scheme) for t in texts(batch, text_col)]
    prints = [_majority(h, scheme.words).tobytes() for h in found]
    if scheme.jaccard:
        nodes = [digest(h.tobytes()) for h in found]
    else:
        nodes = [int.from_bytes(f, "little", signed=True) if scheme.words == 1 else digest(f) for f in prints]
    return pa.array(prints, pa.binary()), pa.array(nodes, pa.int64()), pa.array([h.nbytes for h in found], pa.int64())


def fingerprints(df: DataFrame, scheme: Scheme = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (bytes), node (a long for it: the fingerprint itself where it has 64 bits) of whole texts.

    Null and empty texts have fingerprint zero.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *_fingerprints(batch, scheme)[:2]], names=["doc_id", "fp", "node"])
    return pick(df, doc_id=id_col, text=text_col).mapInArrow(make, "doc_id long, fp binary, node long")


def near_groups(df: DataFrame, scheme: Scheme = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, node, root (of its group), component_id (smallest doc_id of the group).

    Null ids belong to groups but name none; a group without an id has component_id null.
    Rows of equal id are rows of their own; other columns are ignored.
    """
    rows = written(fingerprints(df, scheme, id_col, text_col), "prints")
    each = rows.groupBy("node", "fp").agg(F.min("doc_id").alias("low"))
    return named_groups(rows, each, components(written(near_links(each, scheme), "near")))


def named_groups(rows: DataFrame, each: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (doc_id, node) with root and component_id, from the nodes' smallest ids and the roots of those that have links."""
    member = each.join(found, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    named = written(member, "members")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.select("doc_id", "node").join(named.join(least, "root").select("node", "root", "component_id"), "node")


def simhash_components(df: DataFrame, **columns) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: links at 4 or fewer of 64 bits."""
    found = near_groups(df, EXACT, **columns)
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
