"""Re-identification scores: no row per query and gallery vector is ever made or shuffled.

Queries are dealt over tasks, about a thousand each.  The gallery is written once in order of its
ids; a task streams it past its queries block by block and keeps one number per gallery vector
of the few queries in work, so that their whole rankings are settled there.  Right answers
leave a task in order, with their place and the right answers up to it, or added up to one row
per query, so one row per query is shuffled.

Gallery vectors are placed by falling similarity, then by id.  Similarities count as equal
when they agree to ``RESOLUTION``, which is wider than what the order of additions changes.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import running, with_chunks

RESOLUTION = 1e-11
#: Vectors in a block, right answers sent at once, and similarities a task holds.
BLOCK, CHUNK, BLOCK_THRESHOLDS = 2048, 1 << 16, 1 << 23
#: Queries of a task, and bytes of gallery vectors that it does not read again for its next queries.
TASK_QUERIES, HELD = 1024, 96 << 20
#: A similarity's key and its place in the gallery share one number while neither needs more bits.
KEY_BITS, PLACE_BITS = 37, 26
#: Identities that are nobody: distractors and unlabelled crops.
NOBODY = (0, -1)


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """``name``: blocks of about ``BLOCK`` rows, each an array of structs."""
    n = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("long").alias("_n")
    sized = rows.crossJoin(rows.agg(n))  # one row
    return sized.groupBy(F.pmod(F.xxhash64("vec_id"), F.col("_n")).alias("_block")).agg(F.collect_list(F.struct("vec_id", "identity", "camera", "vector")).alias(name)).drop("_block")


def _fields(rows: pa.StructArray, keep: bool = False) -> dict[str, np.ndarray]:
    """Columns of the rows; with ``keep``, vectors in the type they are written in."""
    out = {f.name: rows.field(f.name) for f in rows.type}
    vector = out.pop("vector")
    found = {k: v.to_numpy(zero_copy_only=False) for k, v in out.items()}
    numbers = vector.flatten().to_numpy(zero_copy_only=False)
    return found | {"vector": (numbers if keep else numbers.astype(np.float64)).reshape(len(rows), -1)}


def _similarity(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """All rows of ``a`` with all of ``b``: cosine, or half the summed minima of two normalised halves."""
    if kind == "embedding":
        return _unit(a) @ _unit(b).T
    return np.stack([np.minimum(row, b).sum(axis=1) / 2.0 for row in a])


def _unit(a: np.ndarray) -> np.ndarray:
    return a / _length(a)


def _length(a: np.ndarray) -> np.ndarray:
    return np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)


def _keys(similarity: np.ndarray) -> np.ndarray:
    """Whole numbers that rise as the similarity falls."""
    return -np.rint(similarity / RESOLUTION).astype(np.int64)


def _counts(q: dict, g: dict, junk: bool) -> np.ndarray:
    """Mask of the gallery rows that take part in each query's ranking."""
    if not junk:
        return np.ones((len(q["vec_id"]), len(g["vec_id"])), bool)
    same = (q["identity"][:, None] == g["identity"]) & (q["camera"][:, None] == g["camera"])
    return ~same & ~np.isin(g["identity"], NOBODY)[None, :]


def _per_pair(pairs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(query block, gallery block)`` gives columns, for every pair of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, g in zip(batch.column("q"), batch.column("g")):
                yield pa.RecordBatch.from_pydict(fn(_fields(q.values), _fields(g.values)))
    return pairs.mapInArrow(run, schema)


class _Gallery:
    """The written gallery, block by block.

    Ids, identities, cameras and lengths of all rows are at hand, and vectors of the first blocks
    up to ``HELD`` bytes; those of the others are read again each time.
    """

    def __init__(self, files: Sequence[str]) -> None:
        self.files, self.held, self.columns, room = list(files), [], {}, HELD
        found = {name: [] for name in ("vec_id", "identity", "camera", "length")}
        for n, g in enumerate(self._read()):
            g["length"] = _length(g["vector"].astype(np.float64))[:, 0]
            for name, parts in found.items():
                parts.append(g[name])
            room -= g["vector"].nbytes
            if len(self.held) == n and room >= 0:
                self.held.append(g["vector"])
        if found["vec_id"]:
            self.columns = {name: np.concatenate(parts) for name, parts in found.items()}
        self.sizes = [len(part) for part in found["vec_id"]]
        ids = self.columns.get("vec_id", np.empty(0, np.int64))
        self.ids_differ = bool((ids[1:] > ids[:-1]).all())
        self.finite = bool(np.isfinite(self.columns.get("length", ids)).all())

    def _read(self, skip: int = 0) -> Iterator[dict[str, np.ndarray]]:
        for uri in self.files:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(BLOCK):
                    if batch.num_rows and skip:
                        skip -= 1
                    elif batch.num_rows:
                        yield _fields(batch.to_struct_array(), keep=True)

    def __len__(self) -> int:
        return sum(self.sizes)

    def vectors(self) -> Iterator[np.ndarray]:
        yield from self.held
        if len(self.held) < len(self.sizes):
            yield from (g["vector"] for g in self._read(len(self.held)))


def _places(keys: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many of ``keys`` come before each of its places ``right``; of equal keys the earlier place."""
    ordered, wanted = np.sort(keys), keys[right]
    before = np.searchsorted(ordered, wanted)
    tied = np.unique(wanted[np.searchsorted(ordered, wanted, "right") - before > 1])
    if len(tied):
        near = np.minimum(np.searchsorted(tied, keys), len(tied) - 1)
        group = np.flatnonzero(tied[near] == keys)  # in order of place
        by_key = group[np.argsort(keys[group], kind="stable")]
        nth = np.arange(len(by_key)) - np.searchsorted(keys[by_key], keys[by_key])
        place = np.argsort(by_key)
        among = np.minimum(np.searchsorted(by_key[place], right), len(by_key) - 1)
        before = before + np.where(by_key[place][among] == right, nth[place][among], 0)
    return before


def _answers_in_order(keys: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 0) of the gallery rows of mask ``right``, rising, and these rows.

    A key and its row share a number, so one sort settles places and ties.
    """
    both = (keys << PLACE_BITS) | np.arange(len(keys))
    both.sort()
    both &= (1 << PLACE_BITS) - 1
    at = np.flatnonzero(right[both])
    return at, both[at]


def _places_in_order(keys: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places (from 0) of the gallery rows of mask ``right``, rising.

    The upper bits of a key and its row's mask are sorted, half the bytes of whole keys; whole
    keys are looked at only where answers share their upper bits with other rows.
    """
    short = np.empty(len(keys), "<i4")
    np.right_shift(keys, KEY_BITS - 30, out=short, casting="unsafe")
    short <<= 1
    short |= right
    ordered = np.sort(short)
    at = np.flatnonzero((ordered & 1) != 0)
    found = ordered[at]
    mixed = np.unique(found[1:][found[1:] - ordered[at[1:] - 1] == 1]) if len(at) else found
    if len(at) and at[0] and found[0] - ordered[at[0] - 1] == 1:
        mixed = np.union1d(mixed, found[:1])
    if not len(mixed):
        return at
    short |= 1
    near = np.zeros(1 << 16, bool)
    near[mixed & 0xFFFF] = True
    some = np.flatnonzero(near.take(short.view("<u2")[::2]))  # by the lowest bits
    some = some[np.isin(short[some], mixed)]
    if len(some) * 4 > len(keys):
        return _answers_in_order(keys, right)[0]
    some = some[np.lexsort((some, keys[some]))]
    group = short[some]
    place = np.searchsorted(ordered, group - 1) + np.arange(len(some)) - np.searchsorted(group, group)
    settled = at[~np.isin(found, mixed)]
    return np.sort(np.concatenate([settled, place[right[some]]]))


def _keys_of(queries: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, finite: bool, out: np.ndarray, room: np.ndarray) -> None:
    """``_keys`` of the cosine of vectors of known length with unit vectors over ``-RESOLUTION``; unknown ones come first."""
    found = np.matmul(queries, vectors.T, out=room if room.shape[1] == len(vectors) else None)
    np.divide(found, lengths, out=found)
    np.rint(found, out=found)
    if not finite:
        found[~np.isfinite(found)] = -(1 << KEY_BITS)
    out[...] = found


def ranked_answers(queries: DataFrame, gallery: DataFrame, junk: bool = True, kind: str = "embedding", each: bool = True) -> DataFrame:
    """q_id, g_id, rank (from 1) of every right answer in its query's ranking of the whole gallery, and hits: the right answers up to it.

    ``queries`` and ``gallery``: vec_id, identity, camera, vector.  With ``junk``, the same
    identity on the same camera and the identities of ``NOBODY`` leave the ranking.  Without
    ``each`` the answers of a query are one row, for ``reid_scores``: q_id, first (the least
    rank), answers, and precision, the sum of hits over rank.

    Every query meets every gallery vector in one task, which holds 8 bytes per gallery vector
    of the queries in work (at most ``BLOCK_THRESHOLDS`` numbers, or those of one query).  Rows
    of equal id are one query or one answer, and stretch the places they count in: by the square
    of the query's copies times the answer's.
    """
    columns = ("vec_id", "identity", "camera", "vector")
    files = sorted(cut(gallery.select(*columns).orderBy("vec_id")).inputFiles())
    asked = queries.where("vec_id IS NOT NULL AND identity IS NOT NULL").groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    n = queries.count()
    parts = max(1, -(-n // TASK_QUERIES), min(n // 16, queries.sparkSession.sparkContext.defaultParallelism))

    def answers(q: dict, row: int, places: np.ndarray, at: np.ndarray, g: _Gallery) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ranks of a query's right answers, by rank."""
        ids, weight = g.columns["vec_id"][at], q["copies"][row] ** 2
        if g.ids_differ:
            return ids, places * weight + 1
        order = np.argsort(at)
        ids, first, copies = np.unique(ids[order], return_index=True, return_counts=True)  # the first of equal ids stands before the others
        rank = places[order[first]] * (weight * copies) + 1
        order = np.lexsort((ids, rank))
        return ids[order], rank[order]

    def work(q: dict, g: _Gallery, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray | None, np.ndarray]]:
        """Query, ids and ranks of its right answers, by rank; ids only where asked for."""
        lo, short = 0, kind == "embedding" and len(g) < 1 << PLACE_BITS
        mine, last = _unit(q["vector"]), (1 << KEY_BITS) - 1 if short else np.iinfo(np.int64).max
        finite, scaled, room = g.finite and bool(np.isfinite(mine).all()), mine / -RESOLUTION, np.empty((len(keys), BLOCK))
        for vectors in g.vectors():
            part = keys[:, lo:lo + len(vectors)]
            block = {name: c[lo:lo + len(vectors)] for name, c in g.columns.items()}
            vectors = vectors.astype(np.float64)
            if short:
                _keys_of(scaled, vectors, block["length"], finite, part, room)
            else:
                part[...] = _keys(_similarity(q["vector"], vectors, kind))
            if junk:
                part[~_counts(q, block, junk)] = last
            lo += len(vectors)
        for i in range(len(keys)):
            right = g.columns["identity"] == q["identity"][i]
            if junk:
                right &= _counts({name: q[name][i:i + 1] for name in ("vec_id", "identity", "camera")}, g.columns, junk)[0]
            if not right.any():
                continue
            if short and g.ids_differ and not each:
                yield q["vec_id"][i], None, _places_in_order(keys[i], right) * q["copies"][i] ** 2 + 1
                continue
            if short:
                places, at = _answers_in_order(keys[i], right)
            else:
                at = np.flatnonzero(right)
                places = _places(keys[i], at)
                order = np.lexsort((at, places))
                places, at = places[order], at[order]
            yield q["vec_id"][i], *answers(q, i, places, at, g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, keys, held, n = None, None, [], 0
        for batch in batches:
            if g is None:
                g = _Gallery(files)
            if not len(g):
                continue
            room = max(1, min(batch.num_rows, BLOCK_THRESHOLDS // len(g)))
            if keys is None or len(keys) < room:
                keys = np.empty((room, len(g)), np.int64)
            for start in range(0, batch.num_rows, room):
                q = _fields(batch.slice(start, room).to_struct_array())
                for q_id, ids, rank in work(q, g, keys[:len(q["vec_id"])]):
                    hits = np.arange(1, len(rank) + 1)
                    held.append([np.full(len(rank), q_id), ids, rank, hits] if each else [[q_id], [rank.min()], [len(rank)], [(hits / rank).sum()]])
                    n += len(held[-1][0])
                    if n >= CHUNK:
                        yield send(held)
                        held, n = [], 0
        if held:
            yield send(held)

    fields = [("q_id", "long"), ("g_id", "long"), ("rank", "long"), ("hits", "long")] if each else [("q_id", "long"), ("first", "long"), ("answers", "long"), ("precision", "double")]

    def send(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64 if t == "long" else np.float64)) for c, (_, t) in zip(zip(*held), fields)], [name for name, _ in fields])
    return asked.repartition(parts, "vec_id").mapInArrow(run, ", ".join(f"{name} {t}" for name, t in fields))


def reid_scores(ranked: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Queries, rank-1 and mean average precision per ``group`` of the ranked right answers.

    Queries without a right answer are not in ``ranked`` and are not scored.  Where ``hits``
    is known, a query's answers add up where they are made; they may come added up already.
    """
    key = [*group, "q_id"]
    agg = [F.count("*").alias("queries"), F.avg(F.when(F.col("_first") == 1, 1.0).otherwise(0.0)).alias("rank1"), F.avg("_ap").alias("map")]
    if "precision" in ranked.columns:
        per = ranked.groupBy(*key).agg(F.min("first").alias("_first"), (F.sum("precision") / F.sum("answers")).alias("_ap"))
        return per.groupBy(*group).agg(*agg) if group else per.agg(*agg)
    s = ranked if "hits" in ranked.columns else running(with_chunks(ranked, key, "rank", 1 << 20), key, ["rank"], {"hits": ("count", F.lit(True))})
    per = s.groupBy(*key).agg(F.min("rank").alias("_first"), F.avg(F.col("hits") / F.col("rank")).alias("_ap"))
    return per.groupBy(*group).agg(*agg) if group else per.agg(*agg)


def best_matches(queries: DataFrame, gallery: DataFrame, kind: str = "embedding") -> DataFrame:
    """q_id, compared, best: how many gallery vectors each query met and its highest similarity."""
    def work(q: dict, g: dict) -> dict:
        return {"q_id": pa.array(q["vec_id"]), "n": pa.array(np.full(len(q["vec_id"]), len(g["vec_id"]))), "best": pa.array(_similarity(q["vector"], g["vector"], kind).max(axis=1))}
    found = _per_pair(_blocks(queries, "q").crossJoin(_blocks(gallery, "g")), work, "q_id long, n long, best double")
    return found.groupBy("q_id").agg(F.sum("n").alias("compared"), F.max("best").alias("best"))


def both_directions(first: DataFrame, second: DataFrame, names: tuple[str, str], kind: str = "embedding", each: bool = True) -> DataFrame:
    """Ranked right answers of either side's crops in the other's, with column direction; no camera rule."""
    way = lambda q, g, name: ranked_answers(q, g, junk=False, kind=kind, each=each).withColumn("direction", F.lit(name))
    return way(first, second, names[0]).unionByName(way(second, first, names[1]))


def trial_ranks(crops: DataFrame, trials: Sequence[int], modal, names: tuple[str, str], kind: str = "embedding", each: bool = True) -> DataFrame:
    """Ranked right answers of repeated trials, both directions, with columns trial and direction.

    Each trial is a seeded draw over all identities: about half of them, by the first digit
    of SHA-256 of ``trial|identity``, are its test set with all their crops.  ``modal`` is
    the condition that parts the two modalities.
    """
    every = None
    for t in trials:
        own = crops.where(F.substring(F.sha2(F.concat_ws("|", F.lit(str(t)), F.col("identity").cast("string")), 256), 1, 1) < "8")
        one = both_directions(own.where(modal), own.where(~modal), names, kind, each).withColumn("trial", F.lit(t))
        every = one if every is None else every.unionByName(one)
    return every


def first_as_query(crops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First crop of each identity queries, the rest is the gallery; lone crops go."""
    firsts = crops.groupBy("identity").agg(F.min("vec_id").alias("_f"), F.count("*").alias("_n")).where("_n >= 2")
    j = crops.join(firsts, "identity")
    return j.where("vec_id = _f").drop("_f", "_n"), j.where("vec_id <> _f").drop("_f", "_n")


def modality_gap(scores: DataFrame, base: str, other: str, group: str) -> DataFrame:
    """Loss of rank-1 and mean average precision from the ``base`` row of ``group`` to the ``other``."""
    of = lambda value, column: F.max(F.when(F.col(group) == value, F.col(column)))
    return scores.agg(*[(of(base, c) - of(other, c)).alias(f"{c}_drop") for c in ("rank1", "map")])


def mean_of_trials(scores: DataFrame, group: Sequence[str]) -> DataFrame:
    """Average of rank-1 and mean average precision over the trials of each group."""
    return scores.groupBy(*group).agg(F.count("*").alias("trials"), F.avg("rank1").alias("rank1"), F.avg("map").alias("map"))
