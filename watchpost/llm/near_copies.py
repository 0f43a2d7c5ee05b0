"""Near copies: groups of texts whose 5-word shingle sets are 0.8 similar or more.

SimHash fields let candidates meet (``simhash.SIMILAR``: at a similarity of 0.8 a pair meets
in one of the 24 fields with probability 0.29 and passes the bits with 0.9999; 0.21 and 0.995
for texts of four and five shingles).  The similarity itself decides: groups of candidates
get their shingle hashes, all their pairs within the bits are counted, and only those at 0.8
or more are links.

Both steps take two rounds, so that a group of g near copies costs links and bytes in
proportion to g.  The first round compares every part of a crowded anchor or group with
itself and with one pivot part.  What it joins gets a label, and the second round only
compares parts whose rows are not yet of one label, and only links two labels.  Rows of large
labels and of small ones go to parts of their own, so a large label is never dealt to itself.
No pair of different labels is left out: both rounds together decide every candidate pair
that could join two groups.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, give_back, pick, portions, texts, written
from .components import components, contract
from .simhash import SIMILAR, Scheme, _fingerprints, _forest, _majority, _similar, anchors, digest, named_groups, shingles

#: Fields of the first round; only homes take part in it.
FIRST_FIELDS = 2
#: Links that one task folds before the rounds of components.
FOLDED = 250_000


def _part(n: str, salt: int) -> F.Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.greatest(F.col(n), F.lit(1))).cast("int")


def with_pivots(rows: DataFrame) -> DataFrame:
    """Rows of ``n`` parts as tiles (part, own): each part with all its rows and those of part 0, which are not its own."""
    part = _part("n", 2)
    one = F.array(F.struct(F.lit(0).alias("part"), F.lit(True).alias("own")))  # most groups are one part: no lambda runs for them
    places = F.when(F.col("n") <= 1, one).when(part == 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1), lambda k: F.struct(k.alias("part"), (k == 0).alias("own")))).otherwise(
        F.array(F.struct(part.alias("part"), F.lit(True).alias("own"))))
    return rows.withColumn("tile", F.explode(places)).select(*[c for c in rows.columns if c != "n"], "tile.part", "tile.own")


def across_labels(rows: DataFrame) -> DataFrame:
    """Tiles (i, j, side) in which all rows of different labels meet.

    ``rows`` carries big (its label is a large one), and for its group n_small and n_big (parts
    of either kind) and one_big (all big rows have one label, so big parts need not meet).
    """
    small, every = F.col("n_small"), F.col("n_small") + F.col("n_big")
    own = F.when(F.col("big"), small + _part("n_big", 3)).otherwise(_part("n_small", 3)).cast("int")
    upto = F.when(F.col("big") & F.col("one_big"), small).otherwise(every)
    other = F.when(upto > 0, F.sequence(F.lit(0), F.greatest(upto.cast("int"), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    places = F.when((every <= 1) & ~F.col("big"), one).otherwise(
        F.transform(other, lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), (own > k).cast("int").alias("side"))))
    return rows.withColumn("tile", F.explode(places)).select(*[c for c in rows.columns if c not in ("n_small", "n_big", "one_big", "big")], "tile.i", "tile.j", "tile.side")


def _group_parts(rows: DataFrame, group: list[str], parts: Callable) -> DataFrame:
    """``group``, n_small, n_big, one_big of the groups that hold more than one label."""
    big = F.col("big")
    kinds = rows.groupBy(*group).agg(
        parts(~big).alias("n_small"), parts(big).alias("n_big"), F.min(F.when(big, F.col("label"))).alias("b0"), F.max(F.when(big, F.col("label"))).alias("b1"),
        F.min("label").alias("l0"), F.max("label").alias("l1"))
    return kinds.where("l0 < l1").select(*group, "n_small", "n_big", F.coalesce(F.col("b0") == F.col("b1"), F.lit(True)).alias("one_big"))


def with_labels(nodes: DataFrame, found: DataFrame, tile_rows: int) -> DataFrame:
    """``nodes`` with label (the root found so far, or the node) and big (over ``tile_rows`` nodes bear it)."""
    large = found.groupBy("root").count().where(F.col("count") > tile_rows).select("root", F.lit(True).alias("big"))
    return nodes.join(found.join(large, "root", "left"), "node", "left").select(
        *nodes.columns, F.coalesce("root", "node").alias("label"), F.coalesce("big", F.lit(False)).alias("big"))


def _tiles(rows: DataFrame, keys: list[str], work) -> DataFrame:
    """Links a < b that ``work(columns)`` finds in each tile of ``keys``; rows marked ``lead`` come first in a tile.

    Tiles of one row, without a leading row or with one label alone are passed over.
    """
    names, step = rows.columns, 512 if "shingles" in rows.columns else 1 << 14
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("lead").desc())

    def links(columns: list[np.ndarray], change: np.ndarray) -> pa.RecordBatch:
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])]
        lead, label = columns[names.index("lead")], columns[names.index("label")] if "label" in names else None
        found = [(np.zeros(0, np.int64),) * 2]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if stop - start > 1 and lead[start] and (label is None or (label[start + 1:stop] != label[start]).any()):
                found.append(work({c: v[start:stop] for c, v in zip(names, columns)}))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    def changes(columns: list[np.ndarray]) -> np.ndarray:
        """Whether the row after each row is of another tile."""
        change = np.zeros(max(0, len(columns[0]) - 1), bool)
        for c in keys:
            k = columns[names.index(c)]
            change |= k[1:] != k[:-1]
        return change

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # of the last tile, which may go on
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if not len(columns[0]):
                continue
            change = changes(columns)
            same = held and all(held[-1][names.index(c)][-1] == columns[names.index(c)][0] for c in keys)
            if held and (not same or change.any()):  # the held tile ends in this batch
                first = (int(np.flatnonzero(change)[0]) + 1 if change.any() else len(columns[0])) if same else 0
                whole = [np.concatenate([*(h[k] for h in held), c[:first]]) for k, c in enumerate(columns)]
                yield links(whole, changes(whole))
                held, columns, change = [], [c[first:] for c in columns], change[first:]
            if not held and change.any():
                last = int(np.flatnonzero(change)[-1]) + 1
                yield links([c[:last] for c in columns], change[:last - 1])
                columns = [c[last:] for c in columns]
            held.append(columns)
        if held:
            whole = [np.concatenate([h[k] for h in held]) for k in range(len(names))]
            yield links(whole, changes(whole))
        give_back()
    return dealt.mapInArrow(compare, "a long, b long")


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots of all nodes linked so far (node, root)."""
    links = written(links, "links")
    n = links.count()
    if found is not None and not n:
        return found
    # folded in larger parts first, the rounds that follow have little left to join
    links = contract(links.coalesce(max(8, -(-n // FOLDED))))
    if found is not None:
        links = links.unionByName(found.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    return written(components(links), "found")


def candidates(each: DataFrame, scheme: Scheme = SIMILAR, tile_rows: int = 2048) -> DataFrame:
    """node, root of the groups that pairs within the bits form; ``each`` holds node and fp, different nodes."""
    check = [f"c{k}" for k in range(len(scheme.check))]
    bits = ", ".join(f"{c} long" for c in check)

    def covered(nodes: DataFrame, fields: int, homes_only: bool, carried: list[str]) -> DataFrame:
        def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), "<u8").reshape(-1, scheme.words)
                    own = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("node", *carried)}
                    for choice, row, anchor, home in anchors(fp, scheme, fields):
                        if homes_only:
                            row, anchor, home = row[home], anchor[home], home[home]
                        yield pa.RecordBatch.from_pydict({
                            "choice": pa.array(np.full(len(row), choice, np.int64)), "anchor": pa.array(anchor), "home": pa.array(home), **{c: pa.array(v[row]) for c, v in own.items()},
                            **{c: pa.array(fp[row, w].view(np.int64)) for c, w in zip(check, scheme.check)}})
        types = {"label": "long", "big": "boolean"}
        return nodes.select("node", "fp", *carried).mapInArrow(
            cover, "choice long, anchor long, home boolean, node long, " + "".join(f"{c} {types[c]}, " for c in carried) + bits)

    def work(rows: dict) -> tuple[np.ndarray, np.ndarray]:
        prints = np.stack([rows[c] for c in check], 1).view(np.uint64)
        several = "i" in rows and rows["i"][0] != rows["j"][0]
        a, b = _forest(prints, int(rows["lead"].sum()), scheme.threshold, label=rows.get("label"), side=rows["side"] if several else None)
        return rows["node"][a], rows["node"][b]
    parts = lambda condition: F.ceil(F.count_if(condition) / tile_rows).cast("int")
    # at most 4096 anchors a field, so what is broadcast has at most 24 * 4096 rows whatever the documents
    once = covered(each, FIRST_FIELDS, True, [])
    crowd = once.groupBy("choice", "anchor").agg(parts(F.lit(True)).alias("n")).where("n > 1")
    dealt = with_pivots(once.join(F.broadcast(crowd), ["choice", "anchor"], "left").withColumn("n", F.coalesce("n", F.lit(1))))
    dealt = dealt.select("choice", "anchor", "part", "node", F.col("own").alias("lead"), *check)
    found = _joined(None, _tiles(dealt, ["choice", "anchor", "part"], work))
    labelled = written(with_labels(each.select("node", "fp"), found, tile_rows), "labelled")
    every = covered(labelled, len(scheme.fields), False, ["label", "big"])
    mixed = _group_parts(every, ["choice", "anchor"], parts)
    dealt = across_labels(every.join(F.broadcast(mixed), ["choice", "anchor"])).select("choice", "anchor", "i", "j", "side", "node", "label", F.col("home").alias("lead"), *check)
    return _joined(found, _tiles(dealt, ["choice", "anchor", "i", "j"], work))


def similar(df: DataFrame, rows: DataFrame, groups: DataFrame, scheme: Scheme = SIMILAR, id_col: str = "doc_id", text_col: str = "text",
            tile_rows: int = 256, tile_bytes: int = 8 << 20) -> DataFrame:
    """node, root of the groups that links at ``scheme.jaccard`` form within ``groups`` (node, root).

    ``rows`` holds doc_id, node and weight (bytes of the node's shingle hashes).  A group is
    dealt in parts of at most about ``tile_rows`` texts and ``tile_bytes`` of hashes.
    """
    ids = rows.join(groups, "node", "left_semi").select(F.col("doc_id").alias("__id")).distinct()
    taken = pick(df, doc_id=id_col, text=text_col)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, limit=1 << 20):
                sets = [shingles(t, scheme) for t in texts(part)]
                yield pa.RecordBatch.from_pydict({"node": pa.array([digest(h.tobytes()) for h in sets], pa.int64()), "shingles": pa.array([h.tobytes() for h in sets], pa.binary()),
                                                  "bits": pa.array([_majority(h, scheme.words)[list(scheme.check)].tobytes() for h in sets], pa.binary())})
            give_back()
    made = taken.join(ids, taken["doc_id"].eqNullSafe(ids["__id"]), "left_semi").mapInArrow(make, "node long, shingles binary, bits binary")
    sets = written(made.join(groups, "node").dropDuplicates(["node"]), "sets")
    weights = groups.join(rows.groupBy("node").agg(F.first("weight").alias("weight")), "node")

    def parts(condition: F.Column) -> F.Column:
        return F.ceil(F.greatest(F.count_if(condition) / tile_rows, F.sum(F.when(condition, F.col("weight")).otherwise(0)) / tile_bytes)).cast("int")

    def work(rows: dict) -> tuple[np.ndarray, np.ndarray]:
        prints = np.frombuffer(b"".join(rows["bits"]), "<u8").reshape(len(rows["bits"]), -1)
        several = "i" in rows and rows["i"][0] != rows["j"][0]
        homes = int(rows["lead"].sum()) if several or "i" not in rows else len(prints)
        a, b = _forest(prints, homes, scheme.threshold, label=rows.get("label"), side=rows["side"] if several else None,
                       test=_similar([np.frombuffer(x, "<u8") for x in rows["shingles"]], scheme.jaccard))
        return rows["node"][a], rows["node"][b]
    crowd = weights.groupBy("root").agg(parts(F.lit(True)).alias("n")).where("n > 1")
    crowded = groups.join(crowd, "root").select("node", "n")
    dealt = with_pivots(sets.join(crowded, "node", "left").withColumn("n", F.coalesce("n", F.lit(1))))
    dealt = dealt.select("root", "part", "node", F.col("own").alias("lead"), "bits", "shingles")
    found = _joined(None, _tiles(dealt, ["root", "part"], work))
    labelled = written(with_labels(weights.join(crowd.select("root"), "root", "left_semi").select("node", F.col("root").alias("within"), "weight"), found, tile_rows), "labelled")
    if labelled.isEmpty():  # every group was one part: round one has compared all
        return found
    mixed = _group_parts(labelled, ["within"], parts)
    still = labelled.join(mixed, "within").select("node", "label", "big", "n_small", "n_big", "one_big")
    dealt = across_labels(sets.join(still, "node")).select("root", "i", "j", "side", "node", "label", (F.col("side") == 0).alias("lead"), "bits", "shingles")
    return _joined(found, _tiles(dealt, ["root", "i", "j"], work))


def near_groups(df: DataFrame, scheme: Scheme = SIMILAR, id_col: str = "doc_id", text_col: str = "text", **tiles) -> DataFrame:
    """Per row: doc_id, node (one for each different shingle set), root (of its group), component_id (smallest doc_id of the group).

    Null and empty texts have the empty set and are one group.  Null ids belong to groups but
    name none; rows of equal id are rows of their own; other columns are ignored.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, limit=1 << 20):
                prints, nodes, sizes = _fingerprints(part, scheme)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), prints, nodes, sizes], names=["doc_id", "fp", "node", "weight"])
            give_back()
    rows = written(pick(df, doc_id=id_col, text=text_col).mapInArrow(make, "doc_id long, fp binary, node long, weight long"), "prints")
    each = written(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp")), "nodes")
    found = candidates(each, scheme)
    return named_groups(rows, each, similar(df, rows, found, scheme, id_col, text_col, **tiles))


def drop_near_copies(df: DataFrame, scheme: Scheme = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays, that of the smallest id, with all its columns.

    Where a group has only null ids, or its smallest id on several rows, the row of the
    smallest text among those stays.  An empty table gives an empty one, and null texts are
    empty texts.  Columns of any name pass through.
    """
    found = near_groups(df, scheme, id_col=id_col, text_col=text_col)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ident, node, root, at = (free_name(df, c) for c in ("id", "node", "root", "at"))
    rows = stays.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("doc_id", ident)
    simple = rows.where((F.col("rows") == 1) & F.col(ident).isNotNull()).select(ident)
    odd = rows.where((F.col("rows") > 1) | F.col(ident).isNull()).select(ident)
    once = df.join(simple, df[id_col] == simple[ident], "left_semi")
    rest = df.join(odd, df[id_col].eqNullSafe(odd[ident]), "left_semi")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _fingerprints(batch, scheme, text_col)[1]], names=[*batch.schema.names, node])
    roots = stays.select(F.col("node").alias(node), F.col("root").alias(root)).distinct()
    marked = rest.mapInArrow(mark, T.StructType([*df.schema.fields, T.StructField(node, T.LongType())]))
    order = F.row_number().over(Window.partitionBy(root).orderBy(F.col(f"`{text_col}`")))
    least = marked.join(roots, node).withColumn(at, order).where(F.col(at) == 1)
    columns = [F.col(f"`{c}`") for c in df.columns]
    return once.select(*columns).unionByName(least.select(*columns))
