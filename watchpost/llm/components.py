"""Connected components of an edge table, in rounds of joins with written results."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its group) for the nodes of these edges that are not their group's smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while not (new == (jump := new[new])).all():
            new = jump
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


#: Edges that a task holds before it replaces them by a forest.
HELD_EDGES = 1 << 20


def contract(edges: DataFrame) -> DataFrame:
    """The edges of each task replaced by star forests with the same groups, in bounded memory."""
    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            node, root = _roots(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
            return root, node

        def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_pydict({"a": pa.array(a[at:at + (1 << 16)]), "b": pa.array(b[at:at + (1 << 16)])})
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
            if n >= HELD_EDGES:
                held = [folded()]
                n = len(held[0][0])
                if n > HELD_EDGES // 2:
                    yield from out(*held[0])
                    held, n = [], 0
        if n:
            yield from out(*folded())
    return edges.mapInArrow(forest, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns node, root (the smallest node reachable) for every node of ``edges`` (a, b).

    Alternating large-star and small-star rounds; a round groups by node with partial
    minima, so a hub costs a row per task.  Rounds grow with the logarithm of the longest
    path.  Every round is written, so a lost executor repeats no earlier round.
    """
    links = written(contract(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")).distinct(), "links")
    for _ in range(most_rounds):
        # large star: neighbours above a node move to the smallest node around it
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = contract(both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")))
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        new = written(contract(small.where("a < b")).distinct(), "links")
        # settled when the links are stars: no node is both a root and a member
        if new.select(F.col("a").alias("x")).join(new.select(F.col("b").alias("x")), "x", "left_semi").isEmpty() and \
                new.groupBy("b").count().where("count > 1").isEmpty():
            links = new
            break
        links = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
