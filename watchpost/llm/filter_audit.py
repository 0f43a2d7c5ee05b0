"""Filter interaction audit from failing-id relations.

Each filter leaves one table of the rows that fail it.  The rows that outlive a set of
filters are left-anti joins with the tables of the set; what a further filter removes from
them stands in a left-semi join with its table.  An order of filters only ever asks for such
sets, so the 120 orders of five filters need 32 sets and 80 (set, next filter) pairs.  A
chain of anti joins, one a filter, makes all sets at once: every row stands with the filter
in its set and without it.

All joins share the key (id, mark): each table is shuffled once whatever the number of
filters, and joins and partial counts run inside that partitioning.  Rows that fail nothing
never enter a join.

Rows: null texts are empty.  A null id is a row of its own that no label names and that is
never a later copy.  Rows equal in id, part and text are counted as often as they stand.
Several labels of an id: it is good (toxic) if any of them says so.  An empty table gives
an empty result.  Other columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from .common import pick, portions, texts, written

KEY = ["id", "mark"]
MARKS = re.compile(rb"[#$%&*|]")
MEASURES = {"digest": pa.binary(), "n_words": pa.int64(), "n_different": pa.int64(), "n_capitals": pa.int64(), "n_chars": pa.int64(), "has_marks": pa.bool_()}
#: Failure conditions of one row, over the columns of ``facts``.
ROW_FILTERS: dict[str, str] = {
    "A": "n_words < 200",
    "B": "100 * n_different < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "has_marks",
}
#: Letter of the filter that fails every row whose text stands under a smaller id.
LATER_COPY = "E"


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, mark, part, digest (SHA-256) of the text, and the measures that filters read."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole):
                each = [_measures(text or b"") for text in texts(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), *[pa.array(c, t) for c, t in zip(zip(*each), MEASURES.values())]],
                                                 names=["id", "part", *MEASURES])
    own = pick(docs, id=id_col, text=text_col, part=part_col).select("id", F.coalesce("part", F.lit("")).alias("part"), "text")
    measured = own.mapInArrow(measure, T.StructType([*own.select("id", "part").schema.fields, *[
        T.StructField(name, from_arrow_type(t)) for name, t in MEASURES.items()]]))
    return measured.withColumn("mark", F.xxhash64(F.col("id").isNull(), "part", "digest"))


def _measures(text: bytes) -> tuple:
    """Digest, words, different words, capitals A-Z, code points, holds one of ``#$%&*|``."""
    words = text.split()  # of bytes: parted by 0x20 and 0x09 to 0x0D
    data = np.frombuffer(text, np.uint8)
    return (sha256(text).digest(), len(words), len(set(words)), int(np.count_nonzero((data >= 65) & (data <= 90))), int(np.count_nonzero(data & 0xC0 != 0x80)),
            MARKS.search(text) is not None)


def id_tables(rows: DataFrame, row_filters: dict[str, str]) -> dict[str, DataFrame]:
    """One written table (id, mark) of failing rows per filter; ``rows`` holds a flag per row filter."""
    first = rows.groupBy("digest").agg(F.min("id").alias("id"))  # nulls don't count, and are no later copy
    later = rows.where("id IS NOT NULL").join(first, ["digest", "id"], "left_anti")
    tables = {name: rows.where(F.col(name)) for name in row_filters} | {LATER_COPY: later}
    key = [F.coalesce("id", F.lit(0)).alias("id"), "mark"]
    return {name: written(failing.select(*key), f"fails-{name}") for name, failing in tables.items()}


def _failing_rows(rows: DataFrame, labels: DataFrame, fails: dict[str, DataFrame], row_filters: dict[str, str], label_id: str) -> DataFrame:
    """id, mark, part, n (equal rows), good, toxic of all rows that fail any filter."""
    rows = rows.select("id", "mark", "part", F.greatest(*row_filters).alias("fails"), F.coalesce("id", F.lit(0)).alias("key"))
    copies = rows.where("NOT fails").join(fails[LATER_COPY].select(F.col("id").alias("key"), "mark"), ["key", "mark"], "left_semi")
    failing = rows.where("fails").unionByName(copies.select(rows.columns)).groupBy("id", "key", "mark").agg(F.min("part").alias("part"), F.count(F.lit(1)).alias("n"))
    own = pick(labels, id=label_id, quality="quality", toxic="toxic").where("id IS NOT NULL").groupBy("id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 OR toxic = 1")
    known = failing.where("id IS NOT NULL").join(own, "id", "left")
    unknown = failing.where("id IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    flag = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return known.unionByName(unknown).select(F.col("key").alias("id"), "mark", "part", "n", flag("good"), flag("toxic"))


def outlived(rows: DataFrame, fails: dict[str, DataFrame], letters: str) -> DataFrame:
    """``rows`` once for every set of ``letters`` none of whose filters they fail, with that set as column state.

    One left-anti join per filter: each row stands once with the filter in its set and once
    without, and the first of them only stays if the filter's table does not hold it.
    """
    lives = rows.withColumn("state", F.lit(""))
    for c in letters:
        lives = lives.withColumn("added", F.explode(F.array(F.lit(""), F.lit(c)))).alias("l")
        held = fails[c].alias("r")
        lives = lives.join(held, (F.col("l.id") == F.col("r.id")) & (F.col("l.mark") == F.col("r.mark")) & (F.col("l.added") == c), "left_anti")
        lives = lives.withColumn("state", F.concat("state", "added")).drop("added")
    return lives


def set_counts(failing: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """part, state (letters of a set of filters), filter, rows, good, toxic; zeros have no row.

    With a filter: what it removes from those that outlive the set.  With filter null: the
    failing rows that outlive the set.
    """
    letters = "".join(sorted(fails))
    every = outlived(failing, fails, letters).withColumn("filter", F.lit(None).cast("string"))
    for c in letters:
        every = every.union(outlived(failing.join(fails[c], KEY, "left_semi"), fails, letters.replace(c, "")).withColumn("filter", F.lit(c)))
    return every.groupBy("part", "state", "filter").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, row_filters: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
          label_id: str = "doc_id") -> DataFrame:
    """What each filter does at each place of each order, per part of the documents.

    ``row_filters``: failure conditions over the measures of ``facts``, by letters that
    precede ``LATER_COPY``.  Columns part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.
    """
    row_filters = row_filters or ROW_FILTERS
    rows = written(facts(docs, id_col, text_col, part_col).select("id", "mark", "part", "digest", *[F.expr(f).alias(c) for c, f in row_filters.items()]), "facts")
    fails = id_tables(rows, row_filters)
    failing = written(_failing_rows(rows, labels, fails, row_filters, label_id), "failing")
    counts = written(set_counts(failing, fails), "counts")
    gone = counts.where("filter IS NOT NULL").select("part", "state", "filter", F.col("rows").alias("removed"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"))
    left = counts.where("filter IS NULL").select("part", F.col("state").alias("through"), F.col("rows").alias("survivors"))
    failed = failing.groupBy("part").agg(F.sum("n").alias("n_failing"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(sorted(fails))])
    places = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs")).select("part", "n_docs", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(fails)))).alias("step"))
    letters = lambda upto: F.array_join(F.array_sort(F.split(F.expr(f"substring(filter_order, 1, {upto})"), "")), "")
    places = places.join(failed, "part", "left").withColumns({"filter": F.expr("substring(filter_order, step, 1)"), "state": letters("step - 1"), "through": letters("step")})
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    each = places.join(gone, ["part", "state", "filter"], "left").join(left, ["part", "through"], "left").select(
        "part", "filter_order", "step", "filter", (F.col("n_docs") - zero("n_failing") + zero("survivors")).alias("kept"), zero("removed"), zero("good_lost"), zero("toxic_lost"))
    same = Window.partitionBy("part", "filter")
    return each.select(
        "part", "filter_order", "step", "kept", "removed", (F.max(F.when(F.col("step") == 1, F.col("removed"))).over(same) - F.col("removed")).alias("redundant"),
        F.max(F.when(F.col("step") == len(fails), F.col("removed"))).over(same).alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(same).alias("shapley"))
