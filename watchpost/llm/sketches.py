"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the k smallest different 64-bit hashes of a text's shingles.
The k smallest of two sketches together are the sketch of both texts' shingles, so sketches
of parts merge (``merged``, ``merge_parts``); of those, the share that stands in both
estimates resemblance, and the k-th smallest tells how many shingles there are.  Texts of k
shingles or fewer are described exactly.

Shingles are runs of ``size`` words (A-Z lower-cased, parted by ASCII blanks); a text of
fewer words is one shingle, a text without words has none.  Hashing goes by word first: a
shingle's hash is that of its words' hashes, so no shingle is ever spelled out.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

K, SIZE = 128, 5
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, size: int = SIZE) -> DataFrame:
    """``df`` with the sketch (array of longs, rising) of column ``text`` as ``name``; null is empty.

    Columns ``__words`` and ``__shingles`` of ``df`` would be replaced and dropped.
    """
    split = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACES), "")
    words = F.col("__words")
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    runs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, size)]))
    return df.withColumn("__words", F.transform(split, lambda w: F.xxhash64(w))).withColumn(
        "__shingles", F.when(F.size(words) >= size, runs).otherwise(whole)).withColumn(
        name, F.slice(F.sort_array(F.array_distinct("__shingles")), 1, k)).drop("__words", "__shingles")


def merged(a, b, k: int = K) -> Column:
    """Sketch of the shingles of both."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(df: DataFrame, by: str, sketch: str, k: int = K) -> DataFrame:
    """``by``, ``sketch``: one sketch for all rows of a group, however large.

    Every task sends at most k hashes of a group (duplicates combine first, ranks are cut
    before the shuffle), so no group is collected.  Null is a group like others; null
    sketches count as empty.
    """
    each = pick(df, group=by, sketch=sketch).select("group", F.explode_outer("sketch").alias("h")).distinct()
    first = each.withColumn("at", F.row_number().over(Window.partitionBy("group").orderBy(F.col("h").asc_nulls_last()))).where(F.col("at") <= k)
    return first.groupBy("group").agg(F.sort_array(F.collect_list("h")).alias(sketch)).withColumnRenamed("group", by)


def _shared(a, b, k: int) -> tuple[Column, Column]:
    """Of the k smallest of both, how many stand in both; and how many there are."""
    both = merged(a, b, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), both)), F.size(both)


def resemblance(a, b, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty sets."""
    shared, n = _shared(F.col(a), F.col(b), k)
    return F.when(n > 0, shared / n).otherwise(F.lit(1.0))


def distinct_shingles(a, k: int = K) -> Column:
    """Estimated number of different shingles; exact below k."""
    a = F.col(a) if isinstance(a, str) else a
    reach = (F.element_at(a, k).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that stand in b: |A and B| / |A|, at most 1; 1 for an empty a."""
    union = distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(a) -> Column:
    """A sketch as hexadecimal digits, 16 a hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def next_rows(df: DataFrame) -> DataFrame:
    """Each different row of ``df`` (id, mark and others) with next_id, next_mark: its follower by falling id.

    The last row's follower is the first.  Rows are ranged over tasks by (id, mark) and
    numbered within a range; only the first row of every range is looked up across ranges.
    """
    order = [F.col("id").desc_nulls_last(), F.col("mark")]
    ranged = written(df.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    row = F.struct("id", "mark")
    within = ranged.withColumn("next", F.lead(row).over(Window.partitionBy("part").orderBy(*order)))
    heads = ranged.groupBy("part").agg(F.min_by(row, F.struct(F.col("id").isNull(), -F.col("id"), "mark")).alias("head"))
    # one row per range, so as many as tasks: these alone are ordered in one window
    ring = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring)).alias("after"))
    found = within.join(heads, "part").withColumn("next", F.coalesce("next", "after"))
    return found.select(*df.columns, F.col("next.id").alias("next_id"), F.col("next.mark").alias("next_mark"))


def edited_likeness(df: DataFrame, k: int = K, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's sketch, that of its edited text, and how alike they and the next text are.

    Edited: the last third of the code points gives way to as many first ones (or all) of
    the next document by falling id; the last document's next is the first.  Columns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the
    estimates n_shingles and contained (share of the text's shingles that the edited text keeps).

    Null texts are empty.  Null ids come last, rows of equal id by a hash of their text;
    rows equal in id and text all have the next different row (or themselves, if there is no
    other).  An empty table gives no rows; other columns are ignored.
    """
    key = ["key", "none", "mark"]
    own = pick(df, id=id_col, text=text_col).select(
        F.coalesce("id", F.lit(0)).alias("key"), F.col("id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("mark", F.xxhash64("text"))
    ident = F.when(~F.col("none"), F.col("key"))
    pairs = next_rows(own.select(ident.alias("id"), "mark", F.floor(F.char_length("text") / 3).cast("int").alias("third"))).select(
        F.coalesce("id", F.lit(0)).alias("own_key"), F.col("id").isNull().alias("own_none"), F.col("mark").alias("own_mark"), "third",
        F.coalesce("next_id", F.lit(0)).alias("key"), F.col("next_id").isNull().alias("none"), F.col("next_mark").alias("mark"))
    # both uses of this read the same columns under the same keys, so one shuffle of the texts serves both
    sketched = with_sketch(own, "text", "sketch", k, size).select(*key, "text", "sketch")
    heads = sketched.hint("merge").join(pairs, key).select(
        F.col("own_key").alias("key"), F.col("own_none").alias("none"), F.col("own_mark").alias("mark"),
        F.substring("text", F.lit(1), F.col("third")).alias("head"), F.col("sketch").alias("next_sketch"))
    if not own.groupBy(*key).count().where("count > 1").isEmpty():  # a repeated row would bring its head as often
        heads = heads.dropDuplicates(key)
    n, third = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    both = sketched.hint("merge").join(heads, key).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), "head"))
    done = with_sketch(both, "edited", "edited_sketch", k, size)
    return done.select(
        ident.alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"), resemblance("sketch", "edited_sketch", k).alias("near_edited"),
        resemblance("sketch", "next_sketch", k).alias("near_next"), distinct_shingles("sketch", k).alias("n_shingles"), containment("sketch", "edited_sketch", k).alias("contained"))
