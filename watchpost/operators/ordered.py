"""Order-dependent column operators that survive a hot key.

``Window.partitionBy(key)`` sends every row of a key to one task.  That is the
best plan while the largest key fits a task, and a serial job once one busy
camera or node holds a large share of the rows.  ``with_chunks`` measures the
largest key (one count per key, combined map-side) and picks the plan:

* bounded keys: plain windows, one shuffle for a whole chain of operators, into as
  many tasks as the rows need;
* a hot key: the timeline is cut into *chunks*.  Each chunk is windowed in
  parallel and also pre-aggregated to one summary row; only the summaries are
  windowed over the whole key, giving the carry-in of each chunk.  Inputs are cut
  with a checkpoint because each is read twice.

Both give exactly the same rows.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

CHUNK = "_chunk"
TARGET_ROWS = 2_000_000
TASK_ROWS = 200_000      # rows of bounded keys a task sorts
BROADCAST_ROWS = 500_000
SITE_ROWS = 50_000       # rows of a table of zones or cameras that may be broadcast
_SUBS = 1 << 16          # finest split of one bucket


def with_chunks(df: DataFrame, keys: Sequence[str], position: str, width: int,
                target_rows: int | None = None,
                bound: tuple[DataFrame, Sequence[str]] | None = None) -> DataFrame:
    """Add ``_chunk`` when some key exceeds ``target_rows``; else return ``df``.

    ``bound`` names a cheaper table and keys (none: all rows) whose largest group
    bounds this one; only when that is too large is ``df`` itself counted.
    ``_chunk`` is an id that grows with ``position`` inside each key.

    ``position`` is an integral column (epoch microseconds, frame number).  Keys
    within ``target_rows`` stay in one chunk.  A hot key's buckets of ``width``
    positions are counted; neighbouring small buckets share a chunk of about
    ``target_rows`` rows and a crowded bucket is split into equal ranges of the
    positions it really holds.  Rows with the same position always share a chunk.
    """
    if df.isStreaming:
        return df
    target_rows = target_rows or TARGET_ROWS
    if bound is not None and largest_key(*bound) <= target_rows:
        return df.drop(CHUNK)
    largest, rows = _sizes(df, keys)
    if largest <= target_rows:
        return dealt(df.drop(CHUNK), keys, rows)
    df = cut(df.drop(CHUNK))
    bucket = F.floor(F.col(position) / F.lit(width)).cast("long")
    base = df.withColumn("_bucket", bucket)
    hist = cut(base.groupBy(*keys, "_bucket").agg(
        F.count("*").alias("_n"), F.min(position).alias("_lo"), F.max(position).alias("_hi")))
    hot = hist.groupBy(*keys).agg(F.sum("_n").alias("_all")).where(F.col("_all") > target_rows).select(*keys)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    plan = cut(hist.join(hot, list(keys)).select(
        *keys, "_bucket", "_lo", (F.col("_hi") - F.col("_lo") + 1).alias("_span"), F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / target_rows).cast("long").alias("_base"),
        F.least(F.ceil(F.col("_n") / target_rows), F.lit(_SUBS - 1)).cast("long").alias("_parts")))
    # one row per bucket of a hot key: small for any sane width, but checked
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    offset = (F.col(position) - F.col("_lo")).cast("double")
    sub = F.floor(offset * F.col("_parts") / F.col("_span")).cast("long")
    return (base.join(plan, [*keys, "_bucket"], "left")
            .withColumn(CHUNK, F.coalesce(F.col("_base") * F.lit(_SUBS) + sub, F.lit(0).cast("long")))
            .select(*df.columns, CHUNK))


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` with all rows of a key in one task, and tasks of about ``TASK_ROWS`` rows once the table has more."""
    if not keys or rows <= TASK_ROWS:
        return df
    return df.repartition(max(-(-rows // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def beside(site: DataFrame) -> DataFrame:
    """A table of a site's zones or cameras to join rows with: broadcast while it is small (measured).

    A table made in the session has no size the optimizer knows; joined by shuffle, it would
    bring all rows of a camera into one task.
    """
    return F.broadcast(site) if site.limit(SITE_ROWS + 1).count() <= SITE_ROWS else site


def _join_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the one summary row of each (key, chunk).  Keys must not be null."""
    return df.join(carry, [*keys, CHUNK], "left")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            outputs: Mapping[str, tuple[str, Column | str]]) -> DataFrame:
    """Running aggregates from a key's first row to the current row, inclusive.

    ``outputs`` maps a new column to ``(kind, column)``; kind is ``sum``,
    ``count`` (of true conditions), ``max``, ``min``, ``last`` or ``first``
    (latest / earliest non-null value).
    """
    if CHUNK not in df.columns:
        whole = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        plain = {}
        for name, (kind, what) in outputs.items():
            col = F.col(what) if isinstance(what, str) else what
            if kind == "count":
                plain[name] = F.count(F.when(col, 1)).over(whole)
            elif kind in ("last", "first"):
                plain[name] = getattr(F, kind)(col, ignorenulls=True).over(whole)
            else:
                plain[name] = getattr(F, kind)(col).over(whole)
        return df.withColumns(plain)
    df = cut(df)
    inner = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    spot = F.struct(*[F.col(o) for o in order])

    locals_, totals, carries, finals = {}, [], [], {}
    for name, (kind, what) in outputs.items():
        col = F.col(what) if isinstance(what, str) else what
        if kind == "count":
            kind, col = "sum", F.when(col, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        lname, tname, cname = f"_l_{name}", f"_t_{name}", f"_p_{name}"
        if kind in ("sum", "max", "min"):
            agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
            locals_[lname] = agg(col).over(inner)
            totals.append(agg(col).alias(tname))
            carries.append(agg(F.col(tname)).over(before).alias(cname))
            if kind == "sum":
                # an all-null prefix stays null, as in a plain window
                finals[name] = F.when(F.col(cname).isNull(), F.col(lname)).when(
                    F.col(lname).isNull(), F.col(cname)).otherwise(F.col(cname) + F.col(lname))
            else:
                finals[name] = (F.greatest if kind == "max" else F.least)(F.col(cname), F.col(lname))
        elif kind in ("last", "first"):
            pick = F.last if kind == "last" else F.first
            by = F.max_by if kind == "last" else F.min_by
            locals_[lname] = pick(col, ignorenulls=True).over(inner)
            totals.append(by(col, F.when(col.isNotNull(), spot)).alias(tname))
            carries.append(pick(F.col(tname), ignorenulls=True).over(before).alias(cname))
            finals[name] = (F.coalesce(F.col(lname), F.col(cname)) if kind == "last"
                            else F.coalesce(F.col(cname), F.col(lname)))
        else:
            raise ValueError(f"unknown running aggregate {kind!r}")

    summary = df.groupBy(*keys, CHUNK).agg(*totals)
    carry = summary.select(*keys, CHUNK, *carries)
    out = _join_carry(df, carry, keys).withColumns(locals_).withColumns(finals)
    return out.drop(*locals_, *[f"_p_{n}" for n in outputs])


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               back: Mapping[str, Column | str] | None = None,
               ahead: Mapping[str, Column | str] | None = None) -> DataFrame:
    """``lag(1)`` columns (``back``) and ``lead(1)`` columns (``ahead``)."""
    back, ahead = dict(back or {}), dict(ahead or {})
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    if CHUNK not in df.columns:
        whole = W.partitionBy(*keys).orderBy(*order)
        return df.withColumns({**{n: F.lag(as_col(c)).over(whole) for n, c in back.items()},
                               **{n: F.lead(as_col(c)).over(whole) for n, c in ahead.items()}})
    df = cut(df)
    spot = F.struct(*[F.col(o) for o in order])
    inner = W.partitionBy(*keys, CHUNK).orderBy(*order)
    across = W.partitionBy(*keys).orderBy(CHUNK)
    totals, carries, locals_, finals, temp = [], [], {}, {}, []
    if back:
        totals.append(F.max_by(F.struct(*[as_col(c).alias(n) for n, c in back.items()]), spot).alias("_tail"))
        carries.append(F.lag("_tail").over(across).alias("_ptail"))
        locals_["_lb"] = F.lag(F.struct(*[as_col(c).alias(n) for n, c in back.items()])).over(inner)
        for n in back:
            finals[n] = F.when(F.col("_lb").isNotNull(), F.col("_lb")[n]).otherwise(F.col("_ptail")[n])
        temp += ["_lb", "_ptail"]
    if ahead:
        totals.append(F.min_by(F.struct(*[as_col(c).alias(n) for n, c in ahead.items()]), spot).alias("_head"))
        carries.append(F.lead("_head").over(across).alias("_nhead"))
        locals_["_la"] = F.lead(F.struct(*[as_col(c).alias(n) for n, c in ahead.items()])).over(inner)
        for n in ahead:
            finals[n] = F.when(F.col("_la").isNotNull(), F.col("_la")[n]).otherwise(F.col("_nhead")[n])
        temp += ["_la", "_nhead"]
    carry = df.groupBy(*keys, CHUNK).agg(*totals).select(*keys, CHUNK, *carries)
    return _join_carry(df, carry, keys).withColumns(locals_).withColumns(finals).drop(*temp)


def lags(df: DataFrame, keys: Sequence[str], order: Sequence[str],
         outputs: Mapping[str, tuple[Column | str, int]]) -> DataFrame:
    """``lag(column, n)`` for small fixed ``n``, several at once.

    The newest ``max(n)`` rows of the earlier chunks travel as one short array
    per chunk; that is all a chunk needs from its past.
    """
    depth = max(n for _, n in outputs.values())
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    if CHUNK not in df.columns:
        whole = W.partitionBy(*keys).orderBy(*order)
        return df.withColumns({k: F.lag(as_col(c), n).over(whole) for k, (c, n) in outputs.items()})
    df = cut(df)
    inner = W.partitionBy(*keys, CHUNK).orderBy(*order)
    newest = W.partitionBy(*keys, CHUNK).orderBy(*[F.col(o).desc() for o in order])
    packed = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                      *[as_col(c).alias(k) for k, (c, _) in outputs.items()])
    tails = (df.select(*keys, CHUNK, *order, packed.alias("_pk"))
             .withColumn("_rr", F.row_number().over(newest)).where(F.col("_rr") <= depth)
             .groupBy(*keys, CHUNK).agg(F.collect_list("_pk").alias("_tail")))
    # every chunk holds a row, so `depth` earlier chunks reach far enough back
    prior = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-depth, -1)
    gathered = F.reverse(F.array_sort(F.flatten(F.collect_list("_tail").over(prior))))
    carry = tails.select(*keys, CHUNK, F.slice(gathered, 1, depth).alias("_before"))
    out = _join_carry(df.withColumn("_pk", packed), carry, keys)
    out = out.withColumn("_rn", F.row_number().over(inner)).withColumns(
        {f"_lg_{k}": F.lag("_pk", n).over(inner) for k, (_, n) in outputs.items()})
    final = {}
    for k, (_, n) in outputs.items():
        earlier = F.get(F.col("_before"), F.lit(n) - F.col("_rn"))
        final[k] = F.when(F.col("_rn") > n, F.col(f"_lg_{k}")[k]).otherwise(earlier[k])
    return out.withColumns(final).drop("_pk", "_rn", "_before", *[f"_lg_{k}" for k in outputs])


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key, by map-side combined ``min_by`` (no sort, no window)."""
    return _edge_row(df, keys, order, F.min_by)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key, by map-side combined ``max_by``."""
    return _edge_row(df, keys, order, F.max_by)


def _edge_row(df, keys, order, by):
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        by(F.struct(*rest), F.struct(*[F.col(o) for o in order])).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def trailing_counts(df: DataFrame, keys: Sequence[str], position: str, span: int,
                    order: Sequence[str], outputs: Mapping[str, Column],
                    width: int, target_rows: int | None = None) -> DataFrame:
    """How many rows of the key lie in ``[position - span, position]``.

    Counts rows at or before the current one in ``order``.  Every row adds its
    weight at its position and takes it back just after ``position + span``; a
    chunked running sum over both kinds of marks is the sliding count.  So the
    sliding window costs two rows per input row whatever its length, and no task
    ever holds a whole window.  ``outputs`` maps a name to an integral weight.
    """
    marks = df.withColumns({f"_w_{n}": w.cast("long") for n, w in outputs.items()})
    enter = marks.withColumns({"_at": F.col(position), "_enter": F.lit(1)})
    leave = (marks.select(*keys, *[F.col(o) for o in order if o not in keys],
                          *[(-F.col(f"_w_{n}")).alias(f"_w_{n}") for n in outputs],
                          (F.col(position) + F.lit(span + 1)).alias("_at"), F.lit(0).alias("_enter")))
    both = enter.unionByName(leave, allowMissingColumns=True)
    both = with_chunks(both, keys, "_at", width, target_rows, bound=(df, keys))
    both = running(both, keys, ["_at", "_enter", *order],
                   {n: ("sum", f"_w_{n}") for n in outputs})
    return (both.where(F.col("_enter") == 1)
            .drop("_at", "_enter", CHUNK, *[f"_w_{n}" for n in outputs]))


def trailing_distinct_marks(df: DataFrame, keys: Sequence[str], value: str, position: str,
                            span: int, order: Sequence[str], width: int) -> DataFrame:
    """Weights that turn a sliding distinct count into a running sum.

    Adds ``_first`` (1 when ``value`` was not inside the window just before this
    row) and ``_final`` (1 when it does not reappear before leaving).
    """
    sub = with_chunks(df, [*keys, value], position, width, bound=(df, keys))
    sub = neighbours(sub, [*keys, value], order,
                     back={"_prev_at": position}, ahead={"_next_at": position})
    return sub.withColumns({
        "_first": F.when(F.col("_prev_at").isNull()
                         | (F.col(position) - F.col("_prev_at") > F.lit(span)), 1).otherwise(0).cast("long"),
        "_final": F.when(F.col("_next_at").isNull()
                         | (F.col("_next_at") - F.col(position) > F.lit(span)), 1).otherwise(0).cast("long"),
    }).drop("_prev_at", "_next_at", CHUNK)


def trailing_distinct(df: DataFrame, keys: Sequence[str], value: str, position: str,
                      span: int, order: Sequence[str], output: str, width: int,
                      counts: Mapping[str, Column] | None = None) -> DataFrame:
    """Sliding distinct count of ``value`` plus optional sliding counts."""
    counts = dict(counts or {})
    marked = trailing_distinct_marks(df, keys, value, position, span, order, width)
    marked = marked.withColumns({f"_w_{n}": w.cast("long") for n, w in counts.items()})
    enter = marked.withColumns({"_at": F.col(position), "_enter": F.lit(1), "_d": F.col("_first")})
    leave = marked.select(*keys, *[F.col(o) for o in order if o not in keys],
                          *[(-F.col(f"_w_{n}")).alias(f"_w_{n}") for n in counts],
                          (F.col(position) + F.lit(span + 1)).alias("_at"), F.lit(0).alias("_enter"),
                          (-F.col("_final")).alias("_d"))
    both = with_chunks(enter.unionByName(leave, allowMissingColumns=True), keys, "_at", width, bound=(df, keys))
    both = running(both, keys, ["_at", "_enter", *order],
                   {output: ("sum", "_d"), **{n: ("sum", f"_w_{n}") for n in counts}})
    return (both.where(F.col("_enter") == 1)
            .drop("_at", "_enter", "_d", "_first", "_final", CHUNK, *[f"_w_{n}" for n in counts]))


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the busiest key: one map-side combined count."""
    return _sizes(df, keys)[0]


def _sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the busiest key and of the table, from the same count."""
    if not keys:
        return (n := df.count()), n
    most, rows = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return most or 0, rows or 0


def quantiles(df: DataFrame, keys: Sequence[str], outputs: Mapping[str, tuple[str, float]],
              largest: int | None = None, target_rows: int | None = None) -> DataFrame:
    """Exact interpolated quantiles of columns per key, one row per key.

    Bounded keys take one aggregation.  With a hot key, values are counted first (combined map-side), then a running count finds the
    two values around each rank.  No key's values are ever held in one place.
    ``outputs`` maps a name to ``(value column, q)``.
    """
    largest = largest_key(df, keys) if largest is None else largest
    if largest <= (target_rows or TARGET_ROWS):
        return df.groupBy(*keys).agg(*[F.percentile(v, F.lit(q)).alias(n) for n, (v, q) in outputs.items()])
    result = None
    for value in dict.fromkeys(v for v, _ in outputs.values()):
        counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
        counts = counts.withColumn("_pos", F.floor(F.col(value) * 1024).cast("long"))
        ranked = running(with_chunks(counts, keys, "_pos", 1 << 20, target_rows), keys, [value], {"_cum": ("sum", "_n")})
        # the value at 0-based rank r is the first whose running count exceeds r
        total = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
        ranked = ranked.join(total, list(keys))
        wanted = {n: q for n, (v, q) in outputs.items() if v == value}
        picks = []
        for n, q in wanted.items():
            rank = F.lit(q) * (F.col("_all") - 1)
            for side, r in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
                picks.append(F.min(F.when(F.col("_cum") > r, F.col(value))).alias(f"_{n}_{side}"))
        got = ranked.groupBy(*keys).agg(F.max("_all").alias("_all"), *picks)
        got = got.select(*keys, *[
            (F.col(f"_{n}_lo") + (F.lit(q) * (F.col("_all") - 1) - F.floor(F.lit(q) * (F.col("_all") - 1)))
             * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n) for n, q in wanted.items()])
        result = got if result is None else result.join(got, list(keys), "full")
    return result
