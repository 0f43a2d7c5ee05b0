"""Exact keyed folds over long timelines, run chunk-parallel.

Some operators (alert rationing, tracking, hand-offs) are a loop over time whose
state at a row depends on all earlier rows of the key.  Running the loop over a
whole key would put a busy key in one task.  Here a key's timeline is cut into
chunks and *every* chunk is folded at once from a guessed incoming state.  The
outgoing state of a chunk is then compared with the state its successor assumed;
only chunks that assumed wrongly run again.  When nothing is left to correct the
result is the sequential result: chunk 0 starts from the true state, and each
chunk's input equals its predecessor's output.

The states these operators carry forget quickly (an hour of alerts, tracks alive
for a few seconds, one cooldown), so a wrong guess rarely outlives a chunk and
two or three rounds settle it.  A few long keys are probed first: if the second chunk
of most ends in another state from a guess than from the first chunk's (a crowded
camera), guessing does not pay, and each key is folded once, chunk after chunk, as its
rows stream past the state.  Where only a later round leaves more than half of the wrong
chunks wrong, from then on only the first wrong chunk of each key runs.  Rounds are cut
with a checkpoint.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut, shared_folder, timers
from .ordered import CHUNK

Step = Callable[[pd.DataFrame, "str | None"], "tuple[pd.DataFrame, str]"]


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step,
         schema: str, part: Column | None = None, resume: DataFrame | None = None, ttl_s: float | None = None) -> DataFrame:
    """Fold ``step`` over each key in ``order``; see ``with_chunks``.

    ``step(chunk_rows, state)`` gets one chunk sorted by ``order`` and the JSON
    state left by the previous chunk (None at the start).  It returns output
    rows matching ``schema`` (keys included) and its own JSON state.  Equal
    states must serialise to equal text.

    A state that never forgets, like the last match of every identity, would pass
    each early change on to all later chunks.  With ``part`` (a string column, null
    where a row touches no part) the state is a JSON object by part: a chunk gets
    the latest value of the parts its own rows name, returns only those it set,
    and runs again only when one of *them* changed.

    On a stream the state lives in the state store.  ``resume`` (the keys and state, as
    ``last_states`` gives them) is what the keys start from, so a stream can take over where
    a batch ended; with ``ttl_s`` the state of a key that stays silent for so long is dropped.
    """
    if rows.isStreaming:
        fields = [p.strip().rsplit(" ", 1)[0].strip("`") for p in _split(schema)]
        return _fold_stream(rows, list(keys), list(order), step, schema, fields, part is not None, resume, ttl_s)
    return _fold_batch(rows, keys, order, step, schema, part)[0]


def last_states(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str, part: Column | None = None) -> DataFrame:
    """The keys with the state (JSON) that ``fold`` over these rows ends in."""
    return _fold_batch(rows, keys, order, step, schema, part)[1]


def _fold_batch(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str, part: Column | None) -> tuple[DataFrame, DataFrame]:
    """Output rows, and the last state of each key."""
    keys, order = list(keys), list(order)
    names = [*keys, CHUNK]
    fields = [p.strip().rsplit(" ", 1)[0].strip("`") for p in _split(schema)]
    full = f"{schema}, {CHUNK} long, _state string, _mark boolean"
    key_types = {f.name: f.dataType.simpleString() for f in rows.schema}
    missing = [k for k in keys if k not in fields]
    full += "".join(f", {k} {key_types[k]}" for k in missing)
    columns = [*fields, CHUNK, "_state", "_mark", *missing]

    def run_whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = step(pdf.sort_values(order, kind="stable"), None)
        return out[fields]

    def end_whole(pdf: pd.DataFrame) -> pd.DataFrame:
        _, state = step(pdf.sort_values(order, kind="stable"), None)
        return pdf[keys].head(1).assign(state=state)

    if CHUNK not in rows.columns:      # every key is bounded: one lazy pass
        ends = ", ".join(f"{k} {key_types[k]}" for k in keys) + ", state string"
        return rows.groupBy(*keys).applyInPandas(run_whole, schema), rows.groupBy(*keys).applyInPandas(end_whole, ends)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        state = right["_in"].iloc[0] if len(right) else None
        state = None if state is None or state != state else state
        out, new_state = step(left.sort_values(order, kind="stable"), state)
        head = left.iloc[0]
        out = out.reindex(columns=fields) if len(out.columns) != len(fields) else out[fields]
        out = out.assign(**{CHUNK: head[CHUNK], "_state": None, "_mark": False})
        for k in missing:
            out[k] = head[k]
        mark = {c: None for c in columns}
        mark.update({k: head[k] for k in keys})
        mark.update({CHUNK: head[CHUNK], "_state": new_state, "_mark": True})
        tail = pd.DataFrame([mark], columns=columns)
        if not len(out):
            return tail
        return pd.concat([out[columns].astype(object), tail.astype(object)], ignore_index=True)

    rows = cut(rows)
    spark = rows.sparkSession
    if part is None:
        long = cut(rows.groupBy(*names).agg(F.count("*").alias("_n")))
        if _guesses_fail(rows, long, keys, order, step, key_types):
            return _one_after_another(rows, long, keys, order, step, columns, fields, full)
    held = None if part is None else cut(rows.select(*names, part.alias("_part")).where("_part IS NOT NULL").distinct())
    todo = rows.select(*names).distinct().withColumns({"_in": F.lit(None).cast("string"), "_used": F.lit(None).cast("string")})
    todo = cut(todo)
    found, left = Rounds(spark), Rounds(spark)
    round_no, wrong_before, one_by_one = 0, None, False
    while True:
        todo_rows = rows if round_no == 0 else _of_chunks(rows, todo, names)
        result = found.add(round_no, todo_rows.groupBy(*names).cogroup(todo.select(*names, "_in").groupBy(*names)).applyInPandas(run, full))
        # states are told apart by their hash and read only where a chunk needs one
        left.add(round_no, result.where("_mark").select(*names, "_state").join(todo, names).select(
            *names, "_state", "_used", F.sha2("_state", 256).alias("_out"), *(["_in"] if part is not None else [])))
        states = left.all()
        if held is None:
            now = states.groupBy(*names).agg(F.max_by(F.struct("_used", "_out", "_round"), "_round").alias("_s"))
            turn = W.partitionBy(*keys).orderBy(CHUNK)
            linked = now.select(*names, F.col("_s._used").alias("_had"), F.lag("_s._out").over(turn).alias("_used"),
                                F.lag(CHUNK).over(turn).alias("_prev"), F.lag("_s._round").over(turn).alias("_from"))
        else:
            now = states.groupBy(*names).agg(F.max_by(F.struct("_in", "_state"), "_round").alias("_s"))
            linked = now.select(*names, F.col("_s._in").alias("_had")).join(_carried(held, now, keys, names), names, "left").withColumn("_used", F.col("_in"))
        wrong = cut(linked.where(~F.col("_had").eqNullSafe(F.col("_used"))).drop("_had"))
        n_wrong = wrong.count()
        if not n_wrong:
            break
        if wrong_before is not None and n_wrong * 2 > wrong_before and not one_by_one:
            # guesses do not outlive a chunk here: from now on only a key's first wrong chunk, which is final once it ran
            one_by_one = True
            rows = cut(_of_chunks(rows, wrong, names).repartition(*names), by=CHUNK)
        wrong_before = n_wrong
        if one_by_one:
            wrong = wrong.join(wrong.groupBy(*keys).agg(F.min(CHUNK).alias(CHUNK)), names, "left_semi")
        if held is None:
            given = states.select(*keys, F.col(CHUNK).alias("_prev"), F.col("_round").alias("_from"), F.col("_state").alias("_in"))
            wrong = wrong.join(given, [*keys, "_prev", "_from"])
        todo = cut(wrong.select(*names, "_in", "_used"))
        round_no += 1
    everything = found.all()
    if round_no:
        final = states.groupBy(*names).agg(F.max("_round").alias("_round"))
        everything = everything.join(final, [*names, "_round"], "left_semi")
    now = states.groupBy(*names).agg(F.max_by("_state", "_round").alias("state"))
    if part is None:
        ends = now.groupBy(*keys).agg(F.max_by("state", CHUNK).alias("state"))
    else:
        each = now.select(*names, F.explode(F.from_json("state", "map<string,string>")).alias("_part", "_value"))
        last = each.groupBy(*keys, "_part").agg(F.max_by("_value", CHUNK).alias("_value"))
        ends = last.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_part", "_value"))))).alias("state"))
    return everything.where("not _mark").select(*fields), ends


#: Keys of at least so many chunks are probed, so many of them.
PROBED_CHUNKS, PROBED_KEYS = 4, 4


def _guesses_fail(rows: DataFrame, chunks: DataFrame, keys: list[str], order: list[str], step: Step, key_types: dict) -> bool:
    """Whether most of some long keys leave their second chunk in another state from no state than from the first chunk's."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    some = chunks.where(known).groupBy(*keys).agg(F.count("*").alias("_chunks"), F.slice(F.array_sort(F.collect_list(CHUNK)), 1, 2).alias("_two"))
    some = some.where(F.col("_chunks") >= PROBED_CHUNKS).orderBy(F.xxhash64(*keys)).limit(PROBED_KEYS).select(*keys, F.explode("_two").alias(CHUNK))
    some = cut(some)
    asked = some.count() // 2
    if not asked:
        return False

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = (part.sort_values(order, kind="stable") for _, part in pdf.groupby(CHUNK))
        same = step(second, step(first, None)[1])[1] == step(second, None)[1]
        return pdf[keys].head(1).assign(settled=same)

    found = _of_chunks(rows, some, [*keys, CHUNK]).repartition(asked * 4, *keys).groupBy(*keys).applyInPandas(
        probe, ", ".join(f"{k} {key_types[k]}" for k in keys) + ", settled boolean")
    return found.where("NOT settled").count() * 2 > asked


def _one_after_another(rows: DataFrame, chunks: DataFrame, keys: list[str], order: list[str], step: Step, columns: list[str], fields: list[str],
                       schema: str) -> tuple[DataFrame, DataFrame]:
    """Each key in one task, which holds one chunk and the state; keys side by side."""
    names = [*keys, CHUNK]

    def same(a, b) -> bool:
        return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))

    def parts(batches):
        """Rows of one chunk after the other."""
        held, at = [], None
        for pdf in batches:
            if not len(pdf):
                continue
            new = pd.Series(False, index=pdf.index)
            for c in names:
                was = pdf[c].shift()
                new |= (pdf[c] != was) & ~(pdf[c].isna() & was.isna())
            new.iloc[0] = True
            edges = [*new.to_numpy().nonzero()[0].tolist(), len(pdf)]
            for lo, hi in zip(edges, edges[1:]):
                piece = pdf.iloc[lo:hi]
                now = tuple(piece[names].iloc[0])
                if held and not same(now, at):
                    yield at, pd.concat(held, ignore_index=True)
                    held = []
                held.append(piece)
                at = now
        if held:
            yield at, pd.concat(held, ignore_index=True)

    def mark(at, state) -> pd.DataFrame:
        return pd.DataFrame([{c: None for c in columns} | dict(zip(names, at)) | {"_state": state, "_mark": True}], columns=columns).astype(object)

    def run(batches):
        state, last = None, None
        for at, part in parts(batches):
            if last is not None and not same(at[:-1], last[:-1]):
                yield mark(last, state)
                state = None
            out, state = step(part.sort_values(order, kind="stable"), state)
            last = at
            if len(out):
                out = out.assign(**{CHUNK: at[-1], "_state": None, "_mark": False}, **{k: v for k, v in zip(keys, at) if k not in out.columns})
                yield out.reindex(columns=columns).astype(object)
        if last is not None:
            yield mark(last, state)

    n = chunks.select(*keys).distinct().count()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * n, 1000))
    done = cut(rows.repartition(tasks, *keys).sortWithinPartitions(*names).mapInPandas(run, schema))
    return done.where("NOT _mark").select(*fields), done.where("_mark").select(*keys, F.col("_state").alias("state"))


class Rounds:
    """What each round wrote, a folder a round; read back as one table with ``_round``."""

    def __init__(self, spark) -> None:
        self.spark, self.schema = spark, None
        self.path = f"{shared_folder(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"

    def add(self, number: int, df: DataFrame) -> DataFrame:
        folder = f"{self.path}/_round={number}"
        self.schema = df.schema
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("_round", IntegerType())])).parquet(self.path)


#: Up to so many chunk ids are named in a filter, which skips the folders of all others.
NAMED_CHUNKS = 200


def _of_chunks(rows: DataFrame, todo: DataFrame, names: list[str]) -> DataFrame:
    """The rows of some chunks."""
    ids = [r[0] for r in todo.select(CHUNK).distinct().limit(NAMED_CHUNKS + 1).collect()]
    if len(ids) <= NAMED_CHUNKS:
        rows = rows.where(F.col(CHUNK).isin(ids))
    return rows.join(todo.select(*names), names, "left_semi")


def _carried(held: DataFrame, now: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Per chunk, as JSON, the values that earlier chunks left for the parts it holds."""
    left = now.select(*names, F.explode(F.from_json("_s._state", "map<string,string>")).alias("_part", "_value"))
    before = W.partitionBy(*keys, "_part").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    seen = held.join(left, [*names, "_part"], "left").withColumn("_before", F.last("_value", ignorenulls=True).over(before))
    entries = F.array_sort(F.collect_list(F.when(F.col("_before").isNotNull(), F.struct("_part", "_before"))))
    return seen.groupBy(*names).agg(entries.alias("_e")).select(*names, F.when(F.size("_e") > 0, F.to_json(F.map_from_entries("_e"))).alias("_in"))


class _Resumed(StatefulProcessor):
    """``step`` per key, from a given state on."""

    def __init__(self, fold_rows: Callable, ttl_ms: int | None) -> None:
        self.fold_rows, self.ttl_ms = fold_rows, ttl_ms

    def init(self, handle) -> None:
        self.saved = handle.getValueState("state", "state string", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.saved.update((initialState["state"].iloc[0],))

    def handleInputRows(self, key, rows, timerValues):
        out, new = self.fold_rows(rows, self.saved.get()[0] if self.saved.exists() else None)
        self.saved.update((new,))
        yield out

    def close(self) -> None:
        pass


def _fold_stream(rows, keys, order, step, schema, fields, by_part=False, resume=None, ttl_s=None) -> DataFrame:
    """The same step over a stream: its JSON state lives in the state store.

    Rows of one micro-batch are put in order; a row that arrives in a later batch
    is folded then, as a node that reconnects late would be.
    """
    def fold_rows(batches, saved):
        pdf = pd.concat(list(batches), ignore_index=True)
        out, new = step(pdf.sort_values(order, kind="stable").reset_index(drop=True), saved)
        if by_part and saved:
            new = json.dumps({**json.loads(saved), **json.loads(new)}, sort_keys=True)
        return out[fields], new

    def run(_, batches, state):
        out, new = fold_rows(batches, state.get[0] if state.exists else None)
        state.update((new,))
        yield out

    if resume is None and ttl_s is None:
        return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")
    timers(rows.sparkSession)
    start = None if resume is None else resume.select(*keys, "state").groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(
        _Resumed(fold_rows, None if ttl_s is None else int(ttl_s * 1000)), schema, "append", "none" if ttl_s is None else "processingTime", start)


def _split(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += ch in "<(" 
        depth -= ch in ">)"
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]
