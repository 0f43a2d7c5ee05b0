"""Cooldown: keep a row only if its key kept nothing within the last N units."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import fold, last_states
from .ordered import with_chunks


def _sharded(df: DataFrame, key: str, position: str, gap: int, tie: str, width: int, shards: int, target_rows: int):
    """Rows, keys, order, step and schema of the fold."""
    stream = df.isStreaming
    slim = (df if stream else df.select(key, position, tie)).withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    rows = with_chunks(slim, ["_shard"], position, width, target_rows)

    def step(pdf: pd.DataFrame, state: str | None):
        last = json.loads(state) if state else {}
        keep = []
        for k, at in zip(pdf[key].tolist(), pdf[position].tolist()):
            seen = last.get(k)
            ok = seen is None or at - seen >= gap
            keep.append(ok)
            if ok:
                last[k] = at
        end = int(pdf[position].iloc[-1])
        live = {k: v for k, v in sorted(last.items()) if end - v < gap}
        return pdf.loc[keep, columns], json.dumps(live)

    types = dict(slim.dtypes)
    columns = df.columns if stream else [key, position, tie]
    return rows, ["_shard"], [position, tie], step, ", ".join(f"{c} {types[c]}" for c in columns)


def suppress_repeats(df: DataFrame, key: str, position: str, gap: int, tie: str, width: int, shards: int = 32, target_rows: int = 500_000,
                     resume: DataFrame | None = None, ttl_s: float | None = None) -> DataFrame:
    """Greedy thinning per key: a row survives when ``position`` is at least
    ``gap`` past the last *surviving* row of its key.

    Keys are hashed into shards, and each shard's timeline is cut into chunks, so
    many small keys share a task and one hot key spreads over many.  A stream starts
    from ``resume``, the ``cooldown_states`` of earlier rows over as many shards.
    """
    kept = fold(*_sharded(df, key, position, gap, tie, width, shards, target_rows), resume=resume, ttl_s=ttl_s)
    return kept if df.isStreaming else df.join(kept, [key, position, tie], "left_semi")


def cooldown_states(df: DataFrame, key: str, position: str, gap: int, tie: str, width: int, shards: int = 32, target_rows: int = 500_000) -> DataFrame:
    """_shard and state: the keys that still cool down after these rows."""
    return last_states(*_sharded(df, key, position, gap, tie, width, shards, target_rows))
