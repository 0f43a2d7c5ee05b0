"""Subject subscriptions as DataFrame filters (batch or streaming)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex

PREFIX = "site"


def subject() -> Column:
    """``site.<node>.<kind>.<camera>`` of a row."""
    return F.concat_ws(".", F.lit(PREFIX), "node_id", "kind", "camera_id")


def subscribe(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows whose subject matches the glob.

    Literal parts of a four-part pattern become equality filters, which prune
    partitions and reach the scan; wildcards are matched on the subject.
    """
    parts = pattern.split(".")
    if len(parts) == 4:
        for name, part in zip(("node_id", "kind", "camera_id"), parts[1:]):
            if "*" not in part and "?" not in part:
                rows = rows.where(F.col(name) == part)
    return rows.where(subject().rlike(glob_to_regex(pattern)))
