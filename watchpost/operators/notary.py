"""Countersigned checkpoints over chain heads, and rewrite detection."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import countersign
from .ordered import neighbours, with_chunks

CHECKPOINT = "node_id string, ledger_index long, entry_hash string, witnessed_at string, core_prev_sig string, core_sig string"


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    rest = ["ledger_index", "entry_hash", "witnessed_at", "core_prev_sig", "core_sig"]
    return checkpoints.groupBy("node_id").agg(
        F.max_by(F.struct(*rest), "ledger_index").alias("c")).select("node_id", "c.*")


def rewrites(entries: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Entries that contradict what was already witnessed at their index."""
    seen = checkpoints.select("node_id", "ledger_index", F.col("entry_hash").alias("witnessed"))
    return entries.join(seen, ["node_id", "ledger_index"]).where("entry_hash <> witnessed").select(
        "node_id", "ledger_index", "witnessed", F.col("entry_hash").alias("presented"))


def witness(entries: DataFrame, checkpoints: DataFrame, witnessed_at: str, secret: str) -> DataFrame:
    """New checkpoints: one per node whose head moved and whose past is intact.

    Idempotent: presenting the same head again yields nothing.
    """
    refused = rewrites(entries, checkpoints).select("node_id").distinct()
    head = entries.groupBy("node_id").agg(F.max("ledger_index").alias("ledger_index"),
                                          F.max_by("entry_hash", "ledger_index").alias("entry_hash"))
    last = latest_checkpoint(checkpoints).select("node_id", F.col("ledger_index").alias("_at"), F.col("core_sig").alias("_sig"))
    moved = (head.join(refused, "node_id", "left_anti").join(last, "node_id", "left")
             .where("_at IS NULL OR ledger_index > _at"))
    out = moved.withColumns({"witnessed_at": F.lit(witnessed_at), "core_prev_sig": F.coalesce("_sig", F.lit(""))})
    return out.withColumn("core_sig", countersign(
        secret, F.col("node_id"), F.col("ledger_index"), F.col("entry_hash"), F.col("witnessed_at"),
        F.col("core_prev_sig"))).drop("_at", "_sig")


def verify_checkpoints(checkpoints: DataFrame, secret: str) -> DataFrame:
    """Recompute every signature and predecessor link; first break per node."""
    c = with_chunks(checkpoints, ["node_id"], "ledger_index", 1_000_000)
    c = neighbours(c, ["node_id"], ["ledger_index"], back={"_before": "core_sig"})
    good = (countersign(secret, F.col("node_id"), F.col("ledger_index"), F.col("entry_hash"),
                        F.col("witnessed_at"), F.col("core_prev_sig")) == F.col("core_sig")) & (
        F.col("core_prev_sig") == F.coalesce("_before", F.lit("")))
    return c.groupBy("node_id").agg(
        F.count("*").alias("checkpoints"), F.min(F.when(~good, F.col("ledger_index"))).alias("broken_at"),
        F.max("ledger_index").alias("_top")).select(
        "node_id", "checkpoints", "broken_at", F.col("broken_at").isNull().alias("valid"),
        F.when(F.col("broken_at").isNull(), F.col("_top")).otherwise(0).alias("witnessed_up_to"))


def audit(entries: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """First index per node whose event no longer matches its witnessed hash."""
    bad = rewrites(entries, checkpoints).groupBy("node_id").agg(F.min("ledger_index").alias("broken_at"))
    return checkpoints.select("node_id").distinct().join(bad, "node_id", "left").withColumn(
        "no_rewrite", F.col("broken_at").isNull())
