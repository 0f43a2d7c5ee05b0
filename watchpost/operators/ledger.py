"""Hash-chained event ledger: append, verify, and the core's view of it."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import body_digest, entry_hash, event_body
from ..session import cut
from .ordered import neighbours, running, with_chunks

WIDTH_US = 86_400_000_000
SEGMENT_ROWS = 1_000_000


def with_body(events: DataFrame) -> DataFrame:
    """Digest of the committed fields; acknowledgement and sync never enter it."""
    have = lambda c, t: F.col(c) if c in events.columns else F.lit(None).cast(t)
    body = event_body(F.col("node_id"), F.col("event_id"), F.col("camera_id"), F.col("event_type"), F.col("ts_us"),
                      have("monotonic_ns", "long"), F.col("object_class"), F.col("track_id"), F.col("zone_id"),
                      F.col("score"), have("frame_sha256", "string"), have("clip_sha256", "string"))
    patrol = F.col("patrol") if "patrol" in events.columns else None
    return events.withColumn("body", body_digest(body, patrol))


def append(events: DataFrame, heads: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Give each event of a node its index, predecessor and entry hash.

    An event is sealed once: rows that have an index come back as they are, and where no
    ``heads`` (node_id, ledger_index, entry_hash) are given the chains go on from theirs.
    Body digests and indexes are computed in parallel.  Only the link itself is
    serial by design of a hash chain, so a long append is linked in segments of
    bounded size: each round links the next segment of every node and hands its
    head on through a checkpoint.
    """
    sealed = None
    if {"ledger_index", "prev_hash", "entry_hash"} <= set(events.columns):
        sealed, events = events.where("ledger_index > 0"), events.where("coalesce(ledger_index, 0) <= 0")
        heads = heads_of(sealed) if heads is None else heads
    rows = with_chunks(with_body(events), ["node_id"], "ts_us", WIDTH_US)
    rows = running(rows, ["node_id"], ["ts_us", "event_id"], {"_n": ("count", F.lit(True))}).drop("_chunk")
    if heads is None:
        rows = rows.withColumns({"_base": F.lit(0).cast("long"), "_head": F.lit("")})
    else:
        rows = rows.join(heads.select("node_id", F.col("ledger_index").alias("_base"),
                                      F.col("entry_hash").alias("_head")), "node_id", "left").fillna(
            {"_base": 0, "_head": ""})
    slim = rows.select("node_id", "event_id", (F.col("_n") + F.col("_base")).cast("long").alias("ledger_index"),
                       "body", "_head", F.floor((F.col("_n") - 1) / F.lit(segment_rows)).cast("long").alias("_seg"))
    schema = "node_id string, event_id long, ledger_index long, prev_hash string, entry_hash string"

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, prev, begun = None, "", False
        for batch in batches:
            before, entries = [], []
            for who, index, body, head in zip(*[batch.column(c).to_pylist() for c in ("node_id", "ledger_index", "body", "_head")]):
                if not begun or who != node:
                    node, prev, begun = who, head, True
                before.append(prev)
                prev = hashlib.sha256(f"{index}|{prev}|{body}".encode()).hexdigest()
                entries.append(prev)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node_id", "event_id", "ledger_index")], pa.array(before, pa.string()), pa.array(entries, pa.string())],
                                             ["node_id", "event_id", "ledger_index", "prev_hash", "entry_hash"])

    def linked_in_order(part: DataFrame) -> DataFrame:
        """Rows stream past the link in order of their chain; a Python worker holds one batch."""
        tasks = int(part.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return part.repartition(tasks, "node_id").sortWithinPartitions("node_id", "ledger_index").mapInArrow(link, schema)

    longest = events.groupBy("node_id").count().agg(F.max("count")).first()[0] or 0
    if longest <= segment_rows:
        linked = linked_in_order(slim)
    else:
        slim, parts, head = cut(slim, by="_seg"), [], None
        for seg in range((longest - 1) // segment_rows + 1):
            part = slim.where(F.col("_seg") == seg)
            if head is not None:
                part = part.drop("_head").join(head, "node_id")
            done = cut(linked_in_order(part))
            head = cut(done.groupBy("node_id").agg(F.max_by("entry_hash", "ledger_index").alias("_head")))
            parts.append(done)
        linked = reduce(DataFrame.unionByName, parts)
    keep = [c for c in events.columns if c not in ("ledger_index", "prev_hash", "entry_hash")]
    done = events.select(*keep).join(linked, ["node_id", "event_id"])
    return done if sealed is None else done.unionByName(sealed.select(*done.columns))


def heads(chain: DataFrame) -> DataFrame:
    """Newest entry per node."""
    return chain.where("ledger_index > 0").groupBy("node_id").agg(
        F.max("ledger_index").alias("ledger_index"), F.max_by("entry_hash", "ledger_index").alias("entry_hash"))


heads_of = heads


def checked(chain: DataFrame) -> DataFrame:
    """Per entry: does the link hold, and does the content still hash the same?"""
    c = with_chunks(with_body(chain), ["node_id"], "ledger_index", 1_000_000)
    c = neighbours(c, ["node_id"], ["ledger_index"], back={"_before": "entry_hash"})
    return c.withColumns({
        "link_ok": F.col("prev_hash") == F.coalesce("_before", F.lit("")),
        "content_ok": entry_hash(F.col("ledger_index"), F.col("prev_hash"), F.col("body")) == F.col("entry_hash"),
    }).drop("_before", "body", "_chunk")


def verify(chain: DataFrame) -> DataFrame:
    """First break per node; fully parallel, no chain walk."""
    bad = ~(F.col("link_ok") & F.col("content_ok"))
    return checked(chain).groupBy("node_id").agg(
        F.count("*").alias("entries"), F.min(F.when(bad, F.col("ledger_index"))).alias("broken_at"),
        F.min_by(F.when(F.col("link_ok"), "content").otherwise("link"),
                 F.when(bad, F.col("ledger_index"))).alias("problem"),
        F.max_by("entry_hash", "ledger_index").alias("head")).withColumns({
            "valid": F.col("broken_at").isNull(),
            "problem": F.when(F.col("broken_at").isNotNull(), F.col("problem"))})


def verify_at_core(chain: DataFrame) -> DataFrame:
    """Per node, tolerating gaps: a break needs an unknown predecessor or altered content."""
    known = chain.select("node_id", F.col("entry_hash").alias("prev_hash")).distinct().withColumn("_known", F.lit(True))
    c = with_body(chain).join(known, ["node_id", "prev_hash"], "left")
    orphan = (F.col("ledger_index") > 1) & F.col("_known").isNull()
    altered = entry_hash(F.col("ledger_index"), F.col("prev_hash"), F.col("body")) != F.col("entry_hash")
    return c.groupBy("node_id").agg(
        F.count("*").alias("entries"),
        F.min(F.when(orphan | altered, F.col("ledger_index"))).alias("broken_at")).withColumn(
        "valid", F.col("broken_at").isNull())


def unsealed(events: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Events with no ledger position whose evidence is not still being captured."""
    loose = events.where("coalesce(ledger_index, 0) = 0")
    return loose if pending is None else loose.join(pending.select("event_id"), "event_id", "left_anti")


def certificate(chain: DataFrame) -> DataFrame:
    """Period covered, entry count, head and validity per node."""
    period = chain.groupBy("node_id").agg(F.min("ts_us").alias("from_us"), F.max("ts_us").alias("to_us"))
    return verify(chain).join(period, "node_id")


def certificate_records(chain: DataFrame, events: DataFrame) -> DataFrame:
    """One row per sealed entry for the certificate: its hash and what it commits to.

    Entries whose event is gone stay, without camera, type and time.
    """
    facts = events.select("event_id", "camera_id", "event_type", F.col("ts_us").alias("_ts"))
    found = chain.select("node_id", "ledger_index", "event_id", F.col("entry_hash").alias("entry_sha256")).join(facts, "event_id", "left")
    at = F.date_format(F.timestamp_micros("_ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return found.select("node_id", "ledger_index", "event_id", "entry_sha256", "camera_id", "event_type", at.alias("timestamp"))
