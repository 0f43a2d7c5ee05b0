"""Canonical JSON digests and keyed countersignatures in the JVM."""
from __future__ import annotations

import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(score) -> Column:
    """Scores are rendered from decimal(6,4) so text never depends on doubles."""
    return score.cast("decimal(6,4)").cast("string")


def body_digest(event: dict[str, Column], patrol: Column | None = None) -> Column:
    """SHA-256 of the immutable fields of an event as canonical JSON.

    Keys are written in sorted order and nulls are kept.  ``patrol`` is a struct
    of decision, patrol_id and match_score; it is appended only when present, so
    events without an assessment hash the same whether or not patrols are used.
    """
    ordered = F.struct(*[event[k].alias(k) for k in sorted(event)])
    text = F.to_json(ordered, {"ignoreNullFields": "false"})
    if patrol is not None:
        tail = F.concat_ws("|", patrol["decision"], F.coalesce(patrol["patrol_id"], F.lit("")),
                           _fixed(patrol["match_score"]))
        text = F.when(patrol.isNotNull(), F.concat(text, F.lit("|"), tail)).otherwise(text)
    return F.sha2(text, 256)


def event_body(node_id, event_id, camera_id, event_type, ts_us, mono_ns, object_class,
               track_id, zone_id, score, frame_sha, clip_sha) -> dict[str, Column]:
    """The committed fields of an event, under their canonical names."""
    return {"node": node_id, "event_id": event_id, "camera": camera_id, "type": event_type,
            "ts": ts_us, "mono_ns": mono_ns, "object": object_class, "track": track_id,
            "zone": zone_id, "score": _fixed(score), "frame_sha256": frame_sha,
            "clip_sha256": clip_sha}


def entry_hash(index, prev_hash, body) -> Column:
    """Commit to position, predecessor and body."""
    return F.sha2(F.concat_ws("|", index.cast("string"), prev_hash, body), 256)


def hmac_sha256(secret: str, message) -> Column:
    """HMAC-SHA256 in hex.  The key stays inside the function and never shows in a plan."""
    key = secret.encode()

    @F.pandas_udf("string")
    def sign(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: None if m is None else hmac.new(key, m.encode(), "sha256").hexdigest())
    return sign(message)


def countersign(secret: str, node_id, index, entry, witnessed_at, prev_sig) -> Column:
    return hmac_sha256(secret, F.concat_ws(
        "|", node_id, index.cast("string"), entry, witnessed_at, prev_sig))
