"""Plate text, redaction and file-name parsing."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import PLATE_GRAMMAR, PLATE_SEARCH


def plate_key(text) -> Column:
    """Letters and digits only, upper case: the identity of a plate."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]", ""))


def plate_valid(text) -> Column:
    return plate_key(text).rlike(PLATE_GRAMMAR)


def plate_spaced(text) -> Column:
    """Spaced canonical form when the grammar fits, else the cleaned text."""
    key = plate_key(text)
    pieces = F.array(*[F.nullif(F.regexp_extract(key, PLATE_GRAMMAR, i), F.lit("")) for i in (1, 2, 3, 4)])
    return F.when(key.rlike(PLATE_GRAMMAR), F.array_join(pieces, " ")).otherwise(key)


def plate_in_noise(text) -> Column:
    """First plate-shaped run inside noisy text, else the cleaned text."""
    key = plate_key(text)
    return F.coalesce(F.nullif(F.regexp_extract(key, PLATE_SEARCH, 0), F.lit("")), key)


def char_similarity(a, b) -> Column:
    """1 - edit distance / longer length: a character accuracy in 0..1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(
        1.0 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))


def redact_url(url) -> Column:
    """Hide the user and password of a stream URL."""
    return F.regexp_replace(url, r"(?<=://)[^/@]+@", "***@")


def crop_identity(path) -> Column:
    """Identity from an ``<identity>_c<camera>...`` file name."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(-?\d+)_c(\d+)", 1).try_cast("int")


def crop_camera(path) -> Column:
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(-?\d+)_c(\d+)", 2).try_cast("int")


def glob_to_regex(pattern: str) -> str:
    """Subject glob (``*`` and ``?``) as an anchored regular expression."""
    out = ""
    for ch in pattern:
        out += {"*": ".*", "?": "."}.get(ch) or ("\\" + ch if not ch.isalnum() else ch)
    return f"^{out}$"
