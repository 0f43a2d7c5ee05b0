"""Quality classifier: a factorisation machine over hashed words, structure and length.

score = sigmoid(w0 + <w, x> + sum of pairwise interactions), the interactions of every pair
of features being products of low-rank factors; by the sum-of-squares identity they cost
half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2 a factor, linear in the features.

Training reads labelled rows outside the held-out fold, at most about ``sample_rows``
(documented bound; chosen by a hash of text).  Scoring is one pass over all documents.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, give_back, held_out, pick, portions
from .features import LETTERS, lines_of, word_hashes

WORDS = 2048
STATS = ["symbols", "bars", "bangs", "upper", "digits", "blanks", "repeats", "distinct", "word_length", "long_words", "short_words",
         "capitals", "lines", "line_repeats", "full_stops", "size", "empty", "bytes_high"]
WIDTH = WORDS + len(STATS)
_RESULT = "doc_id long, held_out boolean, score double, predicted int"
_KIND = {"upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "blanks": (9, 10, 13, 32), "bars": (124,), "bangs": (33,),
         "symbols": (35, 36, 37, 38, 42, 64, 94, 126, 123, 125, 60, 62, 92, 95), "stops": (46, 44, 59, 58, 63), "lines": (10,)}
_TABLE = {k: np.isin(np.arange(256), list(v)).astype(np.uint8) for k, v in _KIND.items()}


def _sum(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, rows)


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """rows x WIDTH: hashed words by the logarithm of their share, then structure statistics about 0 to 1."""
    rows = len(starts) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    n_bytes = np.diff(starts)
    total = np.maximum(n_bytes, 1)
    line = lines_of(starts)
    kind = {k: _sum(t[data], line, rows) for k, t in _TABLE.items()}
    row, h, length = word_hashes(LETTERS[data], starts)
    n = np.maximum(np.bincount(row, minlength=rows), 1)
    slot = (h >> np.uint64(53)).astype(np.int64)
    counts = np.bincount(row * WORDS + slot, minlength=rows * WORDS).reshape(rows, WORDS)
    np.multiply(counts, (100 / n[:, None]).astype(np.float32), out=out[:, :WORDS], casting="unsafe")
    np.log1p(out[:, :WORDS], out=out[:, :WORDS])
    out[:, :WORDS] /= 4
    # equal neighbours, also two and three words apart, and words seen before in the text
    same = np.zeros(rows)
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = np.maximum(same, _sum((h[gap:] == h[:-gap]) & (row[gap:] == row[:-gap]), row[gap:], rows))
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = _sum(new, row[order], rows)
    lines_row, lines_h = _lines(data, starts)
    order = np.lexsort((lines_h, lines_row))
    old = np.zeros(len(lines_h), bool)
    old[1:] = (lines_h[order][1:] == lines_h[order][:-1]) & (lines_row[order][1:] == lines_row[order][:-1])
    n_lines = np.maximum(np.bincount(lines_row, minlength=rows), 1)
    letters = np.maximum(kind["upper"] + kind["lower"], 1)
    high = _sum(data >= 128, line, rows)
    stats = {
        "symbols": np.minimum(1, 8 * kind["symbols"] / n / 3), "bars": np.minimum(1, 2 * kind["bars"] / n), "bangs": np.minimum(1, kind["bangs"] / n),
        "upper": kind["upper"] / letters, "digits": np.minimum(1, 5 * kind["digits"] / total), "blanks": np.minimum(1, 2 * kind["blanks"] / total),
        "repeats": np.minimum(1, same / n), "distinct": distinct / n, "word_length": np.minimum(1, _sum(length, row, rows) / n / 12),
        "long_words": _sum(length > 7, row, rows) / n, "short_words": _sum(length <= 3, row, rows) / n, "capitals": np.minimum(1, 2 * kind["upper"] / n),
        "lines": np.minimum(1, 10 * kind["lines"] / n), "line_repeats": _sum(old, lines_row[order], rows) / n_lines,
        "full_stops": np.minimum(1, 3 * kind["stops"] / n), "size": np.log1p(n_bytes) / 12, "empty": (n_bytes == 0).astype(float), "bytes_high": high / total}
    for i, name in enumerate(STATS):
        out[:, WORDS + i] = stats[name]
    return out


def _lines(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every line: line ends become blanks between words of bytes."""
    table = np.arange(256, dtype=np.uint8)
    table[32], table[10] = 31, 32
    row, h, _ = word_hashes(table[data], starts)
    return row, h


class FactorisationMachine:
    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int = 6, rounds: int = 60, rate: float = 0.02, decay: float = 2e-3, seed: int = 6):
        """Mini-batches with Adam; structure features are decayed less than hashed words."""
        rng = np.random.default_rng(seed)
        self.bias = np.float32(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.w, self.v = np.zeros(WIDTH, np.float32), rng.normal(0, 0.02, (WIDTH, rank)).astype(np.float32)
        shrink = np.where(np.arange(WIDTH) < WORDS, decay, decay / 20).astype(np.float32)
        state = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.v), np.zeros_like(self.v)]
        step, size = 0, 128
        for _ in range(max(rounds, 3000 // max(1, -(-len(y) // size)) // 4) if len(y) else 0):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // size)):
                step += 1
                a, t = x[rows], y[rows]
                s = a @ self.v
                slope = (1 / (1 + np.exp(-np.clip(self.raw(a), -30, 30))) - t).astype(np.float32) / len(rows)
                gw = a.T @ slope + shrink * self.w
                gv = a.T @ (slope[:, None] * s) - self.v * ((a * a).T @ slope)[:, None] + 2 * shrink[:, None] * self.v
                self.bias -= rate * slope.sum()
                for p, g, m, q in ((self.w, gw, state[0], state[1]), (self.v, gv, state[2], state[3])):
                    m += 0.1 * (g - m)
                    q += 0.01 * (g * g - q)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.99 ** step)) + 1e-6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        pairs = ((x @ self.v) ** 2 - (x * x) @ (self.v * self.v)).sum(1) / 2
        return self.bias + x @ self.w + pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30).astype(np.float64)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = 4000) -> FactorisationMachine | None:
    """Fit on at most about ``sample_rows`` labelled rows; None where there are none.

    A document labelled more than once counts once, by its smallest label.
    """
    marks = pick(labels, doc_id=id_col, label=label_col).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.min(F.col("label").cast("int")).alias("label"))
    n = marks.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    known = pick(docs, doc_id=id_col, text=text_col).join(marks.where(draw < sample_rows / n), "doc_id").select("text", "label")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, limit=512 << 10, rows=128):
                x = features(*flat(batch)).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"label": batch.column("label").cast(pa.int32()), "x": pa.array([r.tobytes() for r in x], pa.binary())})
            give_back()
    rows = sorted((r["label"], bytes(r["x"])) for r in known.mapInArrow(gather, "label int, x binary").limit(2 * sample_rows).collect())
    if not rows:
        return None
    x = np.frombuffer(b"".join(b for _, b in rows), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return FactorisationMachine(x, np.array([label for label, _ in rows], np.float32))


def _scores(batch: pa.RecordBatch, model: FactorisationMachine | None, text_col: str) -> np.ndarray:
    found = [np.zeros(0)]
    for part in portions(batch, text_col, 512 << 10, 128):  # a worker's scratch memory is some hundred bytes per byte of text
        found.append(model.score(features(*flat(part, text_col))) if model is not None else np.ones(part.num_rows))
    return np.concatenate(found)


def score(docs: DataFrame, model: FactorisationMachine | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= threshold).

    Null counts as empty and is scored like any text; without a model every score is 1.
    Rows of equal id are rows of their own; other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("held_out", held_out(F.col("doc_id")))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(batch, model, "text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()),
                                              pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    return rows.mapInArrow(predict, _RESULT)


def keep_good(docs: DataFrame, model: FactorisationMachine | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, model, text_col) >= threshold))
            give_back()
    return docs.mapInArrow(choose, docs.schema)
