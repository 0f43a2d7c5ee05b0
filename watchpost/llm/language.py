"""Language ID by error-correcting output codes.

Every language has a codeword of +1 and -1.  One binary classifier a bit, logistic over
hashed byte 1- to 3-grams of the letters, predicts that bit of the codeword.  Decoding
weighs each bit by the loss of its margin and takes the language whose codeword costs
least; a close second flags the document as ambiguous.

Training reads labelled rows outside the held-out fold: of each language the same number of
different texts, those of smallest hash, ``sample_rows`` in all (documented bound; one text
at least of every language).  Scoring is one pass over all documents without a shuffle.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, held_out, pick, portions
from .features import LETTERS, gram_counts

_LETTER = re.compile(r"[^\W\d_]")
_SPLIT = ((1, 256), (2, 1024), (3, 2048))
WIDTH = sum(n for _, n in _SPLIT)
_RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """rows x WIDTH features: square roots of gram counts, each row of length 1."""
    data = LETTERS[data]
    x = np.sqrt(np.concatenate([gram_counts(data, starts, size, n) for size, n in _SPLIT], 1))
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords: all different splits of the classes for few classes, else the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        columns = [[1, *[1 if m >> k & 1 else -1 for k in range(n - 1)]] for m in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).T
    rng, bits = np.random.default_rng(seed), 4 * int(np.ceil(np.log2(n))) + 7
    codes = [rng.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(200)]
    return max(codes, key=lambda c: min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)))


class CodeModel:
    """Languages, their codewords and the weights of the bit classifiers."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.05, decay: float = 1e-5):
        self.languages, self.code = languages, codewords(len(languages))
        self.weights, self.bias = np.zeros((WIDTH, self.code.shape[1]), np.float32), np.zeros(self.code.shape[1], np.float32)
        if len(languages) < 2:
            return
        target = self.code[y].astype(np.float32)
        share = np.bincount(y, minlength=len(languages))
        each = (1 / share[y] / len(languages)).astype(np.float32)[:, None]
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, rounds + 1):
            margin = target * (x @ self.weights + self.bias)
            slope = -target * each / (1 + np.exp(np.clip(margin, -30, 30)))
            grad = x.T @ slope + decay * self.weights
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            self.weights -= rate * 20 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7) / 10
            self.bias -= rate * slope.sum(0)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score (0 to 1) and whether the second is close, per row."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margin = (x @ self.weights + self.bias)[:, None, :] * self.code[None]
        cost = np.logaddexp(0, -margin).sum(2, dtype=np.float64)
        share = np.exp(-(cost - cost.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        top = np.sort(share, 1)
        return cost.argmin(1), top[:, -1], top[:, -1] < 2 * top[:, -2]


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 3000) -> CodeModel | None:
    """Fit on at most ``sample_rows`` different texts (more languages than that: one each); None where nothing is labelled."""
    known = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.agg(F.count_distinct("lang")).first()[0]
    if not n:
        return None
    each = max(1, sample_rows // n)
    # copies of a text are one draw, so no text can crowd out its language or another
    drawn = known.select("lang", F.xxhash64("text").alias("h")).distinct()
    chosen = drawn.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("at") <= each).select("lang", "h")
    sample = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, limit=2 << 20, rows=500):
                x = grams(*flat(batch)).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "x": pa.array([r.tobytes() for r in x], pa.binary())})
    rows = sorted((r["lang"], bytes(r["x"])) for r in sample.select("text", "lang").mapInArrow(features, "lang string, x binary").collect())
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    x = np.frombuffer(b"".join(b for _, b in rows), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return CodeModel(languages, x, np.array([languages.index(lang) for lang, _ in rows]))


def identify(docs: DataFrame, model: CodeModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous.

    ``und`` with score 0 for null texts, texts without a letter, and where there is no model.
    Rows of equal id are rows of their own; other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("held_out", held_out(F.col("doc_id")))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, limit=2 << 20, rows=500):
                lettered = np.array([t is not None and _LETTER.search(t) is not None for t in batch.column("text").to_pylist()], bool)
                names, score, close = np.full(len(lettered), "und", object), np.zeros(len(lettered)), np.zeros(len(lettered), bool)
                if model is not None:
                    best, share, near = model.decode(grams(*flat(batch)))
                    names = np.where(lettered, np.array(model.languages, object)[best], "und")
                    score, close = np.where(lettered, share, 0.0), near & lettered
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names.tolist(), pa.string()),
                                                  pa.array(score, pa.float64()), pa.array(close)],
                                                 names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])
    return rows.mapInArrow(predict, _RESULT)
