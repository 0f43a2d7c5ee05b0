"""License scan: exact set-similarity join of text blocks with license templates.

A block is a window over the words of a whole text, twice as long as the notice, so notices
that wrap are found and words far apart are not; a template is the token set of a license
notice; a pair is a result when the block holds at least ``threshold`` of the template's
tokens.  One pass counts in how many lines of the whole corpus each template token stands,
which orders tokens from rare to common.  In that order only a template's prefix, its
``size - need + 1`` rarest tokens, has to be indexed: a block that meets the threshold
shares one of them.  Candidates then pass the length filter (lines also
the positional filter) before the overlap is counted, and nothing that qualifies is lost.

The templates are a parameter, not data: they travel with the task, so the join needs no
shuffle and no block can be hot.  Phrases that stand word by word give the base labels.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, pick, texts, words

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices looked for by their words, whatever the order; own wording of common statements.
TEMPLATES = {
    "mit": ["released under the MIT License", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "apache-2": ["licensed under the Apache License Version 2.0"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "Creative Commons Attribution NonCommercial license"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0", "Creative Commons Attribution ShareAlike license"],
    "cc0": ["dedicated to the public domain under CC0 1.0"],
    "gpl-3": ["licensed under the GNU General Public License version 3"],
    "gpl-2": ["licensed under the GNU General Public License version 2"],
    "lgpl": ["licensed under the GNU Lesser General Public License"],
    "mpl-2": ["licensed under the Mozilla Public License version 2.0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
}
_COUNT = "token string, blocks long"
_RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class TemplateIndex:
    """Templates as token lists from rare to common, and an index of their prefixes."""

    def __init__(self, templates: dict[str, list[str]], frequency: dict[bytes, int], threshold: float):
        self.rows, self.index = [], {}
        sets = [(label, frozenset(words(text.encode()))) for label, notices in templates.items() for text in notices]
        self.lengths = [len(words(text.encode())) for notices in templates.values() for text in notices]
        self.vocabulary = frozenset().union(*[s for _, s in sets])
        self.place = {t: i for i, t in enumerate(sorted(self.vocabulary, key=lambda t: (frequency.get(t, 0), t)))}
        for label, tokens in sets:
            ordered = sorted(tokens, key=self.place.__getitem__)
            need = max(1, int(np.ceil(threshold * len(ordered) - 1e-9)))
            for i, token in enumerate(ordered[:len(ordered) - need + 1]):
                self.index.setdefault(token, []).append((len(self.rows), i))
            self.rows.append((label, tokens, len(ordered), need))
        self.starters = frozenset(self.index)

    def find(self, block: list[bytes]) -> dict[str, float]:
        """Label and share of its template's tokens for every template the block contains."""
        if self.starters.isdisjoint(block):
            return {}
        held = sorted(self.vocabulary.intersection(block), key=self.place.__getitem__)
        found, seen = {}, set()
        for j, token in enumerate(held):
            for k, i in self.index.get(token, ()):
                if k in seen:
                    continue
                seen.add(k)
                label, tokens, size, need = self.rows[k]
                if len(held) < need:  # length
                    continue
                if 1 + min(size - i - 1, len(held) - j - 1) < need:  # position: what can still be shared
                    continue
                overlap = len(tokens.intersection(held))
                if overlap >= need:
                    found[label] = max(found.get(label, 0.0), overlap / size)
        return found

    def find_near(self, own: list[bytes], reach: int = 2) -> dict[str, float]:
        """As ``find``, a block being any ``reach`` times a template's length of consecutive words."""
        if self.starters.isdisjoint(own):
            return {}
        places: dict[bytes, list[int]] = {}
        for p, token in enumerate(own):
            if token in self.place:
                places.setdefault(token, []).append(p)
        found = {}
        for k in sorted({k for token in places for k, _ in self.index.get(token, ())}):
            label, tokens, size, need = self.rows[k]
            if len(held := tokens & places.keys()) < need:
                continue
            span, best, left, inside = reach * self.lengths[k], 0, 0, {}
            walk = sorted((p, token) for token in held for p in places[token])
            for p, token in walk:
                inside[token] = inside.get(token, 0) + 1
                while walk[left][0] <= p - span:
                    gone = walk[left][1]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    left += 1
                best = max(best, len(inside))
            if best >= need:
                found[label] = max(found.get(label, 0.0), best / size)
        return found


def token_blocks(df: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many lines of the corpus each token of the templates stands (all lines count)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in texts(batch):
                if text:
                    for line in text.translate(_LINES).split(b"\n"):
                        for token in vocabulary.intersection(line.split()):
                            total[token] += 1
        yield pa.RecordBatch.from_pydict({"token": [t.decode() for t in total], "blocks": pa.array(total.values(), pa.int64())})
    rows = pick(df, text=text_col).mapInArrow(count, _COUNT).groupBy("token").agg(F.sum("blocks").alias("blocks")).collect()
    return {r["token"].encode(): r["blocks"] for r in rows}


#: As the word table, but line ends stay.
_LINES = bytes(10 if c == 10 else WORD_TABLE[c] for c in range(256))


def phrase_places(own: list[bytes], phrases: list[bytes]) -> dict[bytes, list[int]]:
    """Word places at which each phrase begins."""
    joined = b" " + b" ".join(own) + b" "
    found = {}
    for phrase in phrases:
        at, before, places = joined.find(b" " + phrase + b" "), (0, 0), []
        while at >= 0:
            before = (at, before[1] + joined.count(b" ", before[0], at))
            places.append(before[1])
            at = joined.find(b" " + phrase + b" ", at + 1)
        if places:
            found[phrase] = places
    return found


def scan(df: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.9,
         id_col: str = "doc_id", text_col: str = "text", reach: int | None = 2) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``score`` is 1 for a phrase, else the largest share of a template's tokens found in a
    block that meets the threshold, else 0.  Null counts as empty: no words, no labels
    (empty strings).  A block is any ``reach`` times a template's length of consecutive words,
    whatever the line ends; with ``reach`` None it is a line.  Rows of equal id are rows of their own; other columns are ignored.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    named = {b" ".join(words(p.encode())): label for p, label in phrases.items()}
    rarest = {max(p.split(b" "), key=len) for p in named}  # a text without any of these words has no phrase
    vocabulary = frozenset().union(*[words(t.encode()) for notices in templates.values() for t in notices])
    index = TemplateIndex(templates, token_blocks(df, vocabulary, text_col), threshold)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in texts(batch):
                n_words, shares, low = 0, {}, (text or b"").translate(_LINES)
                for line in low.split(b"\n"):
                    block = line.split()
                    n_words += len(block)
                    for label, share in index.find(block).items() if reach is None else ():
                        shares[label] = max(shares.get(label, 0.0), share)
                if reach is not None:
                    shares = index.find_near(low.split(), reach)
                places = phrase_places(low.split(), list(named)) if any(w in low for w in rarest) else {}
                starts = [p for found in places.values() for p in found]
                base = {named[p] for p in places}
                for column, value in zip(columns, (n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                                                   ",".join(sorted({*base, *shares})), 1.0 if base else max(shares.values(), default=0.0))):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    return pick(df, doc_id=id_col, text=text_col).mapInArrow(find, _RESULT)
