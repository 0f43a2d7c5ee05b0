"""Token ids by a public tokenizer file, with a bounded cache of the pieces of texts."""
from __future__ import annotations

import os
import re
from array import array

import numpy as np

_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
#: The pieces byte-level BPE cuts a text into before it merges, for texts of Latin characters.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+"
                    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Texts with other characters, or maybe with a special token, are encoded whole.
_FAR = re.compile("[^\x00-ɏ]")
#: Byte-level BPE shows printing bytes as themselves and the others, in order, as characters from 256 on.
_PRINTS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_SHOWN = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTS)))}
_BLANK = chr(_SHOWN[32])
_ENCODERS: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """ids of texts.  Merges never cross pieces, so each different piece is encoded once
    while it stays in one of the two generations of the cache (``room`` pieces each)."""

    def __init__(self, path: str, room: int = 400_000):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # ours comes first
        self.tokenize = self.tokenizer.model.tokenize
        self.room, self.young, self.old = room, {}, {}

    def _ids(self, piece: str) -> bytes:
        """ids of a piece that is not in the young generation, which it joins."""
        got = self.old.get(piece)
        if got is None:
            shown = piece.replace(" ", _BLANK) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_SHOWN)
            got = array(self.kind, [t.id for t in self.tokenize(shown)]).tobytes()
        self.young[piece] = got
        return got

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids a text; null counts as empty."""
        out = []
        for text in texts:
            if not text:
                out.append(np.zeros(0, self.dtype))
            elif "<|" in text or (not text.isascii() and _FAR.search(text)):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype))
            else:
                pieces = _PIECE.findall(text)
                found = list(map(self.young.get, pieces))
                if None in found:
                    get, ids = self.young.get, self._ids
                    found = [x if x is not None else get(p) or ids(p) for p, x in zip(pieces, found)]
                    if len(self.young) > self.room:
                        self.old, self.young = self.young, {}
                out.append(np.frombuffer(b"".join(found), self.dtype))
        return out


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; a reused worker keeps its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
