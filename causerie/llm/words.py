"""Digests of words, each worked out once for as long as it is remembered."""

from __future__ import annotations

from hashlib import md5, sha256
from itertools import chain

import numpy as np

REMEMBERED = 300_000


class Digests:
    """A row of bytes a word: its MD5, or its SHA-256 if wide. What is remembered has a bound; beyond it all is forgotten, and results stay the same."""

    def __init__(self, wide: bool = False, remembered: int = REMEMBERED) -> None:
        self.width, self.digest = (32, sha256) if wide else (16, md5)
        self.most, self.at, self.rows = remembered, {}, np.empty((0, self.width), np.uint8)

    def indices(self, docs: list[list[bytes]], total: int) -> np.ndarray:
        """Rows of the words of docs, one after the other; they hold until the next call."""
        at = self.at
        new = set(chain.from_iterable(docs)).difference(at)
        if at and len(at) + len(new) > self.most:
            at.clear()
            self.rows = self.rows[:0]
            new = set(chain.from_iterable(docs))
        if new:
            at.update(zip(new, range(len(at), len(at) + len(new))))
            made = np.frombuffer(b"".join([self.digest(w, usedforsecurity=False).digest() for w in new]), np.uint8).reshape(-1, self.width)
            self.rows = np.concatenate([self.rows, made])
        return np.fromiter(map(at.__getitem__, chain.from_iterable(docs)), np.int64, total)
