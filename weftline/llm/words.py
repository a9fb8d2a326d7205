"""Words of marked-up text, and rolling hashes over them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_TAG = re.compile(r"<[^<>]*>|</?[a-zA-Z]*$")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z]\w*);")
_HIDDEN = re.compile("[\\u00AD\\u200B-\\u200D\\u2060\\uFEFF]")
_WORD = re.compile(r"[^\W_]+")
BASE = 0x9E3779B97F4A7C15 | 1


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower case, ё as е; tags and entities part words and are no words. NULL has none."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFC", text))
    return _WORD.findall(text.lower().replace("ё", "е"))


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets everything when it grows too large."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, w: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def windows(h: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``n`` words (modulo 2^64); empty for shorter texts."""
    return windows_at(h, np.arange(max(0, len(h) - n + 1)), n, base)


def windows_at(h: np.ndarray, at: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Karp-Rabin hashes of the windows that start at ``at``."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(base) + h[at + k]
    return out


def portions(it: Iterator[pa.RecordBatch], text: int, chars: int = 1_000_000) -> Iterator[list[tuple]]:
    """Rows in lists of about ``chars`` characters of their column ``text``, so that memory follows neither batch size nor the number of long texts."""
    held: list[tuple] = []
    size = 0
    for b in it:
        for s in range(0, b.num_rows, 64):
            for row in zip(*[c.to_pylist() for c in b.slice(s, 64).columns]):
                held.append(row)
                size += len(row[text] or "")
                if size >= chars:
                    yield held
                    held, size = [], 0
    if held:
        yield held
