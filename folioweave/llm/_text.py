"""Vectorised text primitives: a batch of texts as one array of code points.

Everything here works on whole batches with numpy, so Python's cost per character stays at a few
nanoseconds. Code points above the basic plane are mapped like U+FFFD in the class tables.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

N = 0x10000
SPACE, LETTER, DIGIT, HAN = 1, 2, 4, 8
#: Sentence ends; fixed values.
LATIN_ENDS = ".!?"
HAN_ENDS = "。！？"


@lru_cache(None)
def class_table() -> np.ndarray:
    """uint8 flags SPACE, LETTER, DIGIT, HAN for each code point of the basic plane."""
    t = np.zeros(N, np.uint8)
    for i in range(N):
        c = chr(i)
        if c.isspace():
            t[i] |= SPACE
        elif c.isdigit():
            t[i] |= DIGIT
        elif c.isalpha():
            t[i] |= LETTER
    t[0x3400:0x4DC0] = LETTER | HAN
    t[0x4E00:0xA000] = LETTER | HAN
    t[0xF900:0xFB00] = LETTER | HAN
    return t


@lru_cache(None)
def fold_table() -> np.ndarray:
    """Letters and digits in lower case and usual width; 0 for everything else."""
    cls, t = class_table(), np.zeros(N, np.uint32)
    for i in range(N):
        if cls[i] & (LETTER | DIGIT) or 0xFF00 <= i < 0xFFF0:
            s = unicodedata.normalize("NFKC", chr(i)).lower()
            if len(s) == 1 and s.isalnum() and ord(s) < N:
                t[i] = ord(s)
            elif cls[i] & (LETTER | DIGIT):
                t[i] = i
    return t


def codes(text: str) -> np.ndarray:
    """Code points of `text`; those above the basic plane become U+FFFD."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if a.size and a.max() >= N:
        a = np.where(a < N, a, 0xFFFD).astype(np.uint32)
    return a


class Batch:
    """Texts joined by line feeds. start[i]:end[i] is text i without its separator."""

    def __init__(self, texts: list[str]):
        self.a = codes("\n".join(texts) + "\n")
        n = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
        self.end = np.cumsum(n) - 1
        self.start = self.end - n + 1
        self.cls = class_table()[self.a]
        self.n_texts = len(texts)

    def owner(self, pos: np.ndarray) -> np.ndarray:
        """The text that holds each position."""
        return np.searchsorted(self.end, pos, side="left")


def folded(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(folded letters and digits of all texts, a 0 between two texts; start of each text in them)."""
    f = fold_table()[batch.a]
    keep = f != 0
    keep[batch.end] = True
    out = f[keep]
    where = np.cumsum(keep)
    ends = where[batch.end] - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if batch.n_texts else np.zeros(0, np.int64)
    return out, starts


def fold(text: str | None) -> str:
    """`text` without case, width, punctuation and spacing."""
    if not text:
        return ""
    f = fold_table()[codes(text)]
    return f[f != 0].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def groups_by_size(texts, limit: int = 250_000):
    """(first, last) of runs of texts with about `limit` characters, so that arrays stay in the cache."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


@lru_cache(None)
def end_table() -> np.ndarray:
    """1 for a Latin sentence end, 2 for a Han one, 3 for a line feed."""
    t = np.zeros(N, np.uint8)
    for c in LATIN_ENDS:
        t[ord(c)] = 1
    for c in HAN_ENDS:
        t[ord(c)] = 2
    t[10] = 3
    return t


def segment_starts(batch: Batch, lines: bool = True) -> np.ndarray:
    """First positions of the batch's sentences, or of lines too; every text starts one."""
    e = end_table()[batch.a]
    cut = e == 2
    latin = e == 1
    latin[:-1] &= (batch.cls[1:] & SPACE) != 0
    cut |= latin
    if lines:
        cut |= e == 3
    first = np.zeros(batch.a.size, bool)
    first[1:] = cut[:-1]
    first[batch.start] = True
    return np.flatnonzero(first)


def add_at(index: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(index, weights=weight, minlength=n)
