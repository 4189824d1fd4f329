"""Problem 3: cut oversized items into pieces at the strongest natural boundaries, with overlap.

A sparse table over boundary strengths answers range-maximum queries in constant time. Each piece ends at
the strongest boundary of the permissible length window (ties: the rightmost); the next piece starts at the
strongest boundary of the last `overlap` characters before that cut, so the two share at most `overlap`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import arrow_map
from ._text import N, class_table, codes

#: Boundary strengths, weakest first; fixed values.
EDGE, SPACE_, CLAUSE, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4, 5, 6


@lru_cache(None)
def _kinds() -> np.ndarray:
    """1 white space, 2 clause mark, 3 Latin sentence end, 4 Han sentence end, 5 line feed."""
    t = np.zeros(N, np.uint8)
    t[(class_table() & 1) != 0] = 1
    for c, k in [(",;:", 2), ("，；：、", 2), (".!?", 3), ("。！？", 4), ("\n", 5)]:
        for x in c:
            t[ord(x)] = k
    return t


def boundary_strengths(a: np.ndarray) -> np.ndarray:
    """Strength of a cut before each position 1..n-1 of code points `a` (index 0 has none).

    White space and . ! ? 。 ！ ？ make natural boundaries on both sides; a cut before one of them is the
    weakest. A clause mark alone (no white space after it) is none.
    """
    n = a.size
    s = np.zeros(n + 1, np.int64)
    if n < 2:
        return s[:n]
    k = _kinds()[a]
    before, after = k[:-1], k[1:]  # the characters left and right of the cut before 1..n-1
    w = np.zeros(n - 1, np.int64)
    white_left, white_right = (before == 1) | (before == 5), (after == 1) | (after == 5)
    w[white_right | (after == 3) | (after == 4)] = EDGE
    w[white_left | (before == 3)] = SPACE_
    prev = np.concatenate([[0], k[:-2]])  # two left of the cut
    w[(before == 1) & (prev == 2)] = CLAUSE
    w[(before == 1) & ((prev == 3) | (prev == 4))] = SENTENCE
    w[(before == 4) & ~np.isin(after, (3, 4))] = SENTENCE
    w[before == 5] = LINE
    w[(before == 5) & (prev == 5)] = PARAGRAPH
    w[white_left & white_right & (w < LINE)] = EDGE  # inside a run of blanks
    s[1:n] = w
    return s[:n]


class RangeMax:
    """Sparse table: the largest value of any range in O(1) after O(n log n) preparation."""

    def __init__(self, v: np.ndarray, longest: int):
        self.level = [v]
        step = 1
        while 2 * step <= min(longest, v.size):
            p = self.level[-1]
            self.level.append(np.maximum(p[:-step], p[step:]))
            step *= 2

    def max(self, lo: int, hi: int) -> int:
        """The largest of v[lo..hi], both included."""
        k = (hi - lo + 1).bit_length() - 1
        t = self.level[k]
        return int(max(t[lo], t[hi - (1 << k) + 1]))


def cut(text: str, limit: int = 1500, overlap: int = 150, least: float = 0.5, block: int = 1 << 18):
    """[(start, end, forced)] of the pieces of `text`.

    Every piece has at most `limit` characters. It ends at the strongest boundary at `least`*limit or later,
    else at the strongest one in the window at all, the overlap being given up if that helps; `forced` marks
    a piece that ends where there is none. The table is built over stretches of `block` characters, so
    memory does not grow with the text. A text within the limit is one piece.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, False)] if n else []
    a = codes(text)
    base, rmq, top = 0, None, 0
    block = max(block, 4 * limit)

    def load(at: int) -> None:
        nonlocal base, rmq, top
        base, top = max(0, at - 2), min(n, at + block)
        s = boundary_strengths(a[base : min(n, top + 2)])[: top - base + 1]
        if base:
            s[:2] = 0  # these lack their left neighbours and are never asked for
        rmq = RangeMax(s * (2 * block + 8) + np.arange(s.size), limit + 1)

    def strongest(lo: int, hi: int) -> int:
        """The rightmost strongest boundary in lo..hi, or -1."""
        if lo > hi:
            return -1
        s, p = divmod(rmq.max(lo - base, hi - base), 2 * block + 8)
        return base + p if s else -1

    load(0)
    out, start, last = [], 0, 0  # last: where the piece before ended
    while n - start > limit:
        if last + limit + 2 > top and top < n:
            load(start)
        hi, forced = start + limit, False
        end = strongest(max(last + 1, start + overlap + 1, start + int(limit * least)), hi)
        if end < 0:
            end = strongest(max(last, start) + 1, hi)
        if end < 0 and start < last:  # without the overlap the piece reaches further
            start = last
            hi = start + limit
            if n <= hi:
                break
            end = strongest(start + 1, hi)
        if end < 0:
            end, forced = hi, True
        out.append((start, end, forced))
        last, back = end, max(end - overlap, start + 1)
        start = strongest(back, end - 1)
        if start < 0:
            start = back if forced else end
    out.append((start, n, False))
    return out


def split_oversized(df: DataFrame, key: str = "unique_id", text: str = "page_content", limit: int = 1500, overlap: int = 150) -> DataFrame:
    """Pieces of every text longer than `limit`: (key, piece_no, start, end, forced, piece).

    Null, empty and short texts give no rows. Rows with a repeated key are each cut. Positions count code
    points. Columns other than key and text are ignored. Row by row, without a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(c):
        out = {k: [] for k in ("key", "piece_no", "start", "end", "forced", "piece")}
        for k, t in zip(c["key"], c["text"]):
            for i, (s, e, f) in enumerate(cut(t, limit, overlap)):
                for name, v in zip(out, (k, i, s, e, f, t[s:e])):
                    out[name].append(v)
        return out

    d = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > limit)
    d = arrow_map(d, run, f"key {kind}, piece_no int, start long, end long, forced boolean, piece string")
    return d.withColumnRenamed("key", key)


def oversized_kinds(df: DataFrame, key: str = "unique_id", text: str = "page_content", limit: int = 1500, overlap: int = 150) -> DataFrame:
    """(key, kind) of every text over the limit: forced if a piece had to end where no boundary is."""
    kind = df.schema[key].dataType.simpleString()

    def run(c):
        how = ["forced" if any(f for _, _, f in cut(t, limit, overlap)) else "natural" for t in c["text"]]
        return {"key": c["key"], "kind": how}

    d = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > limit)
    return arrow_map(d, run, f"key {kind}, kind string").distinct().withColumnRenamed("key", key)
