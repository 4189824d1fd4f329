"""Problem 8: find evaluation passages inside a corpus by Wu-Manber multi-pattern search.

A passage leaks if `words` consecutive words of it (`han` consecutive characters where it is Chinese) stand in
a document, leaving out case, width, punctuation and spacing. Every run of `words` words holds one whole
block of `words+1 // 2` words that starts at a multiple of that number, so these aligned blocks are the
search patterns: few, and far apart, which keeps the shifts long. The scan advances many positions of a batch
in step: the shift table on hashed blocks of text skips positions where no pattern can end, suffix-hash
buckets select patterns at the others, direct comparison confirms, and the match is extended to both sides
and measured in words of the passage.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import arrow_map
from ._text import HAN, Batch, class_table, codes, fold_table, folded, groups_by_size

_MUL = np.uint64(0x9E3779B97F4A7C15)


class Passages:
    """Folded passages with the positions of their words."""

    def __init__(self, rows: list[tuple[str, str]], words: int, han: int):
        self.id, self.text, self.bound, self.need = [], [], [], []
        for sid, raw in rows:
            a = codes(raw or "")
            f = fold_table()[a]
            keep = f != 0
            t = f[keep].astype(np.uint32)
            if not t.size:
                continue
            if 2 * int(((class_table()[t] & HAN) != 0).sum()) > t.size:
                bound, need = np.arange(t.size + 1), han
            else:
                first = keep.copy()
                first[1:] &= ~keep[:-1]
                at = np.cumsum(keep) - 1
                bound, need = np.append(at[first], t.size), words
            if bound.size - 1 >= need:
                self.id.append(sid)
                self.text.append(t)
                self.bound.append(bound)
                self.need.append(need)

    def blocks(self):
        """(passage, first, last) of each aligned block of units."""
        for i, (b, need) in enumerate(zip(self.bound, self.need)):
            size = (need + 1) // 2
            for j in range(0, b.size - size, size):
                yield i, int(b[j]), int(b[j + size])


def _hashes(t: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` code points that end at each position; those before width-1 are useless."""
    n = t.size
    h = t.astype(np.uint64)
    done = 1
    h = h * _MUL
    while done < width:  # doubling: the hash of 2w points from two of w
        step = min(done, width - done)
        nxt = np.zeros(n, np.uint64)
        nxt[step:] = h[:-step] if step else 0
        h = (h ^ (h >> np.uint64(29))) * _MUL + (nxt ^ (nxt >> np.uint64(31)))
        done += step
    return h ^ (h >> np.uint64(32))


class WuManber:
    """Search for many patterns, all of at least `shortest` code points, in long arrays."""

    def __init__(self, patterns: list[np.ndarray], bits: int = 20):
        self.m = m = min(p.size for p in patterns)
        self.block = b = max(2, m // 2)
        self.bits = bits
        self.patterns = patterns
        joined = np.concatenate([p[:m] for p in patterns])
        h = self._slot(_hashes(joined, b)).reshape(len(patterns), m)
        self.shift = np.full(1 << bits, m - b + 1, np.int32)
        for j in range(b - 1, m):  # a block that ends at j allows a shift of m-1-j
            np.minimum.at(self.shift, h[:, j], m - 1 - j)
        self.bucket = defaultdict(list)
        whole = _hashes(joined, m).reshape(len(patterns), m)[:, m - 1]
        for i, x in enumerate(whole.tolist()):
            self.bucket[x].append(i)
        self.heads = np.sort(whole)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def search(self, t: np.ndarray, lanes: int = 512):
        """(start, pattern) of every occurrence in code points `t`."""
        n, m = t.size, self.m
        if n < m:
            return
        slot = self._slot(_hashes(t, self.block))
        skip = self.shift[slot]
        # `lanes` readers go over equal stretches of end positions, each by its own shifts
        edge = np.linspace(m - 1, n, min(lanes, n - m + 1) + 1).astype(np.int64)
        pos, stop, hits = edge[:-1].copy(), edge[1:], []
        while pos.size:
            s = skip[pos]
            at = pos[s == 0]
            if at.size:
                hits.append(at)
            pos = pos + np.maximum(s, 1)
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        if not hits:
            return
        ends = np.concatenate(hits)
        whole = self._heads(t, ends)  # the head of a pattern is its first m code points
        k = np.searchsorted(self.heads, whole)
        k[k == self.heads.size] = 0
        ok = self.heads[k] == whole
        for e, x in zip(ends[ok].tolist(), whole[ok].tolist()):
            start = e - m + 1
            for i in self.bucket[x]:
                p = self.patterns[i]
                if start + p.size <= n and np.array_equal(t[start : start + p.size], p):
                    yield start, i

    def _heads(self, t: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the m code points that end at each of `ends`."""
        m = self.m
        if 8 * ends.size > t.size:
            return _hashes(t, m)[ends]
        win = t[ends[:, None] - np.arange(m - 1, -1, -1)[None, :]]
        return _hashes(win.ravel(), m).reshape(-1, m)[:, m - 1]


class Searcher:
    """Passages and the machines that find them; one machine for words, one for Chinese."""

    def __init__(self, rows, words: int, han: int):
        self.p = Passages(rows, words, han)
        self.groups = []
        by = defaultdict(list)
        for i, lo, hi in self.p.blocks():
            by[self.p.need[i] == han and self.p.bound[i].size == self.p.text[i].size + 1].append((i, lo, hi))
        for where in by.values():
            self.groups.append((where, WuManber([self.p.text[i][lo:hi] for i, lo, hi in where])))

    def find(self, texts: list[str]):
        """{(index of text, passage id)} of all leaks."""
        found = set()
        for first, last in groups_by_size(texts):
            t, starts = folded(Batch(texts[first:last]))
            for where, machine in self.groups:
                for at, k in machine.search(t):
                    i, lo, hi = where[k]
                    doc = first + int(np.searchsorted(starts, at, side="right")) - 1
                    if (doc, self.p.id[i]) in found:
                        continue
                    p, b = self.p.text[i], self.p.bound[i]
                    left, k2 = lo, min(lo, at)
                    if k2:
                        d = np.flatnonzero(t[at - k2 : at][::-1] != p[lo - k2 : lo][::-1])
                        left = lo - (int(d[0]) if d.size else k2)
                    over = at + hi - lo
                    right, k2 = hi, min(p.size - hi, t.size - over)
                    if k2:
                        d = np.flatnonzero(t[over : over + k2] != p[hi : hi + k2])
                        right = hi + (int(d[0]) if d.size else k2)
                    units = int(np.searchsorted(b, right, side="right") - 1 - np.searchsorted(b, left))
                    if units >= self.p.need[i]:
                        found.add((doc, self.p.id[i]))
        return found


def leaked_passages(
    corpus: DataFrame, evaluation: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "sample_id",
    passage: str = "gold_answer", words: int = 15, han: int = 30, block_chars: int = 16_000_000,
) -> DataFrame:
    """(item_key, doc_key) for each document that holds `words` consecutive words of an item's passage.

    The passages go to the executors in blocks of about `block_chars` characters, whatever their number; the
    corpus is scanned once for each block and nothing of it is shuffled but the result. Null and empty texts,
    and passages shorter than the limit, give no rows; repeated rows give their pair once; extra columns are
    ignored.
    """
    spark = corpus.sparkSession
    items = evaluation.select(F.col(item_key).alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    kd, ki = corpus.schema[doc_key].dataType.simpleString(), evaluation.schema[item_key].dataType.simpleString()
    docs = corpus.select(F.col(doc_key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == b)
        rows = [(r.i, r.p) for r in part.collect()]  # at most about block_chars characters
        sent = spark.sparkContext.broadcast(rows)
        own = {}

        def run(c, sent=sent, own=own):
            if "s" not in own:
                own["s"] = Searcher(sent.value, words, han)
            got = sorted(own["s"].find(c["t"]), key=lambda x: x[0])
            return {"i": [s for _, s in got], "k": [c["k"][d] for d, _ in got]}

        found = arrow_map(docs, run, f"i {ki}, k {kd}")
        out = found if out is None else out.unionByName(found)
    return out.distinct().select(F.col("i").alias(item_key), F.col("k").alias(doc_key))
