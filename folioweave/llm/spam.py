"""Problem 10: pages of repeated keywords, link lists or product tags, by a hidden Markov model over lines.

A text is cut into lines and sentences. Each of these gets a symbol for its form (links, separators,
repetition, final stop, length) and a sum of word weights. States: prose, link list, tag list, menu. The
model is trained on the whole input in one pass: segments whose form alone is plain give the counts of
words, symbols and transitions by state; the word weights are the log odds of prose against the rest. A
second pass finds the most likely states (Viterbi) and the share of characters outside prose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import arrow_map
from ._text import DIGIT, HAN, LETTER, N, SPACE, Batch, end_table, groups_by_size, segment_starts

PROSE, LINKS, TAGS, MENU = range(4)
STATES = 4
#: Word slots (hashed) and symbols; both bound what training sends to the driver.
BITS = 16
LINK_BINS, SEP_BINS, REP_BINS, END_BINS, LEN_BINS = 3, 3, 3, 2, 4
SYMBOLS = LINK_BINS * SEP_BINS * REP_BINS * END_BINS * LEN_BINS
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Marks that part the entries of a list; fixed values.
SEPARATORS = "|/,，、;；#•·>→<*"


def _sep_table() -> np.ndarray:
    t = np.zeros(N, bool)
    for c in SEPARATORS:
        t[ord(c)] = True
    return t


_SEP = _sep_table()
_LOWER = np.arange(N, dtype=np.uint32)
for _i in range(N):
    _c = chr(_i).lower()
    if len(_c) == 1:
        _LOWER[_i] = ord(_c)


class Features:
    """Segments of a batch of texts: owner, characters, symbol, tokens (hashed) with their segment, plain state."""

    def __init__(self, texts: list[str]):
        b = Batch(texts)
        a, cls = b.a, b.cls
        space = (cls & SPACE) != 0
        first = segment_starts(b)
        seg = np.cumsum(np.bincount(first, minlength=a.size)) - 1 if a.size else np.zeros(0, np.int64)
        ns = first.size
        self.owner = b.owner(first)
        ink = ~space
        self.chars = np.bincount(seg[ink], minlength=ns)
        # links: stretches without white space that hold :// or a dot between letters or digits
        word = (cls & (LETTER | DIGIT)) != 0
        dot = np.zeros(a.size, bool)
        if a.size > 2:
            mid = a[1:-1]
            dot[1:-1] = (mid == 46) & word[:-2] & ((cls[2:] & LETTER) != 0) & word[:-2]
            dot[1:-1] |= (mid == 47) & (a[:-2] == 58) & (a[2:] == 47)
        run = np.cumsum(np.concatenate([[True], space[1:] != space[:-1]])) if a.size else np.zeros(0, np.int64)
        linked = np.zeros(int(run[-1]) + 1 if a.size else 1, bool)
        linked[run[dot]] = True
        inlink = linked[run] & ink
        link = np.bincount(seg[inlink], minlength=ns) / np.maximum(self.chars, 1)
        # tokens: words of other scripts, pairs of Han characters
        han = (cls & HAN) != 0
        latin = word & ~han & ~inlink
        begin = latin.copy()
        begin[1:] &= ~latin[:-1]
        low = _LOWER[np.minimum(a, N - 1)].astype(np.uint64)
        at = np.flatnonzero(begin)
        if at.size:
            stop = np.flatnonzero(latin & ~np.concatenate([latin[1:], [False]]))
            mixed = (low * _MUL) ^ (low << np.uint64(21))
            place = np.arange(a.size) - np.maximum.accumulate(np.where(begin, np.arange(a.size), 0))
            mixed = mixed * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1))
            total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
            lat_hash = total[stop + 1] - total[at]
        else:
            lat_hash = np.zeros(0, np.uint64)
        pair = np.flatnonzero(han[:-1] & han[1:] & ~inlink[:-1]) if a.size > 1 else np.zeros(0, np.int64)
        pair_hash = (low[pair] * np.uint64(65599) + low[pair + 1] + np.uint64(1)) * _MUL if pair.size else np.zeros(0, np.uint64)
        pos = np.concatenate([at, pair])
        h = np.concatenate([lat_hash, pair_hash])
        order = np.argsort(pos, kind="stable")
        pos, h = pos[order], h[order]
        h = (h ^ (h >> np.uint64(31))) * _MUL
        self.slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
        self.tseg = seg[pos]
        nt = np.bincount(self.tseg, minlength=ns)
        # repetition: share of a segment's tokens that stand in it before
        key = (self.tseg.astype(np.uint64) << np.uint64(BITS)) | self.slot.astype(np.uint64)
        seen = np.sort(key)
        if seen.size:
            seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])]
        kinds = np.bincount((seen >> np.uint64(BITS)).astype(np.int64), minlength=ns)
        rep = 1 - kinds / np.maximum(nt, 1)
        sep = np.bincount(seg[_SEP[np.minimum(a, N - 1)] & ~inlink], minlength=ns)
        units = np.bincount(seg[begin], minlength=ns) + np.bincount(seg[han], minlength=ns) / 2
        seps = sep / np.maximum(units, 1)
        # final stop: the last mark of the segment that is no white space
        last = np.zeros(ns, np.int64)
        inkpos = np.flatnonzero(ink)
        last[seg[inkpos]] = inkpos
        e = end_table()[np.minimum(a[last], N - 1)] if a.size else np.zeros(0)
        stop_ = (e == 1) | (e == 2)
        lk = np.digitize(link, (0.05, 0.4))
        sp = np.digitize(seps, (0.17, 0.3))
        rp = np.digitize(rep, (0.25, 0.45))
        ln = np.digitize(nt, (3, 7, 20))
        self.symbol = (((lk * SEP_BINS + sp) * REP_BINS + rp) * END_BINS + stop_) * LEN_BINS + ln
        self.full = self.chars > 0
        # what form alone makes plain; -1 elsewhere
        p = np.full(ns, -1, np.int8)
        short = (nt <= 6) & ~stop_ & (nt > 0)
        lines = short & np.roll(short, 1) & np.roll(short, -1) & np.roll(short, 2) & np.roll(short, -2)
        p[stop_ & (rp == 0) & (sp == 0) & (lk == 0) & (nt >= 7)] = PROSE
        p[lines] = MENU
        p[(nt >= 6) & ((rp == 2) | ((sp == 2) & ~stop_))] = TAGS
        p[lk == 2] = LINKS
        p[~self.full] = -1
        self.plain = p
        self.n_texts = len(texts)


def _count(c: dict) -> dict:
    """Counts of one batch: rows (kind, a, b, n) for words, symbols and transitions of plain segments."""
    word = np.zeros((2, 1 << BITS))
    symbol = np.zeros((STATES, SYMBOLS))
    step = np.zeros((STATES, STATES))
    texts = [t for t in c["t"] if t]
    for lo, hi in groups_by_size(texts):
        f = Features(texts[lo:hi])
        p = f.plain[f.tseg]
        for k, sel in ((0, p == PROSE), (1, p > PROSE)):
            word[k] += np.bincount(f.slot[sel], minlength=1 << BITS)
        sel = f.plain >= 0
        np.add.at(symbol, (f.plain[sel], f.symbol[sel]), 1)
        keep = np.flatnonzero(f.full)
        q, o = f.plain[keep], f.owner[keep]
        both = (q[:-1] >= 0) & (q[1:] >= 0) & (o[:-1] == o[1:])
        np.add.at(step, (q[:-1][both], q[1:][both]), 1)
    out = {"kind": [], "a": [], "b": [], "n": []}
    for kind, m in enumerate((word, symbol, step)):
        i, j = np.nonzero(m)
        out["kind"] += [kind] * i.size
        out["a"] += i.tolist()
        out["b"] += j.tolist()
        out["n"] += m[i, j].tolist()
    return out


def train(docs: DataFrame) -> dict:
    """Model from all texts of column t. What comes to the driver is bounded by the tables' sizes, not by the input."""
    rows = arrow_map(docs.select("t"), _count, "kind int, a int, b int, n double").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    word, symbol, step = np.zeros((2, 1 << BITS)), np.zeros((STATES, SYMBOLS)), np.zeros((STATES, STATES))
    got = rows.toArrow() if hasattr(rows, "toArrow") else pa.Table.from_pandas(rows.toPandas())
    k, a, b, n = (got.column(x).to_numpy() for x in ("kind", "a", "b", "n"))
    for kind, m in enumerate((word, symbol, step)):
        s = k == kind
        m[a[s], b[s]] = n[s]
    total = np.maximum(word.sum(1, keepdims=True), 1)
    seen = word.sum(0)
    # a word's weight: log odds of prose, drawn to 0 for rare words and held within +-2
    odds = np.log((word[0] / total[0] + 1e-5) / (word[1] / total[1] + 1e-5))
    odds = np.clip(odds * seen / (seen + 5), -2, 2)
    emit = np.log((symbol + 0.5) / (symbol.sum(1, keepdims=True) + 0.5 * SYMBOLS))
    # the plain segments are chosen by form, so form counts half
    emit *= 0.5
    move = step + 1 + 20 * np.eye(STATES)
    move = np.log(move / move.sum(1, keepdims=True))
    return {"odds": odds.astype(np.float32), "emit": emit, "move": move}


def _viterbi(emit: np.ndarray, move: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Most likely states of many sequences at once; emit holds them one after the other."""
    out = np.zeros(emit.shape[0], np.int8)
    if not emit.shape[0]:
        return out
    start = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    score = emit[start].copy()
    back = []
    t = 1
    while True:
        live = int(np.searchsorted(-length, -t, side="left"))  # sequences longer than t
        if not live:
            break
        s = score[:live, :, None] + move[None]
        best = s.argmax(1)
        back.append(best.astype(np.int8))
        score[:live] = s.max(1) + emit[start[:live] + t]
        t += 1
    state = score.argmax(1)
    out[start + length - 1] = state
    for t in range(len(back), 0, -1):
        live = back[t - 1].shape[0]
        state[:live] = back[t - 1][np.arange(live), state[:live]]
        out[start[:live] + t - 1] = state[:live]
    return out


def label(texts: list[str], model: dict):
    """(Features, state of each segment; -1 where it is blank)."""
    f = Features(texts)
    keep = np.flatnonzero(f.full)
    w = np.bincount(f.tseg, weights=model["odds"][f.slot], minlength=f.symbol.size)
    nt = np.bincount(f.tseg, minlength=f.symbol.size)
    w = w / np.sqrt(np.maximum(nt, 1)) * 2  # neighbouring words depend on each other
    emit = model["emit"][:, f.symbol[keep]].T.copy()
    emit[:, PROSE] += w[keep]
    length = np.bincount(f.owner[keep], minlength=f.n_texts)
    state = np.full(f.symbol.size, -1, np.int8)
    state[keep] = _viterbi(emit, model["move"], length[length > 0])
    return f, state


def page_shares(docs: DataFrame, key: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """(key, chars, non_prose, links, tags, menu): characters without white space, and shares of each state.

    Null and blank texts have no shares and give no row; repeated rows give equal rows. No shuffle of texts.
    """
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length(F.trim("t")) > 0)
    model = model or train(d)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(c):
        out = {n: [] for n in ("k", "chars", "non_prose", "links", "tags", "menu")}
        for lo, hi in groups_by_size(c["t"]):
            f, s = label(c["t"][lo:hi], sent.value)
            n = hi - lo
            total = np.bincount(f.owner, weights=f.chars, minlength=n)
            by = [np.bincount(f.owner[s == q], weights=f.chars[s == q], minlength=n) / np.maximum(total, 1) for q in range(STATES)]
            out["k"] += c["k"][lo:hi]
            out["chars"] += total.astype(np.int64).tolist()
            out["non_prose"] += (by[1] + by[2] + by[3]).tolist()
            for name, q in (("links", LINKS), ("tags", TAGS), ("menu", MENU)):
                out[name] += by[q].tolist()
        return out

    got = arrow_map(d, run, f"k {kind}, chars long, non_prose double, links double, tags double, menu double")
    return got.where("chars > 0").withColumnRenamed("k", key)


def stuffed_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """Keys of the pages with more than `share` of their characters outside prose."""
    return page_shares(docs, key, text).where(F.col("non_prose") > share).select(key).distinct()
