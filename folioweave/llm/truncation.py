"""Problem 2: texts that were cut off inside a word or sentence, or in transfer.

Two tests make a case. The self-join by prefix: every text without a sentence's end asks, by the hash of its characters,
whether it is a strict prefix of a longer copy elsewhere; texts that begin like one of those that ask offer the hashes of
all their prefixes, and equal hashes meet. It proves a cut where the longer copy goes on inside a word or sentence.
Where no longer copy exists the end of the text decides: a marker of a cut, or a last sentence without an end that
is no heading, caption, list item, table row or code. Page furniture after the last words of scanned pages is left out.
A child whose text goes on in its parent is no case; its end is looked for in the parent by the same hashes.

No text is shuffled or sorted: hashes are. A bitmap of fixed size lets through only hashes that somebody asked for;
as it fills up with the input more are shuffled and none is lost. Copies are one hash before any join.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._frames import arrow_map
from ._text import codes
from .scans import Page, closed

#: Markers of a cut at the end of a text; fixed values.
MARKER = re.compile(
    r"(?:\.{2,}|…+|[\[(<{]\s*(?:\.{2,}|…|truncated|cut(?: off)?|snip(?:ped)?|continued|cont\.?|more|gekürzt|tronqué|truncado|截断|未完|下文略|略)\s*[\])>}]?|（(?:未完|截断|下文略)）?|�+)\s*$",
    re.I,
)
CAPTION = re.compile(r"(?:fig(?:ure|\.)?|table|tab\.|abb(?:ildung|\.)?|tabelle|tableau|figura|tabla|algorithm|box|图|表|圖)\s*[\d.]+", re.I)
NUMBERED = re.compile(r"(?:\d+(?:\.\d+)+\.?|\d+\.|[IVX]+\.|§\s*\d+|第.{1,5}[章节])\s*\S")
ITEM = re.compile(r"\s*(?:[-*•·+▪–]\s+|\(?\d{1,3}[.)]\s+|\(?[a-z][.)]\s+|\[[ xX]\]\s)")
CODE = re.compile(r"^\s{2,}\S|^\t|[{};]\s*$|\w\s*[-+*]?=\s*\S|\w\(.*\)\s*$|^\s*(?:for|if|while|def|class|return|import|from|else|try|SELECT|FROM|WHERE)\b.*[:;)]\s*$|^\s*(?://|#!|</?\w+>)")
_LETTER = re.compile(r"[^\W\d_]")


def _row(s: str) -> bool:
    """A table row, or a stretch of data rather than words."""
    if "\t" in s or s.count("|") >= 2 or s.startswith("|"):
        return True
    if s.count(",") >= 4 and " " not in s.strip():
        return True
    tail = s.rstrip().rsplit(None, 1)[-1] if s.strip() else ""
    return len(tail) > 120 and tail.isascii()


def cut_at_end(text: str) -> bool:
    """Whether the end of `text` alone shows that it was cut off."""
    if not text or not _LETTER.search(text):
        return False
    if MARKER.search(text):
        return True
    if closed(text):
        return False
    page = Page(text) if "\n" in text else None
    if page is not None and page.scanned:
        body = [s for s, k in zip(page.lines, page.kind) if k == "B"]
        if not body:
            return False
        return not closed(body[-1]) or bool(MARKER.search(body[-1]))
    lines = [s for s in text.split("\n") if s.strip()]
    last = lines[-1]
    s = last.strip()
    if _row(last) or CAPTION.match(s) or ITEM.match(last):
        return False
    if len(lines) > 1 and CODE.search(last):
        return False
    if NUMBERED.match(s) and len(s) < 80:
        return False
    if s.startswith("#") and len(s) < 120:
        return False
    if s[-1] in ")）]】" and s[-1].translate(_PAIR) in s:
        return False
    if len(lines) == 1 and len(s) < 60 and _heading(s):
        return False
    return True


_PAIR = str.maketrans(")）]】", "(（[【")


def _heading(s: str) -> bool:
    """A single short line in title case, or of few Han characters without any stop."""
    words = s.split()
    if re.search(r"[㐀-鿿]", s):
        return len(s) <= 14 and not re.search(r"[，。！？；：、]", s)
    big = [w for w in words if len(w) > 3]
    return bool(big) and all(w[:1].isupper() for w in big) and not re.search(r"[,;:]", s) and len(words) <= 8


# --- hashes of prefixes and of windows ---------------------------------------------------------------------
_M = 0x9E3779B97F4A7C15
_INV = pow(_M, -1, 1 << 64)
#: Characters of the beginning by which longer copies are told first, and the bits of the filter's addresses.
HEAD, FILTER = 32, 28
#: Characters of a child's end that are looked for in its parent, without white space; shorter texts are looked for whole.
TAIL = 64


class _Powers:
    """Powers of the base and of its inverse, as many as were ever needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.size <= n:
            k = np.full(max(n + 1, 4096), _M, np.uint64)
            k[0] = 1
            self.up = np.cumprod(k)
            k[1:] = _INV
            self.down = np.cumprod(k)
        return self.up[: n + 1], self.down[: n + 1]


_POWERS = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def prefix_sums(t: str) -> np.ndarray:
    """A number for each prefix of a text, the empty one first; equal prefixes have equal numbers."""
    a = codes(t).astype(np.uint64)
    up, _ = _POWERS.to(a.size)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed((a + np.uint64(1)) * np.uint64(_M)) * up[: a.size])])


def prefix_keys(sums: np.ndarray, lengths: np.ndarray, salt: int = 0) -> np.ndarray:
    return _mixed(sums[lengths] + lengths.astype(np.uint64) * np.uint64(_M) + np.uint64(salt & (1 << 64) - 1))


def window_keys(sums: np.ndarray, ends: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Keys of the windows of `width` characters that end at `ends`, wherever they stand."""
    _, down = _POWERS.to(sums.size)
    return _mixed((sums[ends] - sums[ends - width]) * down[ends - width] + np.uint64((salt + width * _M) & (1 << 64) - 1))


def _name(x) -> int:
    return int.from_bytes(hashlib.blake2b(repr(x).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _bare(t: str) -> str:
    return "".join(t.split())


def _breaks(more: str) -> bool:
    """Whether what follows a text in its longer copy begins anew, so that nothing was cut."""
    return not more.strip() or more.lstrip(" \t\r")[:1] == "\n"


def _asked(c: dict) -> dict:
    """What each record asks for: (k, s, by_end, h: its whole text as a prefix, g: texts that begin like it,
    tail and up: its end in its parent, and that parent with the width of the end)."""
    out = {n: [] for n in ("k", "s", "by_end", "h", "g", "tail", "up")}
    for k, s, up, t in zip(c["k"], c["s"], c["up"], c["t"]):
        end = t is not None and cut_at_end(t)
        h = g = tail = parent = None
        if t and (end or not closed(t) and _LETTER.search(t)):
            sums = prefix_sums(t)
            if len(t) >= HEAD:
                h, g = prefix_keys(sums, np.array([len(t), HEAD]))
            else:  # short texts are prefixes by chance, but for copies of the same source
                h, g = prefix_keys(sums, np.array([len(t)]), _name(s))[0], _mixed(np.array([_name(s)], np.uint64))[0]
            bare = _bare(t) if up is not None else ""
            if bare:
                w, of = min(TAIL, len(bare)), _name(up)
                tail = window_keys(prefix_sums(bare), np.array([len(bare)]), w, of)[0]
                parent = _mixed(np.array([(of + w) & (1 << 64) - 1], np.uint64))[0]
        for n, v in zip(out, (k, s, end, *(None if x is None else int(np.int64(x.view(np.int64))) for x in (h, g, tail, parent)))):
            out[n].append(v)
    return out


def _bitmap(asked: DataFrame) -> np.ndarray:
    """The low and the high bits of all numbers that are asked for, as a bitmap of fixed size."""
    h = asked.select(F.explode(F.array("h", "g", "tail", "up")).alias("h")).where("h is not null")
    bit = F.explode(F.array(F.col("h").bitwiseAND(F.lit((1 << FILTER) - 1)), F.shiftrightunsigned("h", 64 - FILTER)))
    w = h.select(bit.alias("b")).select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("b"))
    words = w.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def _let(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(h.size, bool)
    for at in (h & np.uint64((1 << FILTER) - 1), h >> np.uint64(64 - FILTER)):
        at = at.astype(np.int64)
        out &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    return out


def _offered(sent):
    """(h, more) of each record: hashes of its prefixes that somebody asks for, with what follows them; and hashes of
    windows that its children ask for, without."""

    def run(batches):
        bits = sent.value
        widths = np.arange(1, TAIL + 1)
        for b in batches:
            ks, ss, ts = (b.column(n).to_pylist() for n in ("k", "s", "t"))
            # by source, by beginning and by key: who may have been asked at all
            names = {s: _name(s) for s in set(ss)}
            copied = {s: bool(_let(bits, _mixed(np.array([n], np.uint64)))[0]) for s, n in names.items()}
            short = np.array([copied[s] and bool(t) for s, t in zip(ss, ts)], bool)
            long = np.zeros(len(ts), bool)
            at = [i for i, t in enumerate(ts) if t and len(t) > HEAD]
            if at:
                head = codes("".join(ts[i][:HEAD] for i in at)).astype(np.uint64).reshape(-1, HEAD)
                up, _ = _POWERS.to(HEAD)
                sums = (_mixed((head + np.uint64(1)) * np.uint64(_M)) * up[:HEAD]).sum(1)
                long[at] = _let(bits, _mixed(sums + np.uint64(HEAD * _M & (1 << 64) - 1)))
            of = np.array([_name(k) for k in ks], np.uint64)
            parent = _let(bits, _mixed(of[:, None] + widths.astype(np.uint64)).ravel()).reshape(len(ks), -1)
            hs, more = [], []
            for i in np.flatnonzero(short | long | parent.any(1)):
                t = ts[i]
                if not t:
                    continue
                if short[i] or long[i]:
                    sums = prefix_sums(t if long[i] else t[:HEAD])
                for yes, lo, hi, salt in ((short[i], 1, min(HEAD, len(t)), names[ss[i]]), (long[i], HEAD, len(t), 0)):
                    if yes and hi > lo:
                        place = np.arange(lo, hi)
                        keys = prefix_keys(sums, place, salt)
                        for n in np.flatnonzero(_let(bits, keys)):
                            rest = t[place[n] : place[n] + 40]
                            if not _breaks(rest):
                                hs.append(keys[n])
                                more.append(rest)
                asked = widths[parent[i]]
                if asked.size:
                    bare = _bare(t)
                    sums = prefix_sums(bare)
                    for w in asked.tolist():
                        if len(bare) > w:
                            keys = np.unique(window_keys(sums, np.arange(w, len(bare)), w, int(of[i])))
                            keys = keys[_let(bits, keys)]
                            hs += list(keys)
                            more += [None] * keys.size
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(more, pa.string())], names=["h", "more"])

    return run


def truncated(
    docs: DataFrame, key: str = "unique_id", text: str = "page_content", source: str = "source", parent: str | None = "parent_id",
    level: str | None = "chunk_level",
) -> DataFrame:
    """(key, source, cut, by_prefix, by_end, in_parent, more) for every row of `docs`, one row a key expected.

    by_prefix: a longer copy goes on inside a word or sentence, `more` is how (40 characters); texts of fewer than
    HEAD characters are compared with copies of their own source only. by_end: the text's own end shows the cut.
    in_parent: the row is a child (`level` is 'child') and its last TAIL characters stand in its parent, which goes on.
    `cut` is one of the first two without the last. Null, empty and wordless texts are never cut. Repeated keys get
    one row each.
    """
    child = (F.col(level) == "child") & F.col(parent).isNotNull() if parent and level else F.lit(False)
    up = F.when(child, F.col(parent)) if parent else F.lit(None).cast("string")
    d = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), up.alias("up"), F.col(text).alias("t"))
    kd, sd = (d.schema[c].dataType.simpleString() for c in "ks")
    asked = materialize(arrow_map(d, _asked, f"k {kd}, s {sd}, by_end boolean, h long, g long, tail long, up long"), "asked")
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(asked))
    met = materialize(d.select("k", "s", "t").mapInArrow(_offered(sent), "h long, more string").groupBy("h").agg(F.min("more").alias("more")), "met")
    # who asks for nothing asks for a number of its own, so that no task gets all of them
    own = lambda c: F.coalesce(c, F.xxhash64("k"))
    pre = met.where("more is not null").select(F.col("h").alias("mh"), "more")
    goes = met.where("more is null").select(F.col("h").alias("th"), F.lit(True).alias("goes"))
    v = asked.join(pre, own(F.col("h")) == F.col("mh"), "left").join(goes, own(F.col("tail")) == F.col("th"), "left")
    by_prefix, in_parent = F.col("h").isNotNull() & F.col("more").isNotNull(), F.col("tail").isNotNull() & F.col("goes").isNotNull()
    return v.select(
        F.col("k").alias(key), F.col("s").alias(source), ((F.col("by_end") | by_prefix) & ~in_parent).alias("cut"), by_prefix.alias("by_prefix"), "by_end",
        in_parent.alias("in_parent"), F.when(by_prefix, F.col("more")).alias("more"),
    )


def truncation_rates(verdicts: DataFrame, source: str = "source") -> DataFrame:
    """(source, records, cut, share) from the result of `truncated`; a null source is a source of its own."""
    n = F.sum(F.col("cut").cast("long"))
    return verdicts.groupBy(source).agg(F.count("*").alias("records"), n.alias("cut"), (n / F.count("*")).alias("share"))
