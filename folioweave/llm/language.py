"""Problem 7: languages of documents and of their parts, against missing, wrong or mixed labels.

A character n-gram naive Bayes model gives each sentence its likelihood in every language. A document is a
mixture: expectation maximisation estimates its language proportions from the sentences' likelihoods; the
set of languages is chosen by penalised likelihood, dropping every language whose removal costs less than a
penalty. The model is fitted on a bounded sample of labelled rows; because labels can be wrong, the fit is
repeated with each row in the language that the first fit gives it.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import arrow_map
from ._text import HAN, LETTER, N, SPACE, Batch, class_table, end_table, groups_by_size, segment_starts
from .scans import HYPHENS, Page

#: Languages that are told apart, with their other names; fixed values.
NAMES = {
    "en": "en eng english anglais englisch inglés ingles 英文 英语",
    "zh": "zh zho chi cmn chinese zh-hans zh-hant mandarin 中文 汉语 chinesisch chinois chino",
    "de": "de deu ger german deutsch allemand alemán aleman 德文 德语",
    "fr": "fr fra fre french français francais französisch francés frances 法文 法语",
    "es": "es spa spanish español espanol castellano spanisch espagnol 西班牙文 西班牙语",
}
#: Words that mean no label; fixed values.
UNKNOWN = frozenset("unknown und undefined undetermined none null nil na n/a nan mul mis zxx xx ? - -- unk other".split())
LANGS = tuple(NAMES)
_CODE = {w: k for k, v in NAMES.items() for w in v.split()}
TRI_BITS, L = 17, len(LANGS)
#: Likelihoods of neighbouring n-grams depend on each other; this tempers them.
TEMPER = 0.35
#: Cost of one more language, in tempered log units.
PENALTY = 12.0


def label_code(label: str | None) -> str | None:
    """Language code of a label in any spelling; None for a missing one; the label itself if it is another language."""
    s = (label or "").strip().lower()
    if not s or s in UNKNOWN:
        return None
    for part in (s, re.split(r"[-_ (]", s)[0]):
        if part in _CODE:
            return _CODE[part]
    return s


_LOW = np.zeros(N, np.uint32)
for _i in range(N):
    _c = chr(_i).lower()
    _LOW[_i] = ord(_c) if len(_c) == 1 and class_table()[_i] & LETTER else 32
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _grams(batch: Batch):
    """(positions that are letters, their trigram slots, their characters)."""
    low = _LOW[np.minimum(batch.a, N - 1)]
    at = np.flatnonzero((batch.cls & LETTER) != 0)
    left = low[np.maximum(at - 1, 0)]
    right = low[np.minimum(at + 1, low.size - 1)]
    mid = low[at]
    h = (left * _M1 + mid) * _M1 + right
    h = (h ^ (h >> np.uint32(15))) * _M2
    return at, (h >> np.uint32(32 - TRI_BITS)).astype(np.int64), mid


class Model:
    """Log probabilities of trigrams and characters by language."""

    def __init__(self, tri: np.ndarray, uni: np.ndarray):
        self.tri, self.uni = tri, uni

    @staticmethod
    def fit(texts: list[str], labels: list[str], rounds: int = 2) -> Model:
        code = np.array([LANGS.index(x) if x in LANGS else -1 for x in labels], np.int64)
        texts = [t for t, c in zip(texts, code) if c >= 0]
        code = code[code >= 0]
        model = Model(np.zeros((1 << TRI_BITS, L), np.float32), np.zeros((N, L), np.float32))
        if not texts:
            return model
        given = code
        for _ in range(rounds):
            tri, uni = np.zeros((1 << TRI_BITS, L)), np.zeros((N, L))
            for lo, hi in groups_by_size(texts):
                b = Batch(texts[lo:hi])
                at, slot, mid = _grams(b)
                c = code[lo + b.owner(at)]
                np.add.at(tri, (slot, c), 1)
                np.add.at(uni, (mid, c), 1)
            never = uni.sum(0) == 0
            tri, uni = np.log((tri + 0.05) / (tri + 0.05).sum(0)), np.log((uni + 0.05) / (uni + 0.05).sum(0))
            tri[:, never] = uni[:, never] = -30.0  # a language without samples explains nothing
            model = Model(tri.astype(np.float32), uni.astype(np.float32))
            got = np.concatenate([model.scores(Batch(texts[lo:hi])) for lo, hi in groups_by_size(texts)])
            best = got.argmax(1)
            margin = got.max(1) - np.take_along_axis(got, given[:, None], 1)[:, 0]
            code = np.where(margin > 3, best, given)
        return model

    def scores(self, batch: Batch, first: np.ndarray | None = None) -> np.ndarray:
        """Tempered log likelihood of each segment (of each text, without `first`) in every language."""
        first = batch.start if first is None else first
        at, slot, mid = _grams(batch)
        v = self.tri[slot] + self.uni[mid]
        seg = np.searchsorted(first, at, side="right") - 1
        return TEMPER * np.stack([np.bincount(seg, weights=v[:, k], minlength=first.size) for k in range(L)], 1)


def _lse(x: np.ndarray) -> np.ndarray:
    m = x.max(1, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(1, keepdims=True)))[:, 0]


class Labelled:
    """Languages of a batch of texts.

    share (texts, languages): mixture proportions by letters; present: the chosen set; seg_*: start, text,
    best language, posterior, letters and wholeness of each segment.
    """

    def __init__(self, texts: list[str], model: Model, rounds: int = 6, penalty: float = PENALTY):
        b = Batch(texts)
        first = segment_starts(b, lines=False)
        # blank lines part segments too
        nl = np.flatnonzero(b.a == 10)
        gap = nl[1:][np.diff(nl) == 1] + 1
        gap = gap[gap < b.a.size]
        first = np.unique(np.concatenate([first, gap])) if gap.size else first
        n = b.n_texts
        ll = model.scores(b, first)
        owner = b.owner(first)
        letter = (b.cls & LETTER) != 0
        seg = np.cumsum(np.bincount(first, minlength=b.a.size)) - 1
        letters = np.bincount(seg[letter], minlength=first.size)
        han = np.bincount(seg[(b.cls & HAN) != 0], minlength=first.size)
        begins = letter & ~np.concatenate([[False], letter[:-1]])
        words = np.bincount(seg[begins], minlength=first.size)
        # whole sentences: a final stop, and words enough; the first must not begin inside a sentence
        inkpos = np.flatnonzero((b.cls & SPACE) == 0)
        last, head = np.zeros(first.size, np.int64), np.full(first.size, -1, np.int64)
        last[seg[inkpos]] = inkpos
        head[seg[inkpos[::-1]]] = inkpos[::-1]
        stop = end_table()[np.minimum(b.a[last], N - 1)]
        whole = ((stop == 1) | (stop == 2)) & ((words >= 4) | (han >= 5))
        h = b.a[np.maximum(head, 0)]
        lower = (_LOW[np.minimum(h, N - 1)] == h) & ((b.cls[np.maximum(head, 0)] & (LETTER | HAN)) == LETTER)
        whole &= ~((lower | (h == 44) | (h == 59)) & np.isin(first, b.start))
        use = letters > 0
        prop = np.full((n, L), 1.0 / L)
        for _ in range(rounds):
            r = np.where(use[:, None], ll + np.log(prop[owner] + 1e-9), 0)
            r = np.exp(r - r.max(1, keepdims=True))
            r = r / r.sum(1, keepdims=True) * letters[:, None]
            prop = np.stack([np.bincount(owner, weights=r[:, k], minlength=n) for k in range(L)], 1)
            prop /= np.maximum(prop.sum(1, keepdims=True), 1e-9)
        post = ll + np.log(prop[owner] + 1e-9)
        full = _lse(post)
        post = np.exp(post - full[:, None])
        # the loss of likelihood without each language
        present = np.zeros((n, L), bool)
        best = post.argmax(1)
        main = prop.argmax(1)
        wholes = np.zeros((n, L))
        np.add.at(wholes, (owner[whole & use], best[whole & use]), 1)
        has = wholes.sum(1) > 0
        for k in range(L):
            rest = prop.copy()
            rest[:, k] = 0
            rest /= np.maximum(rest.sum(1, keepdims=True), 1e-9)
            loss = np.where(whole & use, full - _lse(ll + np.log(rest[owner] + 1e-12)), 0)
            loss = np.minimum(loss, 1e6)
            present[:, k] = (np.bincount(owner, weights=loss, minlength=n) > penalty) & (wholes[:, k] > 0)
        none = ~present.any(1)
        fallback = np.where(has, wholes.argmax(1), main)
        present[none, fallback[none]] = True
        worded = np.bincount(owner, weights=words * (letters > words), minlength=n) + np.bincount(owner, weights=han, minlength=n) > 0
        self.present = present & worded[:, None]
        self.share, self.whole_share = prop, wholes / np.maximum(wholes.sum(1, keepdims=True), 1)
        self.confidence = np.stack([np.bincount(owner, weights=post[:, k] * letters, minlength=n) for k in range(L)], 1)
        own = np.zeros((n, L))
        np.add.at(own, (owner, best), letters)
        weight = np.zeros((n, L))
        np.add.at(weight, (owner, best), letters * post[np.arange(best.size), best])
        self.confidence = weight / np.maximum(own, 1)
        self.seg_start = first - b.start[owner]
        self.seg_text, self.seg_lang, self.seg_letters, self.seg_whole = owner, best, letters, whole
        self.seg_conf = post[np.arange(best.size), best]
        self.seg_end = np.append(first[1:], b.a.size) - b.start[owner]


def flowing(text: str) -> str:
    """Text without the page furniture of scanned records, its wrapped lines joined."""
    if "\n" not in text:
        return text
    page = Page(text)
    if not page.scanned:
        return text
    out = []
    for s, k in zip(page.lines, page.kind):
        if k == "B":
            s = s.strip()
            out.append(s[:-1] if s[-1] in HYPHENS else s + ("" if page.han else " "))
        elif not k:
            out.append("\n")
    return "".join(out)


def fit_model(labelled: DataFrame, text: str, label: str, sample: int = 12_000, longest: int = 4_000) -> Model:
    """Model from about `sample` labelled rows (at most a quarter more) with texts of at most `longest`
    characters, taken by the hash of their text.

    The sample bounds what the driver holds and nothing else; every text is classified afterwards.
    """
    d = labelled.select(F.col(text).alias("t"), F.col(label).alias("l")).where(F.length("t").between(8, longest) & (F.length(F.trim("l")) > 0))
    share = min(1.0, sample / max(1, d.count()))
    rows = d.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(sample + sample // 4).collect()
    return Model.fit([r.t for r in rows], [label_code(r.l) for r in rows])


def document_languages(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, lang, share, confidence, whole): a row for each language of each text.

    The languages are those the text holds whole sentences in, or the likeliest one if it has none; `share` is
    the language's part of the mixture, `whole` its part of the whole sentences. Null texts and texts without
    words give no rows; repeated rows give equal rows. No shuffle.
    """
    kd = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(c):
        out = {n: [] for n in ("k", "lang", "share", "confidence", "whole")}
        texts = [flowing(t) for t in c["t"]]
        for lo, hi in groups_by_size(texts):
            x = Labelled(texts[lo:hi], sent.value)
            for i, k in zip(*np.nonzero(x.present)):
                vals = (c["k"][lo + i], LANGS[k], float(x.share[i, k]), float(x.confidence[i, k]), float(x.whole_share[i, k]))
                for n, v in zip(out, vals):
                    out[n].append(v)
        return out

    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null and k is not null")
    return arrow_map(d, run, f"k {kd}, lang string, share double, confidence double, whole double").withColumnRenamed("k", key)


def segment_languages(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, start, end, lang, confidence) for each stretch of neighbouring sentences in one language.

    Positions count the code points of the text as it flows, without page furniture. Stretches without
    letters join the one before.
    """
    kd = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(c):
        out = {n: [] for n in ("k", "start", "end", "lang", "confidence")}
        texts = [flowing(t) for t in c["t"]]
        for lo, hi in groups_by_size(texts):
            x = Labelled(texts[lo:hi], sent.value)
            cur = None
            for t, s, e, g, cf, n in zip(x.seg_text.tolist(), x.seg_start.tolist(), x.seg_end.tolist(), x.seg_lang.tolist(), x.seg_conf.tolist(), x.seg_letters.tolist()):
                e = min(e, len(texts[lo + t]))
                if cur and cur[0] == t and (not n or g == cur[3]):
                    cur[2] = e
                    if n:
                        cur[4], cur[5] = cur[4] + cf * n, cur[5] + n
                    continue
                if cur:
                    _close(out, c["k"], lo, cur)
                cur = [t, s, e, g, cf * n, n] if n else None
            if cur:
                _close(out, c["k"], lo, cur)
        return out

    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null and k is not null")
    return arrow_map(d, run, f"k {kd}, start long, end long, lang string, confidence double").withColumnRenamed("k", key)


def _close(out: dict, keys: list, lo: int, cur: list) -> None:
    t, s, e, g, w, n = cur
    for name, v in zip(out, (keys[lo + t], s, e, LANGS[g], w / max(n, 1))):
        out[name].append(v)


def wrong_labels(langs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Rows (key, lang) of texts whose label is missing or names no language of theirs, or that mix languages.

    `langs` is the result of document_languages; `labels` has one row a key.
    """
    pairs = [F.create_map(*[F.lit(x) for kv in _CODE.items() for x in kv])]
    s = F.lower(F.trim(F.col(label)))
    code = F.coalesce(F.try_element_at(pairs[0], s), F.try_element_at(pairs[0], F.split(s, r"[-_ (]")[0]))
    lab = labels.select(F.col(key), code.alias("code"))
    per = langs.groupBy(key).agg(F.collect_set("lang").alias("ls"))
    bad = per.join(lab, key).where((F.size("ls") > 1) | F.col("code").isNull() | ~F.array_contains("ls", F.coalesce("code", F.lit(""))))
    return bad.select(key, F.explode("ls").alias("lang"))
